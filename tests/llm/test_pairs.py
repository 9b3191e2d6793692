import pytest

from corpusmill.llm import pairs

Q = "A pump at Praripond moves 87 litres per minute. After 28 minutes, 13 litres leak away. How much water remains?"
STEPS = "First we look for the product. Multiplying gives $ 87 \\times 28 = 2436 $. Now we take away 13 from 2436."


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("\u200b", "empty"), ("...", "empty"), ("N/A", "empty"), ("[empty]", "empty"), ("<think>\n\n</think>", "empty"), ("$$ $$", "empty"),
        (STEPS, "truncated"), (STEPS + " **Answer:**", "truncated"), (STEPS + " So we get $\\boxed{24", "truncated"), (STEPS + " Therefore the answer is 24", "truncated"), ("Multiplying gives $ 87 \\ti", "truncated"), (f"<think>{STEPS}</think>", "truncated"),
        ("I'm sorry, but I can't help with that.", "refusal"), ("unfortunately i must decline; please ask a tutor.", "refusal"), ("Lo siento, pero no puedo ayudarte con eso.", "refusal"), ("Dazu äußere ich mich nicht.", "refusal"), ("Je refuse de traiter ce sujet.", "refusal"), ("<think>\nHmm.\n</think>\nI'd rather not.", "refusal"),
        (Q, "copies_question"), (Q.upper(), "copies_question"), (f"{Q}\n{Q}", "copies_question"), ("Problem: " + Q[:-1], "copies_question"), (Q.replace(" ", "\n"), "copies_question"), (Q.replace("moves ", ""), "copies_question"), (f"<think>\n{Q}\n</think>", "copies_question"),
        ("Los datos son 87, 28 y 13. El producto es $ 87 \\times 28 = 2436 $. La respuesta es, por tanto, 2423.", "other_language"), ("Начнём с чисел 87 и 28. Значит, ответ равен 2423.", "other_language"), ("首先看已知的数 87 和 28。因此答案是 2423。", "other_language"),
        (STEPS + " Therefore the answer is 2423.", None), (STEPS + " **Answer:** 2423", None), (STEPS + " So we get $\\boxed{2423}$ Have a nice day!", None), ("2423", None), ("$x = 2423$", None), (f"{Q}\n{STEPS} The final answer is \\boxed{{2423}}.", None),
        ("I'm sorry for the long notation, but it keeps the steps clear. I can't help but notice it. " + STEPS + " Hence the result equals 2423.", None), ('The French text says "Le produit vaut la somme de la valeur.", which helps. ' + STEPS + " Therefore the answer is 2423.", None),
        (f"{Q}\n2423", None), ("The answer is 2423. " + STEPS, None), ("x" * 300_000, "truncated"),
    ],
)
def test_solutions(answer, defect):
    assert pairs.solution_defects(Q, answer)[:1] == ([defect] if defect else [])


@pytest.mark.parametrize("box", ["\\boxed{\\frac{\\sqrt{2}}{3}}", "\\boxed{" + "1" * 300 + "}", "\\boxed{\n2423\n}", "\\boxed{" + "{" * 50 + "x" + "}" * 50 + "}"])
def test_boxes_of_any_form_close_a_solution(box):
    assert pairs.solution_defects(Q, f"{STEPS} So we get ${box}$") == []
    assert pairs.solution_defects(Q, f"{STEPS} So we get ${box[:-1]}$") == ["truncated"]


@pytest.mark.parametrize(("begin", "end"), ["“”", "«»", '""', "$$", ("\\(", "\\)"), ("\\[", "\\]")])
def test_long_quotations_and_formulas_say_nothing_of_the_language(begin, end):
    foreign = "el producto de los valores es la respuesta y el resultado " * 60
    assert not pairs.other_language(Q, f"{STEPS} {begin}{foreign}{end} Therefore the answer is 2423.")


CALL = '{"name": "loom_queue", "arguments": {"job": 33}}'
ASK = "Where is job 33 in the loom queue?"


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (f"[{CALL}]", None), (CALL, None), (f"```json\n[{CALL}]\n```", None), ("[{'name': 'loom_queue', 'arguments': {'job': 33}}]", None), (f"[{CALL.replace('33', '[1, {}]')}]", None), ('[{"function": {"name": "f", "arguments": "{}"}}]', None),
        ('[{"name": "send_note", "arguments": {"body": "I cannot help with that, la la la"}}]', None),
        (None, "empty"), ("[]", "empty"), ("{}", "empty"), ("```json\n[]\n```", "empty"), ('[""]', "empty"), ("null", "empty"), ("None", "empty"), ("[null]", "empty"),
        ('[{"name": "loom_qu', "truncated"), (f"[{CALL}", "truncated"), (f"```json\n[{CALL}, {{", "truncated"), ('[{"name": "loom_queue", "arguments": {"job": 6...', "truncated"),
        ("That is not something I do.", "refusal"), ('[{"error": "I won\'t be providing a solution here."}]', "refusal"), ('["No can do, this task is off limits for me."]', "refusal"),
        (ASK, "copies_question"), (f'["**{ASK.upper()}**"]', "copies_question"), ("> " + ASK, "copies_question"),
        ("La llamada de loom_queue devolvió 43 entradas, y el resultado ya está listo.", "other_language"), ('[{"name": "loom_queue", "result": "调用 loom_queue 返回了 23 条记录,结果已经可以使用。"}]', "other_language"),
        ("[" * 5000, "empty"), ("[{" * 3000 + "x", "truncated"),
    ],
)
def test_calls(answer, defect):
    assert pairs.call_defects(ASK, answer)[:1] == ([defect] if defect else [])


def test_a_null_question_leaves_comparisons_out():
    assert pairs.solution_defects(None, STEPS + " Therefore the answer is 2423.") == []
    assert pairs.call_defects(None, f"[{CALL}]") == []


def test_every_triggered_defect_comes_out(spark):
    rows = [("t", 1, "calls", "Envía esta nota a Tadon: The pump works.", "I won't be providing a solution here, as this is outside of what I am allowed to do for you", "x"), ("t", 1, "solution", Q, None, "x"), ("t", None, "solution", None, "5", "x")]
    df = spark.createDataFrame(rows, "source_table string, row_id long, kind string, question string, answer string, defect string")
    out = pairs.pair_defects(df).collect()
    assert sorted((r["defect"], r["priority"]) for r in out) == [("empty", 1), ("other_language", 2), ("refusal", 1)]
    assert pairs.pair_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("sign", ["“", "„", "«", "\\boxed{", "\\(", "\\[", "$", "{", '"', "<think>", "can not be ", "answer ", "answer 1", "ich darf nicht ", "a\n"])
def test_texts_full_of_one_sign_take_no_longer(sign):
    import time

    began = time.time()
    pairs.solution_defects(Q, sign * (200_000 // len(sign)) + "x")
    pairs.call_defects(ASK, sign * (200_000 // len(sign)) + "x")
    assert time.time() - began < 8


@pytest.mark.parametrize(
    ("answer", "defects"),
    [
        ("The answer is 5. But wait, let us check it. \\frac{1}{", ["truncated"]), ("We find that \\boxed{4}. Next, we must consider the second ca", ["truncated"]), ("The result is 7. It follows from the", ["truncated"]), ("We have $x = 3$. The answer is 3. ```python\nprint(", ["truncated"]),
        ("This completes the proof.", []), ("As n is even, so is its square. Q.E.D.", []), ("Therefore x = 5.", []), ("It costs $5 and the answer is 5.", []), ("The answer is 12 (see above).", []),
        ("I cannot help with the equation.", ["refusal"]), ("We are not permitted to solve exams.", ["refusal"]), ("Answering would violate our usage policy.", ["refusal"]), ("Ich kann Ihnen dabei leider nicht helfen.", ["refusal"]), ("Je ne peux pas résoudre cet exercice.", ["refusal"]), ("Non posso risolvere questo problema.", ["refusal"]),
        ("I cannot see a shorter way, but the answer is 12.", []), ("We can't help but note the symmetry. Hence the sum is 12.", []),
    ],
)
def test_rules_for_solutions(answer, defects):
    question = "How many are there in the box, and why?"
    assert [d for d in pairs.solution_defects(question, answer) if d != "other_language"] == defects


@pytest.mark.parametrize(
    ("answer", "defects"),
    [
        ('[book_flight(city="Rome")]', []), ('book_flight(city="Rome", note="It\'s (not) late")', []), ('book_flight(city="Ro', ["truncated"]), ('[book_flight(city="Rome"), book', ["truncated"]),
        (f"<tool_call>\n{CALL}\n</tool_call>", []), (f"{CALL}\n{CALL}", []), (f"Sure: [{CALL}]", []), ("[{'name': 'f', 'arguments': {'x': 'it''s'}}]", []),
        ("[{error: I am not able to help with that request}]", ["truncated"]), ('[{"error": "I am not able to help with that request", }]', ["refusal"]),
    ],
)
def test_notations_of_calls(answer, defects):
    assert pairs.call_defects(ASK, answer) == defects


def test_edits_against_the_table_of_distances():
    import random

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(1)
    for _ in range(2_000):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 9))] for _ in range(2))
        most = draw.randint(0, 6)
        assert pairs._distance(a, b, most) == min(full(a, b), most + 1)


def test_models_of_letters_tell_a_language_that_few_function_words_do(spark, monkeypatch):
    """Trained on the table's own texts; a question without function words is taken for the language it is spelled in."""
    monkeypatch.setattr(pairs, "FEWEST_TRIPLES", 2_000)
    german = "Der Bauer geht heute mit seinem Hund in den Wald, weil die Sonne scheint und das Wetter schön ist, sagte Nachbarin Nummer"
    english = "The farmer walks through the forest with his dog today because the sun is shining and the weather is fine, said neighbour number"
    rows = [("t", i, "solution", f"{text} {i}?", f"{text} {i}.") for i in range(30) for text in (german, english)]
    speech = pairs.train_languages(spark.createDataFrame(rows, "source_table string, row_id long, kind string, question string, answer string"))
    assert speech.trained[[pairs.LANGUAGES.index("en"), pairs.LANGUAGES.index("de")]].all() and not speech.trained[pairs.LANGUAGES.index("nl")]
    assert pairs.other_language("Wald, Wetter, Sonne, Nachbarin", "The weather and the sun in the forest", speech)
    assert not pairs.other_language("Wald, Wetter, Sonne, Nachbarin", "Der Wald und das Wetter in der Sonne", speech)
