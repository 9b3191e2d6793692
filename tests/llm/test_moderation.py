import os
import pickle
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import moderation as m

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{FOLDER}/moderation_samples.parquet").orderBy("sample_id").collect()
    terms = spark.read.parquet(f"{FOLDER}/flag_terms.parquet").collect()
    return [(r["text"], r["label"]) for r in rows], [(t["term"], t["category"], t["severity"]) for t in terms]


@pytest.fixture(scope="module")
def judge(samples):
    return m.Moderator(m.count_trigrams(t for t, _ in samples[0]), *samples)


@pytest.mark.parametrize(
    ("spelled", "meant"),
    [
        ("you $cumb@g", ["you", "scumbag"]), ("wort**less", ["worthless"]), ("U-n-g-e-z-i-e-f-e-r", ["ungeziefer"]), ("Ungeziefe\nr", ["ungeziefer"]), ("сосkrоасhеs", ["cockroaches"]), ("n\u200ba\u200bk\u200be\u200bd", ["naked"]),
        ("undrsesed", ["undressed"]), ("ho**ny", ["horny"]), ("idioooot", ["idiot"]), ("an i d i o t like", ["an", "idiot", "like"]), ("O$tr@n! came", ["ostrani", "came"]), ("nac-kt auf", ["nackt", "auf"]), ("ÚŃD̈RËŚS̈ÉD̈", ["undressed"]),
        ("1998 and 455", ["1998", "and", "455"]), ("", []), (" \n\n ", []),
    ],
)
def test_restoring(judge, spelled, meant):
    assert [w for s in judge.restorer.sentences(spelled) for w in s] == meant


def test_viterbi_against_all_readings():
    """On a small lattice: every choice of letters, drops and swaps tried."""
    model = m.CharacterModel(m.count_trigrams(["abba cab bac", "cabbage a bag"]))

    def readings(token):
        if not token:
            yield 0.0, ""
            return
        c = token[0]
        own = [(x, m.LOOKS) for x in m.LOOKALIKES.get(c, "")] + ([(c, m.SAME)] if "a" <= c <= "z" else [])
        for x, cost in own:
            for rest, read in readings(token[1:]):
                yield cost + rest, x + read
        if c in m.NOISE or not own:
            for rest, read in readings(token[1:]):
                yield m.DROPPED + rest, read
        if len(token) > 1 and all("a" <= x <= "z" for x in token[:2]) and c != token[1]:
            for rest, read in readings(token[2:]):
                yield m.SWAPPED + rest, token[1] + c + read

    def language(read):
        n = [0, 0, *(ord(c) - 96 for c in read), 0]
        return sum(model.cost[a][b][c] for a, b, c in zip(n, n[1:], n[2:]))

    words = m.Words({"cab", "bag", "ab", "cabbage", "abba"})
    for token in ("c4b", "8@g", "ca-b", "ab1", "b@(", "acb"):
        best = [(cost + language(read), read) for cost, read in readings(token) if read]
        assert m.cheapest(token, model) == pytest.approx(min(best)[0])
        known = min(((cost, read) for cost, read in best if read in {"cab", "bag", "ab", "cabbage", "abba"}), default=None)
        found = m.decode(token, model, words)
        assert found == known if known is None else found == (pytest.approx(known[0]), known[1])


@pytest.mark.parametrize("hyphens", [1, 3, 12, 100, 10_000])
def test_spellings_of_any_length(judge, hyphens):
    signs = "-" * hyphens
    assert [w for s in judge.restorer.sentences(f"you i{signs}d{signs}iot") for w in s] == ["you", "idiot"]
    assert judge.restorer.read("*" * hyphens + "-" * hyphens + "diot") == ["idiot"]


def test_held_out_accuracy(samples):
    """Sentences that the model has not seen; their like it may have."""
    labelled, terms = samples
    trigrams = m.count_trigrams(t for t, _ in labelled)
    wrong = 0
    for fold in range(4):
        judge = m.Moderator(trigrams, [s for i, s in enumerate(labelled) if i % 4 != fold], terms)
        wrong += sum((judge.text(t)[0] >= m.THRESHOLD) != (label != "clean") for i, (t, label) in enumerate(labelled) if i % 4 == fold)
    assert wrong <= 0.05 * len(labelled)


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("If you come back I will break your legs.", True), ("You worthless idiot, nobody asked you.", True), ("Shut your mouth, you filthy rat.", True), ("You people are vermin and should be thrown out of this town.", True),
        ("She moaned with pleasure as he kissed her bare thighs.", True),
        ("My stupid printer broke again.", False), ("The word \"idiot\" comes from an old term.", False), ("Kill the process and empty the trash.", False), ("Rats are vermin that damage crops.", False), ("Moderators removed a post that called a player a \"scumbag\".", False),
        ("The committee reviewed the budget and adjourned.", False), ("Breast cancer screening reached 40 percent of adults.", False),
    ],
)
def test_passages_that_no_sample_holds(judge, text, bad):
    assert (judge.text(text)[0] >= m.THRESHOLD) == bad


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("Si je te croise encore, je te fracasse la mâchoire.", True), ("Ich schlage dir die Zähne aus, du elender Feigling.", True), ("Te voy a romper la cabeza, cobarde asqueroso.", True), ("Aucun Hadrim ne mérite de rester parmi nous.", True),
        ("Heiße Frauen nackt vor der Webcam, Pornos nur für Erwachsene.", True),
        ("Der Zahnarzt untersuchte die Zähne der Kinder.", False), ("Le dentiste soigne les dents des enfants.", False), ("El dentista cuida los dientes de los niños.", False), ("The court convicted the man who stabbed two victims.", False), ("Kein Mensch darf ohne Urteil bestraft werden.", False), ("Return the list if none is left.", False),
    ],
)
def test_words_weigh_alike_in_all_languages(judge, text, bad):
    """None of the words that decide is in a labelled sentence of the text's language; what they are about is labelled in another."""
    assert (judge.text(text)[0] >= m.THRESHOLD) == bad


def test_concepts_of_words():
    concepts = m.Concepts({"one": "breaks break* ab*", "two": "breakfast abc* ab"})
    assert [concepts.of(w) for w in ("breaks", "breaking", "breakfast", "ab", "abx", "abcd", "a", "")] == ["one", "one", "two", "two", "one", "two", None, None]
    assert {m.Concepts().of(w) for w in ("die", "con", "son", "the", "und", "les", "los", "")} == {None}


def test_rare_words_of_a_concept_weigh_more():
    """Unlabelled words of one concept: what the corpus uses less tells more, up to a bound; a listed term keeps its category's weight."""
    lexicon = m.Lexicon([("our streets", "hateful"), ("a street", "clean")], [("nous", "hateful", 2)])
    background = np.zeros(len(lexicon.row), np.int64)
    for word, n in (("our", 500), ("we", 4_000), ("uns", 40), ("notre", 4), ("nous", 4)):
        background[[r for r in lexicon.rows(word) if r >= 0]] += n
    share = m.Scorer._shares(lexicon, background, background / background.sum())
    our, we, uns, notre, nous, nos = (share[lexicon.row[w]] for w in ("our", "we", "uns", "notre", "nous", "nos"))
    mean = (500 + 4_000 + 40 + 4) / 4
    assert our == pytest.approx(0.5 + 0.5 * mean / 500) and we == pytest.approx(0.5 + 0.5 * mean / 4_000) and uns == notre == m.MOST_SHARE and nous == nos == 1
    scorer = m.Scorer(lexicon, [(["our", "streets"], 2), (["a", "street"], 0)], background, 1_000_000)
    gain = [scorer.gain[scorer.index(lexicon.rows(w)), 1, 2] for w in ("uns", "we")]
    assert gain[0] > gain[1] + 1


def test_wordings_left_out(spark, samples):
    """All labelled sentences of one wording are left out of the fit; words in common say which are."""
    labelled, terms = samples
    found = [set(m.PIECES.findall(m.plain_letters(t))) for t, _ in labelled]
    often = {w for w in set().union(*found) if sum(w in f for f in found) >= 2}
    texts = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("text is not null").select("text").collect()]
    trigrams, met = m.count_trigrams(texts), Counter(w for t in texts for w in m.PIECES.findall(m.plain_letters(t)))
    hit = wrong = 0
    for i in range(0, len(labelled), 6):
        own = found[i] & often
        rest = [s for s, f in zip(labelled, found) if len(own & f & often) < 0.4 * len(own | f & often)]
        lexicon = m.Lexicon(rest, terms)
        background = np.zeros(len(lexicon.row), np.int64)
        for word, n in met.items():
            background[[r for r in lexicon.rows(word) if r >= 0]] += n
        over = m.Moderator(trigrams, rest, terms, background, met.total()).text(labelled[i][0])[0] >= m.THRESHOLD
        hit += over and labelled[i][1] != "clean"
        wrong += over and labelled[i][1] == "clean"
    assert hit >= 15 and wrong == 0, (hit, wrong)


def test_every_passage_is_scored(judge):
    """No passage gets a constant: what a sentence adds to another's words changes the score."""
    scores = {judge.text(t)[0] for t in ("Tonight we dine.", "We dine with you.", "With you tonight.", "You will be with us.")}
    assert len(scores) == 4


def test_scores_by_formula(judge):
    """The running sums against one sentence at a time, word by word."""
    import math

    scorer, found = judge.scorer, "you worthless pig go back under your rock".split()
    gains = [scorer.gain[scorer.index(judge.rows[w])] for w in found]
    z = [max(sum(g[p][c] for g in gains) for p in range(len(m.PARTS))) for c in range(len(m.CLASSES))]
    odds = math.log(sum(math.exp(x) for x in z[1:])) - math.log(math.exp(z[0]) + 1)
    expected = 1 / (1 + math.exp(-(odds * m.INDEPENDENCE + math.log(m.PRIOR / (1 - m.PRIOR)))))
    assert judge.text("You worthless pig, go back under your rock.")[0] == pytest.approx(expected)


def test_texts_are_scored_together(judge, monkeypatch):
    """A call of the scorer for many texts, a lookup for each word; what stands around a text changes nothing in its score."""
    calls, looked, real, index = [], Counter(), m.Scorer.__call__, judge.scorer.index
    texts = ["You worthless pig, go back under your rock. Fine.\nNo end", None, "", " \n ", "…", "word " * 60 + "you idiot", "You worthless idiot, nobody asked you.\nYou worthless idiot, nobody asked you.", "The committee adjourned."] * 50
    alone = [judge.text(t) for t in texts]
    assert alone[0][2] == 1 and alone[6][2] == 2 and alone[1] == alone[3] == (0.0, "clean", 0)
    fresh = pickle.loads(pickle.dumps(judge))
    monkeypatch.setattr(m.Scorer, "__call__", lambda self, *given: calls.append(1) or real(self, *given))
    fresh.index = m.WordIndex(fresh.rows, lambda rows: looked.update([rows]) or index(rows))
    assert fresh.texts(texts) == alone and len(calls) <= 2
    assert len(fresh.index) < 40 and looked.total() == len(fresh.index)
    assert fresh.texts([]) == [] and fresh.texts([None, ""]) == alone[1:3]


def test_windows_cover_every_word():
    for n in range(1, 80):
        parts = m.passages(n)
        assert set().union(*(range(a, b) for a, b in parts)) == set(range(n)) and all(b - a <= m.WINDOW + 2 for a, b in parts)


def test_counts_of_the_corpus(spark):
    lexicon = m.Lexicon([("You erotic fool 12", "abusive")], [("fool", "abusive", 2), ("erotic", "sexual", None)])
    docs = spark.createDataFrame([("Fools fool you. 3 4",), (None,), ("erotica eroticism",)], "text string")
    trigrams, background, total = m.corpus_counts(docs, lexicon)
    got = {key: int(background[r]) for key, r in lexicon.row.items()}
    assert total == 7 and got["fool"] == 1 and got["you"] == 1 and got["<n>"] == 2 and got["=abusive"] == 2 and got["=sexual"] == 2 and got["~eroti"] == 2
    assert (trigrams == m.count_trigrams(["Fools fool you. 3 4", "erotica eroticism"])).all()


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "x"), (2, "", " Web", "x"), (3, "You are an idiot.", "web", "x"), (3, "You are an idiot.", "web", "x"), (4, "word " * 100_000 + "you idiot", None, "x"), (None, "…", "web", None)],
        "doc_id long, text string, source string, score string",
    )
    rows = [(i, "You are an idiot." if i % 2 else "The idiot box is old.", "en", "abusive" if i % 2 else "clean") for i in range(12)] + [(50, None, "en", "clean"), (51, "x", "en", "odd"), (52, "y", None, None)]
    samples = spark.createDataFrame(rows, "sample_id long, text string, lang string, label string")
    terms = spark.createDataFrame([(1, " Idiot ", "abusive", 2), (2, None, "abusive", None), (3, "x", None, None)], "term_id long, term string, category string, severity int")
    out = m.moderate(docs, samples, terms).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and by[1]["score"] == by[2]["score"] == 0 and by[1]["source"] == "unknown"
    assert by[3]["score"] >= m.THRESHOLD and by[3]["category"] == "abusive" and by[3]["passages"] == 1
    rates = {r["source"]: r for r in m.source_rates(m.moderate(docs, samples, terms)).collect()}
    assert rates["web"]["n_documents"] == 4 and rates["web"]["n_flagged"] == 2 and rates["web"]["rate"] == 0.5
    assert m.moderate(docs.limit(0), samples, terms).count() == 0
    assert m.moderate(docs, samples.limit(0), terms.limit(0)).count() == 6


def test_terms_are_not_cut_with_the_samples(spark, monkeypatch):
    given, real = [], m.Moderator.__init__
    monkeypatch.setattr(m, "MOST_SAMPLES", 3)
    monkeypatch.setattr(m.Moderator, "__init__", lambda self, trigrams, samples, terms, *more: given.append((samples, terms)) or real(self, trigrams, samples, terms, *more))
    docs = spark.createDataFrame([(1, "x", "web")], "doc_id long, text string, source string")
    samples = spark.createDataFrame([(i, "You are an idiot.", "abusive") for i in range(9)], "sample_id long, text string, label string")
    terms = spark.createDataFrame([(f"term{c}", "abusive", 2) for c in "abcdefgh"], "term string, category string, severity int")
    m.moderate(docs, samples, terms)
    assert [len(x) for x in given[0]] == [3, 8]
    monkeypatch.setattr(m, "MOST_TERMS", 7, raising=False)
    with pytest.raises(ValueError):
        m.moderate(docs, samples, terms)


@pytest.mark.parametrize("sign", ["\"", "'", ".", "!", "*", "$", "a ", "a", "x\n", "-", "@ ", "who ", "\u0301", "é", "you rot ", "*-", "!1"])
def test_texts_full_of_one_sign_take_no_longer(judge, sign):
    import time

    began = time.time()
    judge.text(sign * (100_000 // len(sign)) + "x")
    assert time.time() - began < 15
