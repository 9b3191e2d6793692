"""Problem 3: broken prompt and response pairs, by ordered rules.

The rules are tested each on their own, and every defect that triggers comes out: nothing of substance; a copy of the
question from its beginning on; a sentence that declines; prose in another script, or in another language by function
words and a character model; and breaking off, by unclosed delimiters, an abrupt last line or the lack of a closing
statement. The character models are trained on the texts of the pairs that their function words tell the language of.
"""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.moderation import SIZE, CharacterModel, letter_numbers
from corpusmill.llm.textnorm import fold, words

#: The defects, in the order in which they are tested; the first that a pair triggers names it.
DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")

#: Words that stand for a missing answer, and words that carry none.
PLACEHOLDERS = {"na", "none", "null", "nil", "nan", "tbd", "todo", "empty", "undefined", "cut", "json", "text", "answer", "solution", "blank", "missing"}
FILLERS = {"hmm", "hm", "um", "uh", "well", "okay", "ok", "so", "hello", "hi", "sorry", "thanks", "thank", "you"}

#: A copy may differ from the question in this share of its words, and have this share of others, one at least.
TRIFLING, FOREIGN = 0.3, 0.1
#: A text speaks another language if it fits it better by this many nats, of which a function word counts so many.
CLEARLY, PER_FUNCTION_WORD = 12.0, 4.0
#: Function words that tell a text's language when the character models are trained.
TELLING_WORDS = 3
#: Letter triples that a language's model is trained on at least, before it is used.
FEWEST_TRIPLES = 50_000


def _one_of(*alternatives: str) -> str:
    return "(?:" + "|".join(alternatives) + ")"


#: How sentences decline, on folded text: who cannot, may not or will not do what an answer does.
_SOME = r"(?: \w+){0,3}?"
_EN_NOT = _one_of("can ?not", "can'?t", "could ?not", "couldn'?t", "won'?t", "will not", "would not", "wouldn'?t", "must not", "may not", "shall not", "do not", "don'?t", "(?:am|are|is|was|were|be)(?: not|n't) (?:able|allowed|permitted|authori[sz]ed|willing|going|prepared|in a position) to", "'m not (?:able|allowed|permitted|authori[sz]ed|willing|going) to", "not (?:able|allowed|permitted|authori[sz]ed) to", "unable to", "refuse to", "decline to", "rather not", "prefer not to")
_EN_ACT = _one_of("help", "assist", "answer", "respond", "reply", "solve", "provid(?:e|ing)", "offer(?:ing)?", "comply", "fulfill?", "process", "complete", "discuss", "engage", "support", "handle", "share", "perform", "go into", "work on", "talk about", "do (?:this|that|so|it)", "be (?:helping|answering|assisting|providing|solving|responding|doing)", "give (?:you )?(?:an?|the|any) (?:answer|solution|result)")
_EN_RULES = _one_of("guidelines?", "rules?", "polic(?:y|ies)", "principles?", "instructions?", "terms", "regulations?")
_EN_TASK = _one_of("requests?", "questions?", "tasks?", "exercises?", "problems?", "quer(?:y|ies)", "topics?", "calls?", "matters?", "this", "that", "it")
REFUSALS = re.compile(
    "|".join(
    [
        rf"\b{_EN_NOT} (?:\w+ly )?{_EN_ACT}\b(?! but\b)(?! bu?$)",
        r"\b(?:i|we)(?:'d| would)? (?:must |have to |need to |would like to |will |shall |respectfully |do )*(?:decline|refuse)\b",
        r"\b(?:i|we)(?:'d| would) rather not\b|\b(?:i|we) prefer not to\b|\bno can do\b",
        rf"\b(?:against|violat\w+|break\w*|breach\w*|contraven\w+|contrary to|conflicts? with){_SOME} {_EN_RULES}\b|\b{_EN_RULES}{_SOME} (?:do(?:es)? not|don'?t|doesn'?t|forbids?|prohibits?|prevents?)\b",
        rf"\b(?:outside|beyond)(?: of)? (?:what (?:i|we)\b|(?:my|our|the)(?: \w+)? (?:scope|capabilit\w+|abilit\w+|remit|competence))|\bnot something (?:that )?(?:i|we)\b",
        rf"\b{_EN_TASK}{_SOME} (?:is|are|was|were|be|been) (?:\w+ly )?(?:declined|refused|rejected|denied|prohibited|forbidden|off limits|not (?:allowed|permitted|appropriate))\b",
        r"\b(?:lack|without|have no)(?: \w+)? (?:permission|authori[sz]ation|authority)\b|\bnot (?:be )?appropriate for me\b|\bas an ai\b",
        rf"\bje ne (?:peux|puis|suis|veux|vais|saurais|dois)(?: pas)? {_one_of('(?:vous |t |y |te |m )?(?:aider|repondre|resoudre|traiter|fournir|donner|continuer|discuter)', 'en mesure', 'autorisee?', 'capable', 'pas')}\b|\bpas en mesure de\b|\bje (?:refuse|decline)\b|\bje dois (?:refuser|decliner)\b|\b(?:m'|m )?interdi\w+ de\b|\bm'interdi\w+|\bje prefere ne pas\b|\bne pas (?:traiter|repondre|resoudre)\b",
        r"\b(?:verbiete[nt]|untersag(?:en|t)|erlaub(?:en|t)) (?:es )?mir\b|\bdarf (?:ich )?(?:\w+ ){0,6}?nicht\b|\b(?:ich (?:\w+ ){0,3}?|muss ich (?:\w+ ){0,3}?|leider )(?:ablehnen|verweiger\w+)\b|\blehne (?:ich (?:\w+ ){0,4}?ab|\w+ ab)\b|\bich lehne\b|\b(?:kann|werde|will|mochte)(?: ich)? (?:\w+ ){0,6}?nicht (?:helfen|weiterhelfen|beantworten|antworten|losen|bearbeiten|behandeln)\b|\bau(?:ss|ß)ere ich mich (?:\w+ ){0,3}?nicht\b",
        r"\bno (?:puedo|podemos|pude|podria|voy a|quiero|debo) (?:ayudar|responder|contestar|resolver|hacer|tratar|proporcionar|dar|continuar)\w*|\bno (?:estoy|estamos) (?:autorizad|permitid|capacitad)\w+\b|\bprefiero no\b|\bme (?:impiden?|prohiben?)\b|\b(?:debo|tengo que) (?:rechazar|negarme|declinar)\b|\bme niego a\b|\brechazo\b",
        r"\bnon (?:posso|possiamo|voglio|intendo) (?:aiutar|risponder|risolver|fornir|trattar)\w*|\b(?:mi rifiuto|devo rifiutare|preferisco non)\b|\bnao (?:posso|podemos|vou|quero) (?:ajudar|responder|resolver|fornecer|tratar)\w*|\b(?:recuso|devo recusar|prefiro nao)\b",
        r"не (?:могу|буду) (?:помочь|ответить|решить|отвечать)|无法(?:回答|帮助|解决|提供)|不能(?:回答|帮助|解决|提供)",
    ]
)
)

#: Articles, pronouns, prepositions, conjunctions and auxiliaries of each language, on folded text.
FUNCTION_WORDS = {
    "en": "the a an of and or to in into is are was were be been it its for as with without this that these those we you he she they i me my your his her our their at by from has have had not no on what which who how many much if then than after before between about will would can could may must do does did there here where when why also so but up out over under per each any some all both more most such only",
    "fr": "le la les un une des du de et ou est sont etait etre il elle on nous vous ils elles je tu que qui quoi dont dans pour sur sous avec sans par plus moins ne pas ce cet cette ces son sa ses leur leurs mon ma mes votre notre au aux en donc mais si comme entre apres avant chez y l d s n c qu a ont avait combien quel quelle quels quelles aussi tout tous toute",
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren sein hat haben hatte wird werden zu zum zur mit ohne von vom fur auf in im nicht kein keine sich auch als an am bei aus nach vor wie viel viele wenn wir sie er es ich du ihr man dass davon damit dazu um durch uber unter zwischen doch aber so nur noch schon wo was wer welche welcher welches diese dieser dieses",
    "es": "el la los las un una unos unas de del al y o e es son era ser esta estan este esto esta estos estas ese esa que quien como cuando donde cuanto cuantos cuanta cuantas en con sin por para sobre entre desde hasta se su sus lo le les no si mas pero mi tu nos ha han habia hay muy tambien ya tras segun porque cada otro otra",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla e ed o e sono era essere ha hanno aveva che chi cui come quando dove quanto quanti in nel nella con senza per su sul tra fra si ci non piu ma se questo questa questi quello quella anche gia poi quindi",
    "pt": "o a os as um uma uns umas de do da dos das e ou em no na nos nas com sem por pelo pela para sobre entre ate que quem como quando onde quanto quantos se nao mais mas ao aos foi sao era ser esta este isto esse essa seu sua seus suas ele ela eles nos voce ja tambem muito ha tem depois",
    "nl": "de het een en of is zijn was waren wordt worden te om op in met zonder voor van naar door over onder tussen bij uit aan niet geen er ook als dan dat die dit deze wij we je jij hij zij ik u hun haar hoeveel wat wie waar wanneer nog maar want dus heeft hebben had",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_ANY_FUNCTION_WORD: dict[str, list[int]] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in set(_words.split()):
        _ANY_FUNCTION_WORD.setdefault(_w, []).append(_i)

#: Words that announce a result, on folded text, in Latin and other scripts; conclusions; and ends of proofs.
RESULT_WORDS = r"(?:answer|result|solution|reponse|resultat|solution|antwort|ergebnis|losung|respuesta|resultado|solucion|risposta|risultato|resposta|ответ|результат|答案|结果)"
CONCLUSION = re.compile(r"(?:therefore|hence|thus|so|consequently|somit|daher|folglich|ainsi|par consequent|por lo tanto|por tanto|quindi|dunque|portanto|logo)\b[^\d]*.*\d")
PROVED = re.compile(r"\b(?:completes|concludes|finishes) (?:the|this|our) proof\b|\bq ?\.? ?e ?\.? ?d\b|[∎□■]\s*$|\bwas to be (?:shown|proved|proven|demonstrated)\b|\bwas zu (?:zeigen|beweisen) war\b|\bce qu'il fallait demontrer\b|\bcqfd\b|\b(?:queda|como se queria) demostra\w+|\bcome volevasi dimostrare\b")

THINK = re.compile(r"</?think(?:ing)?\s*>", re.I)
FENCE = re.compile(r"```[A-Za-z]*")
#: Each search ends at the next sign of its own kind and gives nothing back, so that texts full of opening signs cost no more than others.
QUOTED = regex.compile(r"\"[^\"]*+\"|“[^”“]*+”|„[^“”„]*+[“”]|«[^»«]*+»|「[^」「]*+」")
FORMULA = re.compile(r"\$[^$]*+\$|\\\([^\\]*+(?:\\[^()][^\\]*+)*+\\\)|\\\[[^\\]*+(?:\\[^\[\]][^\\]*+)*+\\\]|\\[A-Za-z]++(?:\{[^{}]*+\})*+", re.S)
#: Signs after which a text may end, and signs that ask for more.
ENDS = ".!?…。！？:)]}\"”»'*`$>|"
ASKS = re.compile(r"(?:[,;(\[{=+\-−×·/&\\]|\\(?:times|cdot|frac|left|sqrt|text)\{?)\s*$")
SENTENCE = re.compile(r"[.!?。！？](?=\s|$)|\n")
BOX_OR_BRACE = re.compile(r"\\boxed\s*+\{|[{}]")
LABELLED = re.compile(RESULT_WORDS + r"\W{0,6}[:：]\W{0,6}[\d\\]")
STATED = re.compile(RESULT_WORDS + r"[^\n]{0,60}?\d")
SENTENCES = re.compile(r"(?<=[.!?])(?=[\s)*\"”]|$)|(?<=。)|\n")
SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in ("Latin", "Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Greek", "Hebrew", "Devanagari", "Thai")}

#: Scripts in which one sign stands for about three letters.
WIDE_SCRIPTS = {"Han", "Hiragana", "Katakana", "Hangul"}


def _plain(text: str) -> str:
    return FENCE.sub(" ", THINK.sub(" ", text))


def script_shares(text: str) -> dict[str, float]:
    if text.isascii():
        return {"Latin": 1.0} if any(c.isalpha() for c in text) else {}
    counts = {name: len(p.findall(text)) * (3 if name in WIDE_SCRIPTS else 1) for name, p in SCRIPTS.items()}
    total = sum(counts.values())
    return {name: n / total for name, n in counts.items() if n} if total else {}


class Languages:
    """Which language a text speaks: function words, and a model of letter triples for every language that enough were counted of."""

    def __init__(self, triples: dict[str, np.ndarray] | None = None, spoken: dict[str, int] | None = None):
        triples = triples or {}
        self.cost = np.zeros((len(LANGUAGES), SIZE**3))
        self.trained = np.array([triples.get(x, np.zeros(1)).sum() >= FEWEST_TRIPLES for x in LANGUAGES])
        for i in np.flatnonzero(self.trained):
            self.cost[i] = CharacterModel(triples[LANGUAGES[i]]).table.ravel()
        n = np.array([(spoken or {}).get(x, 0) for x in LANGUAGES], float)
        self.prior = np.log((n + 1) / (n + 1).sum())

    @staticmethod
    def triples(found: list[str]) -> np.ndarray:
        x = letter_numbers("\n\n" + "\n".join(found) + "\n").astype(np.int64)
        code = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
        return code[x[2:] + x[1:-1] > 0]

    @staticmethod
    def function_words(found: list[str]) -> np.ndarray:
        return np.bincount([i for w in found for i in _ANY_FUNCTION_WORD.get(w, ())], minlength=len(LANGUAGES))

    def told(self, found: list[str]) -> int:
        """The language that a text's function words tell beyond doubt, or -1."""
        hits = self.function_words(found)
        first, second = np.argsort(-hits, kind="stable")[:2]
        return int(first) if hits[first] >= max(TELLING_WORDS, 2 * hits[second]) else -1

    def fits(self, found: list[str]) -> np.ndarray:
        """How well each language fits, in nats; languages without a model are judged by function words alone, against those that have one."""
        fit = PER_FUNCTION_WORD * self.function_words(found)
        if self.trained.sum() > 1 and found:
            likely = -self.cost[:, self.triples(found)].sum(axis=1)
            fit = fit + np.where(self.trained, likely, likely[self.trained].max())
        return fit

    def differ(self, asked: list[str], said: list[str]) -> bool:
        """``said`` is clearly in another language than ``asked``; unknown where neither function words nor models tell that of ``asked``."""
        if not self.function_words(asked).any() and not self.trained.any():
            return False
        spoken = int((self.fits(asked) + self.prior).argmax())
        fit, hits = self.fits(said), self.function_words(said)
        best = int(fit.argmax())
        return best != spoken and fit[best] - fit[spoken] >= CLEARLY and hits[best] >= hits[spoken] + 2


UNTRAINED = Languages()


def prose_of(text: str, leave_out: set[str] = frozenset()) -> str:
    """A text without formulas and quotations, names given and identifiers."""
    return " ".join(w for w in FORMULA.sub(" ", QUOTED.sub(" ", _plain(text))).split() if w not in leave_out and "_" not in w)


def asked_words(question: str) -> list[str]:
    """What stands before a question's first colon tells its language, as a quoted message may follow."""
    asked = FORMULA.sub(" ", _plain(question))
    first = words(asked.split(":")[0])
    return first if any(w in _ANY_FUNCTION_WORD for w in first) else words(asked)


def other_language(question: str, answer: str, speech: Languages = UNTRAINED) -> bool:
    """Prose of another script, or clearly of another language; formulas and quotations say nothing."""
    asked = FORMULA.sub(" ", _plain(question))
    prose = prose_of(answer, {w for w in asked.split() if w[:1].isupper()})
    here, there = script_shares(prose), script_shares(asked)
    if here and there:
        main = max(there, key=there.get)
        if here.get(main, 0.0) < 0.5 and sum(here.values()) - here.get(main, 0.0) > 0.3:
            return True
    return speech.differ(asked_words(question), words(prose))


def _distance(a: list[str], b: list[str], most: int) -> int:
    """Edits of words that turn ``a`` into ``b``; more than ``most`` count as ``most`` + 1.

    For each number of edits the furthest word that each diagonal reaches, so that near copies take little more than one pass.
    """
    n, m = Counter(a), Counter(b)
    if max((n - m).total(), (m - n).total()) > most:
        return most + 1

    def along(i: int, k: int) -> int:
        while i < len(a) and i + k < len(b) and a[i] == b[i + k]:
            i += 1
        return i

    end = len(b) - len(a)
    reach = {0: along(0, 0)}
    for edits in range(most + 1):
        if reach.get(end, -1) >= len(a):
            return edits
        reach = {
            k: along(min(max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1), len(a), len(b) - k), k)
            for k in range(max(-edits - 1, -len(a)), min(edits + 1, len(b)) + 1)
        }
    return most + 1


def copies_question(question: str, answer: str) -> bool:
    """Nothing but the question: from its beginning on the answer repeats it, once or several times, with trifling edits and no new number."""
    asked, said = words(question), [w for w in words(_plain(answer)) if w not in FILLERS]
    asked = [w for w in asked if w not in FILLERS]
    if not asked or not said:
        return False
    known = set(asked)
    foreign = [w for w in said if w not in known]
    if len(foreign) > max(1, int(FOREIGN * len(said))) or any(w.isdigit() for w in foreign):
        return False
    times = max(1, round(len(said) / len(asked)))
    most = max(1, int(TRIFLING * len(asked) * times))
    return _distance(said, asked * times, most) <= most


def _nothing(found: list[str]) -> bool:
    return all(w in PLACEHOLDERS or w in FILLERS for w in found) or found == ["n", "a"]


def _folded(text: str) -> str:
    return " ".join(text.replace("’", "'").split())


def refuses(text: str) -> bool:
    return REFUSALS.search(_folded(fold(text))) is not None


def boxed(text: str) -> bool:
    """A \\boxed{} that is closed and holds something, whatever its length and the braces within."""
    opened: list[int] = []
    for m in BOX_OR_BRACE.finditer(text):
        if m[0] != "}":
            opened.append(m.end() if m[0] != "{" else -1)
        elif opened and (begin := opened.pop()) >= 0 and begin < m.start():
            return True
    return False


def _last_line(text: str) -> str:
    return text.rstrip().rpartition("\n")[2].strip()


def _last_sentence(text: str) -> str:
    """The last sentence of a text, whether it has an end or not."""
    line = _last_line(text)
    ends = [m.end() for m in SENTENCE.finditer(line) if m.end() < len(line)]
    return line[ends[-1] :].strip() if ends else line


def unclosed(text: str) -> bool:
    """A brace, bracket or quotation of the last line, or a formula, that is open at the end of the text."""
    line = _last_line(text)
    formula = all(x.replace("\\$", "").count("$") % 2 for x in (line, text))
    open_: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    for c in line.replace("\\$", ""):
        if c in "([{“«":
            open_.append(c)
        elif c in pairs and open_ and open_[-1] == pairs[c]:
            open_.pop()
    return "{" in open_ or (bool(open_) or formula) and line[-1:] not in ".!?。！？"


def breaks_off(text: str) -> bool:
    """Cut in the middle: an unclosed code fence or delimiter of the last line, or a last sentence that asks for more or has no end."""
    body = THINK.sub(" ", text).rstrip()
    line = _last_line(body)
    if body.count("```") % 2 or unclosed(body) or ASKS.search(line):
        return True
    if not line or line[-1] in ENDS or not line[-1].isalpha():
        return False
    last = _last_sentence(body)
    found = words(FORMULA.sub(" ", last))
    sentences = len(SENTENCE.findall(body))
    return bool(found) and sentences > 0 and (found[-1] in _ANY_FUNCTION_WORD and len(found[-1]) > 1 or len(found) >= 4 and not any(c.isdigit() for c in last))


def closes(solution: str, question: str = "") -> bool:
    """A closing statement of the result: boxed, labelled, stated to its end, concluded or proved; or a bare result, also after the question restated."""
    text = _plain(solution).strip()
    if question and text.startswith(question.strip()):
        text = text[len(question.strip()) :].strip()
    if boxed(text):
        return True
    folded = fold(text)
    if LABELLED.search(folded) or PROVED.search(folded):
        return True
    if any(x[-1:] in {".", "!", "?", "。"} and STATED.search(x) for x in SENTENCES.split(folded)):
        return True
    last = _last_sentence(folded)
    if last[-1:] in {".", "!", "。"} and CONCLUSION.match(last):
        return True
    prose = [w for w in words(FORMULA.sub(" ", text)) if not w.isdigit()]
    return len(prose) <= 2 and any(c.isdigit() for c in text) and text.count("$") % 2 == 0 and not text.endswith(("...", "…", "=", "+", "-", "\\times"))


def _derives(question: str, text: str) -> bool:
    """Numbers beside those of the question: something was worked out."""
    return bool({w for w in words(text) if w.isdigit()} - set(words(question)))


def solution_defects(problem: str | None, solution: str | None, speech: Languages = UNTRAINED) -> list[str]:
    """Triggered defects of a solution, in the order of DEFECTS.

    A copied question, a refusal and prose of a language in which no closing statement is known break off only where the
    text does; so does a refusal after something was worked out.
    """
    text, question = solution or "", problem or ""
    if _nothing(words(_plain(text))):
        return ["empty"]
    out, closed = [], closes(text, question)
    if copies_question(question, text):
        out.append("copies_question")
    if not closed and refuses(text):
        out.append("refusal")
    if question and other_language(question, text, speech):
        out.append("other_language")
    lacking = not closed and (not out or out == ["refusal"] and _derives(question, text))
    if lacking or "copies_question" not in out and breaks_off(text):
        out.append("truncated")
    return out


def _parse(body: str) -> tuple[bool, object]:
    if not body.startswith(("[", "{", '"', "'")):
        return False, None
    try:
        return True, json.loads(body)
    except (ValueError, RecursionError):
        pass
    try:
        return True, ast.literal_eval(body)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return False, None


def _calls_and_prose(value: object) -> tuple[int, list[str]]:
    """Number of calls (objects with a name and arguments), and the texts beside them."""
    calls, prose, stack = 0, [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            prose.append(x)
        elif isinstance(x, (list, tuple)):
            stack.extend(reversed(x))
        elif isinstance(x, dict):
            inner = x.get("function") if isinstance(x.get("function"), dict) else x
            name, arguments = inner.get("name"), inner.get("arguments", inner.get("parameters", inner.get("args")))
            if isinstance(name, str) and name and arguments is not None:
                calls += 1
            else:
                stack.extend(v for k, v in reversed(list(x.items())) if k not in ("name", "id", "type"))
    return calls, prose


TAG = re.compile(r"</?[A-Za-z_]\w*\s*>")
SPELLED_CALL = re.compile(r"[\[\s,;]*[A-Za-z_][\w.]*\(")


def spans(text: str) -> tuple[list[tuple[int, int]], list[str], bool]:
    """Outermost bracketed parts, quoted strings, and whether a bracket or a string is open at the end. One pass.

    An apostrophe opens a string only after a bracket, comma, colon or equals sign, and closes it only before one.
    """
    open_: list[tuple[str, int]] = []
    found, strings = [], []
    quote, begin, before, i = "", 0, "", 0
    closing = {")": "(", "]": "[", "}": "{"}
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote and (c == '"' or text[i + 1 : i + 40].lstrip()[:1] in "" or text[i + 1 : i + 40].lstrip()[:1] in "]}),:"):
                strings.append(text[begin:i])
                quote, before = "", c
        elif c == '"' or c == "'" and before in "[{(,:=":
            quote, begin = c, i + 1
        elif c in "([{":
            open_.append((c, i))
            before = c
        elif c in closing:
            if open_ and open_[-1][0] == closing[c]:
                _, at = open_.pop()
                if not open_:
                    found.append((at, i + 1))
            before = c
        elif not c.isspace():
            before = c
        i += 1
    if quote:
        strings.append(text[begin:])
    return found, strings, bool(open_ or quote)


def call_defects(query: str | None, answers: str | None, speech: Languages = UNTRAINED) -> list[str]:
    """Triggered defects of function calls, in the order of DEFECTS. Answers that hold prose alone make no call.

    Calls may be JSON (one value, or several after each other or within prose), Python literals, or spelled as in a
    program, each within tags or fences. Of what cannot be read, the strings are the prose.
    """
    text, question = answers or "", query or ""
    if _nothing(words(_plain(text))):
        return ["empty"]
    body = TAG.sub(" ", FENCE.sub("", THINK.sub("", text))).strip()
    parsed, value = _parse(body)
    begun = cut = False
    if parsed:
        calls, prose = _calls_and_prose(value)
    else:
        parts, strings, open_ = spans(body)
        begun = body.startswith(("[", "{")) or bool(SPELLED_CALL.match(body))
        cut = begun and open_
        read = [_parse(body[a:b]) for a, b in parts]
        calls = sum(_calls_and_prose(v)[0] for ok, v in read if ok)
        if not calls and SPELLED_CALL.match(body) and not open_:
            calls = 1
        prose = [x for x in strings if len(x.split()) > 2] if begun else [body]
    if calls and not cut:
        return []
    said = "\n".join(prose)
    silent = _nothing(words(_plain(said)))
    out = []
    if silent and not begun:
        return ["empty"]
    if not silent and not calls:
        if copies_question(question, said) and not cut:
            out.append("copies_question")
        if refuses(said) and not cut:
            out.append("refusal")
        if question and other_language(question, said, speech) and not cut:
            out.append("other_language")
    if cut or begun and not out:
        out.append("truncated")
    return out or ["empty"]


RULES: dict[str, Callable[[str | None, str | None, Languages], list[str]]] = {"solution": solution_defects, "calls": call_defects}


def train_languages(pairs: DataFrame) -> Languages:
    """Letter triples of all questions and answers whose function words tell their language; questions tell how often each is spoken.

    Counts by language and triple reach the driver, whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LANGUAGES) * SIZE**3, np.int64)
        spoken = np.zeros(len(LANGUAGES), np.int64)
        for batch in batches:
            for column in ("question", "answer"):
                for text in batch.column(column).to_pylist():
                    found = words(prose_of(text)) if text else []
                    if (lang := UNTRAINED.told(found)) >= 0:
                        spoken[lang] += column == "question"
                        np.add.at(total, lang * SIZE**3 + Languages.triples(found), 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([there, -1 - np.arange(len(spoken))])), pa.array(np.concatenate([total[there], spoken]))], ["code", "n"])

    total = np.zeros(len(LANGUAGES) * SIZE**3, np.int64)
    spoken: dict[str, int] = {}
    for row in pairs.select("question", "answer").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        if row["code"] < 0:
            spoken[LANGUAGES[-1 - row["code"]]] = row["n"]
        else:
            total[row["code"]] = row["n"]
    return Languages(dict(zip(LANGUAGES, total.reshape(len(LANGUAGES), -1))), spoken)


def pair_defects(pairs: DataFrame) -> DataFrame:
    """Triggered defects of ``pairs`` (source_table, row_id, kind ``solution`` or ``calls``, question, answer): one row each.

    Columns source_table, row_id, defect, priority (1 for the one that names the pair). A null or empty answer is
    ``empty``; a null question only leaves the rules out that compare with it; repeated rows are judged alike; texts
    are read whole. Sound pairs have no row.
    """
    chosen = pairs.select("source_table", "row_id", "kind", "question", "answer")
    speech = pairs.sparkSession.sparkContext.broadcast(train_languages(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, ids, kinds, questions, answers = (batch.column(c).to_pylist() for c in ("source_table", "row_id", "kind", "question", "answer"))
            rows = [(t, i, d, p) for t, i, k, q, a in zip(table, ids, kinds, questions, answers) for p, d in enumerate(RULES[k](q, a, speech.value), 1)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())],
                ["source_table", "row_id", "defect", "priority"],
            )

    return chosen.mapInArrow(run, "source_table string, row_id bigint, defect string, priority int")
