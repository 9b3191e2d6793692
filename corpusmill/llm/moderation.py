"""Problem 7: abusive, hateful and sexual passages, also when spelled to escape a word list.

Noisy channel: what a writer meant is decoded from what stands there. Every token becomes a lattice of characters, in
which a sign may stand for a letter it looks like, for any letter, or for none, a letter may repeat the one before, and
two neighbours may be swapped, each at a cost; Viterbi search finds the cheapest reading under a character model of
the corpus and the labelled sentences. The restored passages are scored by how much better word models of the labelled
classes explain them than the words of the corpus at large do. All that the scorer knows comes from the labelled
sentences, the term list and the counts of the corpus; every passage of every text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.concepts import CONCEPTS, Concepts
from corpusmill.llm.textnorm import LONGEST_KEPT, fold
from corpusmill.llm.tokens import clean_source

#: Labelled sentences that the model is fitted on at most; the first by id, should there be more.
MOST_SAMPLES = 50_000
#: Listed terms that a worker is given; a longer list is refused, not cut.
MOST_TERMS = 1_000_000
#: A document counts where its worst passage scores at least this.
THRESHOLD = 0.5
#: Words of a longer sentence that are scored at a time, each half of them anew; unmarked sentence ends would hide a passage else.
WINDOW = 14
CLASSES = ("clean", "abusive", "hateful", "sexual")

#: Signs that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "$": "s", "@": "a", "!": "i", "|": "il", "€": "e", "£": "l", "¢": "c", "+": "t", "(": "c", "¡": "i", "§": "s", "ß": "s",
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "һ": "h", "ԛ": "q", "ԝ": "w", "ь": "b", "г": "r", "я": "r",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "đ": "d", "ł": "l", "æ": "a", "œ": "o",
}
#: Signs that may hide any letter, and signs that may be thrown in between letters.
HIDES = set("*#%?_~^•")
NOISE = set("-*._~'’`·|,!#%^+/\\:;?•")
#: Costs (negative log probabilities) of the channel.
SAME, LOOKS, HIDDEN, DROPPED, REPEATED, SWAPPED = 0.0, 0.5, 1.0, 0.8, 0.4, 4.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIZE = len(LETTERS) + 1
#: A known word is read where it costs at most so much more than the cheapest reading of all; words not in use are many, each of them rare.
KNOWN_MARGIN = 8.0
#: Spellings that a worker remembers before it starts over; they only save time.
MEMO_CHUNKS = 300_000
#: Words whose passages are scored together, with those that end their text.
BLOCK_WORDS = 8_192
#: Share of passages that are expected to offend, before a word is read.
PRIOR = 0.001
#: Words of a phrase come together; each counts as this part of an independent one.
INDEPENDENCE = 0.5
#: Parts of a passage that a class may account for; the rest are words of the corpus at large. The likeliest is taken.
PARTS = (0.1, 0.3, 0.6)
#: Share of an offending class's words that are those of any offending class: a threat may name a group, an insult a body.
MIXED = 0.5
#: A word's share in the use of its concept is at most so many times that in the corpus.
MOST_SHARE = 10.0
#: Smoothing: what a word is taken to occur beyond its count, in a language of so many words.
PSEUDO_COUNT, WORD_TYPES = 0.3, 100_000
#: Letters at the beginning that words not in the labelled sentences are known by, if they stand there in other words.
STEM = 5
NUMBER = "<n>"


#: Letters that decomposition leaves whole.
LIGATURES = {"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}
_LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")


def plain_letters(text: str) -> str:
    return fold(text) if text.isascii() else _LIGATURE.sub(lambda m: LIGATURES[m[0]], fold(text))


class CharacterModel:
    """Trigrams of letters with a word edge (0), smoothed by bigrams and unigrams."""

    def __init__(self, trigrams: np.ndarray):
        tri = trigrams.reshape(SIZE, SIZE, SIZE).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni + 1).sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 3 * p2[None]) / (tri.sum(2, keepdims=True) + 3)
        self.table = -np.log(p3)
        self.cost = self.table.tolist()


_LETTER_NUMBERS = bytes(b - 96 if 97 <= b <= 122 else 0 for b in range(256))


def letter_numbers(folded: str) -> np.ndarray:
    """Letters 1-26, all else 0."""
    return np.frombuffer(folded.encode("ascii", "replace").translate(_LETTER_NUMBERS), np.uint8)


def count_trigrams(texts: Iterable[str | None], weight: int = 1, folded: bool = False) -> np.ndarray:
    total = np.zeros(SIZE**3, np.int64)
    held, size = [], 0

    def flush() -> None:
        x = letter_numbers("\n\n" + "\n\n".join(held) + "\n").astype(np.uint16)
        code = x[:-2] * np.uint16(SIZE * SIZE) + x[1:-1] * np.uint16(SIZE) + x[2:]
        np.add(total, np.bincount(code, minlength=SIZE**3) * weight, out=total)

    for text in texts:
        if text:
            held.append(text if folded else plain_letters(text))
            size += len(held[-1])
            if size > 60_000:
                flush()
                held, size = [], 0
    if held:
        flush()
    total[:: SIZE * SIZE] = 0  # runs of blanks say nothing
    return total


def _readings(c: str) -> dict[int, float]:
    """Letters that a character may stand for, and their costs."""
    options = dict.fromkeys(range(1, SIZE), HIDDEN) if c in HIDES else {}
    options |= {ord(x) - 96: LOOKS for x in LOOKALIKES.get(c, "")}
    return options | ({ord(c) - 96: SAME} if c in LETTERS else {})


_OPTIONS = {c: _readings(c) for c in {*HIDES, *LOOKALIKES, *LETTERS}}


class Words:
    """The known words as a trie. A node stands for one beginning, so that it is the whole state of a search."""

    def __init__(self, known: Iterable[str]):
        self.child: list[dict[int, int]] = [{}]
        self.final = [False]
        self.read = [""]
        self.last = [(0, 0)]  # numbers of the last two letters
        for word in sorted(known):
            node = 0
            for c in word:
                x = ord(c) - 96
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.final.append(False)
                    self.read.append(self.read[node] + c)
                    self.last.append((self.last[node][1], x))
                node = self.child[node][x]
            self.final[node] = True
        self.longest = max(map(len, self.read))


_SIGNS = re.compile("[" + re.escape("".join(sorted(HIDES | (NOISE - LOOKALIKES.keys())))) + "]{2,}")


def shorten(token: str, longest: int) -> str:
    """A token without signs that a word of ``longest`` letters can but drop: which signs of a run are dropped makes no difference to what is read."""

    def cut(m: re.Match) -> str:
        hiding = [c for c in m[0] if c in HIDES][:longest]
        return "".join(([] if len(hiding) == len(m[0]) else ["-"]) + hiding)

    return _SIGNS.sub(cut, token)


def _exact(token: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else 0 for c in token]


def decode(token: str, model: CharacterModel, words: Words) -> tuple[float, str] | None:
    """Cheapest reading of one token that is one of ``words``, and its cost: Viterbi search along the lattice of its characters.

    Exact; the trie bounds the states. None where no reading is a known word.
    """
    cost3, child, last = model.cost, words.child, words.last
    states: list[dict[int, float]] = [{} for _ in range(len(token) + 2)]
    states[0][0] = 0.0
    exact = _exact(token)
    for i, c in enumerate(token):
        here = states[i]
        if not here:
            if not states[i + 1]:
                return None  # no known word begins so
            continue
        states[i] = {}
        options = _OPTIONS.get(c, {})
        drop, repeat = c in NOISE or not options, exact[i] if exact[i] and i and token[i - 1] == c else -1
        swap = i + 1 < len(token) and exact[i] and exact[i + 1] and exact[i] != exact[i + 1]
        after, later = states[i + 1], states[i + 2]
        for node, cost in here.items():
            a, b = last[node]
            row, onward = cost3[a][b], child[node]
            for x in onward.keys() & options.keys():
                to, total = onward[x], cost + options[x] + row[x]
                if total < after.get(to, math.inf):
                    after[to] = total
            if drop and cost + DROPPED < after.get(node, math.inf):
                after[node] = cost + DROPPED
            if repeat == b and cost + REPEATED < after.get(node, math.inf):
                after[node] = cost + REPEATED
            if swap and (x := exact[i + 1]) in onward and (y := exact[i]) in child[onward[x]]:
                to, total = child[onward[x]][y], cost + SWAPPED + row[x] + cost3[b][x][y]
                if total < later.get(to, math.inf):
                    later[to] = total
    ends = [(cost + cost3[last[n][0]][last[n][1]][0], words.read[n]) for n, cost in states[len(token)].items() if words.final[n]]
    return min(ends, default=None)


def cheapest(token: str, model: CharacterModel) -> float:
    """Cost of the cheapest reading of one token, whether it is a word or not. A state is the last two letters; all are kept."""
    table = model.table
    exact = _exact(token)
    nowhere = np.full((SIZE, SIZE), np.inf)
    here, after = nowhere.copy(), nowhere.copy()
    here[0, 0] = 0.0
    for i, c in enumerate(token):
        later = nowhere.copy()
        options = _OPTIONS.get(c, {})
        if len(options) > 3:
            x = np.fromiter(options, int)
            reached = (here[:, :, None] + table[:, :, x]).min(axis=0) + np.fromiter(options.values(), float)
            after[:, x] = np.minimum(after[:, x], reached)
        else:
            for x, extra in options.items():
                after[:, x] = np.minimum(after[:, x], (here + table[:, :, x]).min(axis=0) + extra)
        if c in NOISE or not options:
            after = np.minimum(after, here + DROPPED)
        if exact[i] and i and token[i - 1] == c:
            after[:, exact[i]] = np.minimum(after[:, exact[i]], here[:, exact[i]] + REPEATED)
        if i + 1 < len(token) and exact[i] and exact[i + 1] and exact[i] != exact[i + 1]:
            x, y = exact[i + 1], exact[i]
            first = (here + table[:, :, x]).min(axis=0)
            later[x, y] = min(later[x, y], (first + table[:, x, y]).min() + SWAPPED)
        here, after = after, later
    here = here + table[:, :, 0]
    here[0, 0] = np.inf  # nothing was read
    return float(here.min())


#: A line end as a chunk of its own; a private sign, which no text means.
LINE_END = " \ue000 "
#: Signs that do not belong to a word, before and after it.
BEFORE, AFTER = "\"“”„«»‘’‚'([{<>", "\"“”«»‘’'‚)]}<>,;:"
PLAIN = re.compile(r"[a-z]+")
PIECES = re.compile(r"[a-z]+|\d+")
#: Interjections that end a sentence as a full stop would.
TAILS = {"lol", "lmao", "rofl", "haha", "xd", "smh", "wtf", "omg", "jaja", "mdr", "ptdr"}
SENTENCE_END = re.compile(r"[.!?…][\"“”»'’)\]]*$")


class Token(NamedTuple):
    """What a chunk of text contributes; found once for every spelling."""

    words: list[str]
    letter: str  # the letter, if the chunk is a single one
    begins: bool  # its one word begins, but is not, a known word
    ends: bool  # its one word ends, but is not, a known word
    closes: bool
    plain: bool  # none of the above
    line: bool = False  # a line end, and no chunk


class Tokens(dict):
    """chunk -> ``Token``, filled as chunks turn up."""

    def __init__(self, find: Callable[[str], Token]):
        super().__init__()
        self.find = find

    def __missing__(self, chunk: str) -> Token:
        value = self.find(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) > MEMO_CHUNKS:
                self.clear()
            self[chunk] = value
        return value


class Restorer:
    """Sentences of a text as restored words. ``known`` are the words that the scorer can use; nothing else is worth restoring."""

    def __init__(self, model: CharacterModel, known: set[str]):
        self.model, self.known, self.words = model, known, Words(known)
        self.letters = {frozenset(w) for w in known}
        self.longest = max(map(len, known), default=0)
        self.heads = {w[:i] for w in known for i in range(2, len(w))}
        self.tails = {w[i:] for w in known for i in range(1, len(w))}
        self.memo = Tokens(self.token)

    def read(self, core: str) -> list[str]:
        """Words of a chunk without its edges: as they stand, or as decoded where that gives a known word."""
        plain = PIECES.findall(core)
        if len(plain) == 1 and plain[0] == core and (core in self.known or core.isdigit()):
            return plain
        if len(core) >= 3 and any(c.isalpha() for c in core):
            bare = core.rstrip(".!?…")
            if bare not in self.known and (not PLAIN.fullmatch(bare) or frozenset(bare) in self.letters):
                for attempt in dict.fromkeys((bare, core.rstrip(".?…"))):
                    attempt = shorten(attempt, self.words.longest)
                    read = decode(attempt, self.model, self.words)
                    if read and read[0] <= cheapest(attempt, self.model) + KNOWN_MARGIN:
                        return [read[1]]
        return plain

    def token(self, chunk: str) -> Token:
        if chunk == LINE_END[1]:
            return Token([], "", False, False, False, False, line=True)
        core = chunk.lstrip(BEFORE).rstrip(AFTER)
        got = self.read(core)
        bare = core.rstrip(".!?…")
        letter = bare if len(bare) == 1 and bare.isalpha() else ""
        one = got[0] if len(got) == 1 and not letter else ""
        begins, ends = one in self.heads, one in self.tails
        shout = core.endswith("!") and any(c in LOOKALIKES and not c.isalpha() for c in core[:-1])
        closes = bare in TAILS or bool(SENTENCE_END.search(chunk)) and not shout
        return Token(got, letter, begins, ends, closes, not (letter or begins or ends or closes))

    def sentences(self, text: str | None) -> Iterator[list[str]]:
        """Sentences end at their marks, at interjections and at line ends, unless a word runs on across the line."""
        if not text:
            return
        known = self.known
        now: list[str] = []
        spelled: list[str] = []
        cut = begun = False
        for token in map(self.memo.__getitem__, plain_letters(text).replace("\n", LINE_END).split()):
            if token.plain and not cut and not spelled:
                now += token.words
                begun = False
                continue
            if token.line:
                cut = True
                continue
            if spelled and not token.letter:
                self._spelled(now, spelled)
                spelled = []
            tail = token.letter or (token.words[0] if token.ends else "")
            if now and tail and (begun or now[-1] in self.heads) and now[-1] + tail in known and not (now[-1] in known and tail in known) and not spelled:
                now[-1] += tail
                cut = begun = False
            else:
                if cut and now:
                    yield now
                    now, spelled = [], []
                cut = False
                if token.letter:
                    spelled.append(token.letter)
                now += token.words
                begun = token.begins
            if token.closes:
                if spelled:
                    self._spelled(now, spelled)
                    spelled = []
                if now:
                    yield now
                now, begun = [], False
        if spelled:
            self._spelled(now, spelled)
        if now:
            yield now

    def _spelled(self, now: list[str], spelled: list[str]) -> None:
        """Letters set apart by spaces become the known words that they spell, longest first."""
        if len(spelled) < 3 or now[-len(spelled) :] != spelled:
            return
        del now[-len(spelled) :]
        at = 0
        while at < len(spelled):
            for n in range(min(self.longest, len(spelled) - at), 0, -1):
                word = "".join(spelled[at : at + n])
                if n == 1 or word in self.known:
                    now.append(word)
                    at += n
                    break


class Lexicon:
    """What a word may be known by: itself, the category of a listed term that it is or extends, its concept, or its beginning. Each is a row of counts."""

    def __init__(self, samples: list[tuple[str, str]], terms: list[tuple[str, str, int | None]]):
        listed = [(plain_letters(t).strip(), c.strip().lower()) for t, c, _ in terms if t and t.strip() and c and c.strip().lower() in CLASSES[1:]]
        found = Counter(w for text, _ in samples for w in set(PIECES.findall(plain_letters(text))))
        self.terms = dict(sorted(listed))
        #: Worth restoring: words of several samples and of the listed terms.
        self.known = {w for w, n in found.items() if n >= 2 and not w.isdigit()} | {w for t, _ in listed for w in PIECES.findall(t) if not w.isdigit()}
        own = sorted({w for w in found if not w.isdigit()} | self.known)
        self.concepts = Concepts()
        stems = sorted({f"~{w[:STEM]}" for w in own if len(w) >= STEM})
        own = sorted({*own, *self.concepts})
        self.row = {key: i for i, key in enumerate([NUMBER, *own, *(f"={c}" for c in CLASSES[1:]), *(f"@{c}" for c in CONCEPTS), *stems])}

    def category(self, word: str) -> str | None:
        """Category of the listed term that the word is, with an ending of up to half its length."""
        for n in range(len(word), max(2, math.ceil(len(word) / 1.5) - 1), -1):
            if word[:n] in self.terms and len(word) - n <= max(1, n // 2):
                return self.terms[word[:n]]
        return None

    def rows(self, word: str) -> tuple[int, int, int, int]:
        """Rows of the word itself, of its category, of its concept and of its beginning; -1 for none."""
        if word.isdigit():
            return self.row[NUMBER], -1, -1, -1
        category, concept = self.category(word), self.concepts.of(word)
        return self.row.get(word, -1), self.row[f"={category}"] if category else -1, self.row[f"@{concept}"] if concept else -1, self.row.get(f"~{word[:STEM]}", -1) if len(word) >= STEM else -1


class WordRows(dict):
    """word -> ``Lexicon.rows``, filled as words turn up."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = self.lexicon.rows(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) > MEMO_CHUNKS:
                self.clear()
            self[word] = value
        return value


class WordIndex(dict):
    """word -> the row that ``Scorer`` scores it by, filled as words turn up."""

    def __init__(self, rows: WordRows, index: Callable[[tuple[int, ...]], int]):
        super().__init__()
        self.rows, self.index = rows, index

    def __missing__(self, word: str) -> int:
        value = self.index(self.rows[word])
        if len(word) <= LONGEST_KEPT:
            if len(self) > MEMO_CHUNKS:
                self.clear()
            self[word] = value
        return value


class Scorer:
    """Log odds of passages. A class's words mix with those of the corpus; the corpus alone, or the clean class, has to explain a passage worse.

    ``background``: for each row of the lexicon how often it was met in the corpus, of ``total`` words.
    """

    def __init__(self, lexicon: Lexicon, rows: list[tuple[list[str], int]], background: np.ndarray, total: int):
        counts = np.zeros((len(lexicon.row), len(CLASSES)))
        words = np.zeros(len(CLASSES))
        for found, label in rows:
            words[label] += len(found)
            for w in found:
                for r in lexicon.rows(w):
                    if r >= 0:
                        counts[r, label] += 1
        at_large = ((background + PSEUDO_COUNT) / (total + PSEUDO_COUNT * WORD_TYPES))[:, None]
        ratio = (counts + at_large) / (words + 1) / at_large
        seen = counts.sum(axis=1)
        likes = {r: [like for like in lexicon.rows(key)[1:3] if like >= 0 and seen[like]] for key, r in lexicon.row.items() if key[0] not in "=~@<"}
        share = self._shares(lexicon, background, at_large[:, 0])
        for r, like in likes.items():  # a rare word of a listed category or a concept says at least what they do
            if like and seen[r] < 3:
                of = ratio[like[0]] * share[r]
                ratio[r] = np.maximum(ratio[r], of) if seen[r] else of
        ratio[[r for key, r in lexicon.row.items() if seen[r] < (2 if key[0] == "~" else 1) and not likes.get(r)]] = 0
        ratio[:, 1:] = (1 - MIXED) * ratio[:, 1:] + MIXED * ratio[:, 1:].mean(axis=1, keepdims=True)
        self.usable = ratio.any(axis=1)
        known = np.concatenate([ratio, np.zeros((1, len(CLASSES)))])  # the last row is that of other words
        parts = np.array(PARTS)[:, None]
        #: (row, part, class): what a word adds to the log likelihood over that of the corpus.
        self.gain = np.log(parts * known[:, None, :] + 1 - parts)
        self.other = len(ratio)
        self.prior = math.log(PRIOR / (1 - PRIOR))

    @staticmethod
    def _shares(lexicon: Lexicon, background: np.ndarray, at_large: np.ndarray) -> np.ndarray:
        """How much oftener than in the corpus a class uses a word of a concept, beside the concept as a whole: half of a concept's use falls on its words alike."""
        share = np.ones(len(lexicon.row))
        members: dict[int, list[int]] = {}
        for key, r in lexicon.row.items():
            if key[0] not in "=~@<" and background[r]:
                _, category, concept, _ = lexicon.rows(key)
                if concept >= 0 > category:
                    members.setdefault(concept, []).append(r)
        for own in members.values():
            share[own] = np.minimum(0.5 + 0.5 * at_large[own].mean() / at_large[own], MOST_SHARE)
        return share

    def index(self, rows: tuple[int, ...]) -> int:
        """The row that a word is scored by."""
        return next((r for r in rows if r >= 0 and self.usable[r]), self.other)

    def __call__(self, index: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and classes of the passages from ``start`` to ``end`` of a text of words scored by the rows ``index``."""
        length = end - start
        first = np.cumsum(length) - length
        words = index[np.arange(length.sum()) + np.repeat(start - first, length)]  # passage by passage; each is summed on its own, whatever stands around it
        gain = self.gain.reshape(len(self.gain), -1)
        z = np.add.reduceat(gain.take(words, axis=0), first, axis=0).reshape(-1, *self.gain.shape[1:]).max(axis=1)
        offending = z[:, 1:].max(axis=1)
        odds = offending + np.log(np.exp(z[:, 1:] - offending[:, None]).sum(axis=1)) - np.logaddexp(z[:, 0], 0.0)
        return 1 / (1 + np.exp(-np.clip(odds * INDEPENDENCE + self.prior, -500, 500))), z[:, 1:].argmax(axis=1) + 1


def passages(length: int) -> list[tuple[int, int]]:
    """Parts of a sentence of so many words that are scored: the whole, or windows that overlap by half."""
    if length <= WINDOW + 2:
        return [(0, length)]
    return [(i, min(i + WINDOW, length)) for i in range(0, length - WINDOW // 2, WINDOW // 2)]


class Moderator:
    """Everything a worker needs to score a text."""

    def __init__(self, trigrams: np.ndarray, samples: list[tuple[str, str]], terms: list[tuple[str, str, int | None]], background: np.ndarray | None = None, total: int = 0):
        lexicon = Lexicon(samples, terms)
        own = count_trigrams([text for text, _ in samples] + [plain_letters(t) for t, _, _ in terms if t])
        weight = max(1, int(trigrams.sum() // max(own.sum(), 1)) // 4)  # the labelled words weigh a quarter of the corpus
        self.restorer = Restorer(CharacterModel(trigrams + own * weight), lexicon.known)
        rows = [([w for s in self.restorer.sentences(text) for w in s], CLASSES.index(label)) for text, label in samples if label in CLASSES]
        self.scorer = Scorer(lexicon, rows, np.zeros(len(lexicon.row)) if background is None else background, total)
        self.rows = WordRows(lexicon)
        self.index = WordIndex(self.rows, self.scorer.index)

    def text(self, text: str | None) -> tuple[float, str, int]:
        """Score and class of the worst passage, and the number of sentences at or above the threshold."""
        return self.texts([text])[0]

    def texts(self, texts: Iterable[str | None]) -> list[tuple[float, str, int]]:
        """``text`` of each; passages of several texts are scored together."""
        judged: list[tuple[float, str, int]] = []
        index: list[int] = []
        start: list[int] = []
        end: list[int] = []
        sentence: list[int] = []
        held: list[int] = []  # passages up to the end of each text that waits
        row = self.index.__getitem__

        def flush() -> None:
            score, label = self.scorer(np.array(index), np.array(start), np.array(end)) if start else (np.empty(0), np.empty(0, int))
            lo = 0
            for hi in held:
                if lo == hi:
                    judged.append((0.0, "clean", 0))
                    continue
                own = score[lo:hi]
                worst = int(own.argmax())
                over = len({sentence[lo + i] for i in np.flatnonzero(own >= THRESHOLD)}) if own[worst] >= THRESHOLD else 0
                judged.append((float(own[worst]), CLASSES[label[lo + worst]], over))
                lo = hi
            for kept in (index, start, end, sentence, held):
                kept.clear()

        for text in texts:
            at = len(index)
            for n, found in enumerate(self.restorer.sentences(text)):
                index += map(row, found)
                length = len(index) - at
                for lo, hi in ((0, length),) if length <= WINDOW + 2 else passages(length):
                    start.append(at + lo)
                    end.append(at + hi)
                    sentence.append(n)
                at += length
            held.append(len(start))
            if at > BLOCK_WORDS:
                flush()
        flush()
        return judged


def corpus_counts(documents: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, int]:
    """Letter trigrams of all texts, how often each row of the lexicon is met in them, and their words.

    Each partition counts on its own; the sums that reach the driver are as many as there are trigrams and rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(shared.value)
        size = SIZE**3 + len(shared.value.row) + 1
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = [plain_letters(text) for text in batch.column("text").to_pylist() if text]
            total[: SIZE**3] += count_trigrams(texts, folded=True)
            chunks: Counter[str] = Counter()
            for text in texts:
                chunks.update(text.split())
            met: Counter[str] = Counter()
            for chunk, n in chunks.items():
                for word in PIECES.findall(chunk):
                    met[word] += n
            for word, n in met.items():
                total[-1] += n
                for r in rows[word]:
                    if r >= 0:
                        total[SIZE**3 + r] += n
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["code", "n"])

    total = np.zeros(SIZE**3 + len(lexicon.row) + 1, np.int64)
    for row in documents.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[row["code"]] = row["n"]
    return total[: SIZE**3], total[SIZE**3 : -1], int(total[-1])


def moderate(documents: DataFrame, samples: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, score in [0, 1], category, passages (sentences at or above THRESHOLD).

    Null, blank and wordless texts score 0 as ``clean``; repeated rows are scored alike; texts of any length are read
    whole; a null source becomes ``unknown``; terms without text or with an unknown category and samples without text or
    with an unknown label are left out; a list of more than MOST_TERMS terms is refused. The model is fitted on at most
    MOST_SAMPLES labelled sentences; letters and words are counted over all documents.
    """
    spark = documents.sparkSession
    labelled = samples.where("text is not null and label is not null").orderBy("sample_id", "text").limit(MOST_SAMPLES).select("text", "label").collect()
    listed = terms.select("term", "category", "severity").distinct().orderBy("term", "category", "severity").limit(MOST_TERMS + 1).collect()
    if len(listed) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms are listed")
    fitted, terms_ = [(r[0], r[1].strip().lower()) for r in labelled], [tuple(r) for r in listed]
    trigrams, background, total = corpus_counts(documents, Lexicon(fitted, terms_))
    moderator = Moderator(trigrams, fitted, terms_, background, total)
    shared = spark.sparkContext.broadcast(moderator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            scored = judge.texts(batch.column("text").to_pylist())
            score, label, over = zip(*scored) if scored else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(score, pa.float64()), pa.array([c if s >= THRESHOLD else "clean" for s, c in zip(score, label)], pa.string()), pa.array(over, pa.int32())],
                ["doc_id", "source", "score", "category", "passages"],
            )

    chosen = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    return chosen.mapInArrow(run, "doc_id bigint, source string, score double, category string, passages int")


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, those at or above THRESHOLD, and their rate, in all and by category."""
    hit = F.col("score") >= THRESHOLD
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(hit).alias("n_flagged"), (F.count_if(hit) / F.count(F.lit(1))).alias("rate"),
        *[F.count_if(hit & (F.col("category") == c)).alias(f"n_{c}") for c in CLASSES[1:]],
    )
