"""Word normalisation and hashing shared by the text operators. Runs inside Arrow batches on the executors."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
import xxhash

#: Characters that carry no text.
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")
WORD = re.compile(r"[^\W_]+")
MARKS = regex.compile(r"\p{M}+")
#: ASCII letters in lower case, digits, and a space for anything else.
ASCII_WORDS = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Words kept in a worker's table of hashes before it is emptied; it only saves time.
MEMO_WORDS = 400_000
#: Longer words are hashed anew each time, so that the table stays small.
LONGEST_KEPT = 64


def fold(text: str) -> str:
    """Compatibility-decomposed lower case without invisible characters and combining marks."""
    if text.isascii():
        return text.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", INVISIBLE.sub("", text)).lower())


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text; none for a null."""
    if not text:
        return []
    if not text.isascii():
        text = fold(text)
        if not text.isascii():
            return WORD.findall(text)
    return text.encode().translate(ASCII_WORDS).decode().split()


class WordHashes(dict):
    """word -> 64-bit hash, filled as words turn up."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Texts that ``shingle_sets`` takes at once; an element keeps the 53 bits that are left beside a text's number.
SHINGLE_TEXTS = 2_048


def shingle_sets(texts: list[list[str]], size: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 53-bit hashes of ``size`` successive words, of the words of at most ``SHINGLE_TEXTS`` texts together.

    Returns (doc, hash), sorted by both; a text of fewer words has none.
    """
    flat: list[int] = []
    get = memo.__getitem__
    for found in texts:
        flat.extend(map(get, found))
    counts = list(map(len, texts))
    if len(flat) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, n = np.array(flat, dtype=np.uint64), np.array(counts, dtype=np.int64)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    last = len(h) - size + 1
    with np.errstate(over="ignore"):
        s = h[:last].copy()
        for k in range(1, size):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
            s += h[k : last + k]
        s = mix64(s)
    whole = doc[:last] == doc[size - 1 :]
    key = np.sort((doc[:last] << np.uint64(53) | s >> np.uint64(11))[whole])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(53)).astype(np.int64), key & np.uint64((1 << 53) - 1)


def distinct_pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]
