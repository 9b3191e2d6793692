"""Problem 6: evaluation passages in training text, by greedy string tiling.

The evaluation texts are cut into seeds of ``least`` successive words, kept by their running Karp-Rabin hash. Every
document is hashed the same way in one pass; seeds it shares with an item are joined into maximal common runs, and the
longest runs that do not overlap tiles marked before become the next tiles, until none of ``least`` words is left. The
tiles cover an item's words in whatever order its passages appear.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.textnorm import words

#: Successive words that make a passage.
LEAST = 13
#: Words of evaluation texts that are broadcast at a time (about 30 MB as an index); more come in further passes.
WORDS_PER_PASS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """word -> number from 1, of the evaluation texts' words; 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


def rolling_hashes(numbers: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of every run of ``least`` numbers."""
    n = len(numbers) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(least):
            h = h * BASE + numbers[k : n + k]
    return h


@dataclass
class SeedIndex:
    """Seeds of the evaluation texts, sorted by hash."""

    least: int
    number: Numbers = field(default_factory=Numbers)
    items: list[int] = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)

    def add(self, item: int, text: str | None) -> None:
        found = words(text)
        if len(found) >= self.least:
            for w in found:
                if w not in self.number:
                    self.number[w] = len(self.number) + 1
            self.items.append(item)
            self.texts.append(np.array([self.number[w] for w in found], np.uint64))

    def close(self) -> SeedIndex:
        hashes = [rolling_hashes(t, self.least) for t in self.texts]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]) if hashes else np.empty(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.lexsort((place, owner, h))
        self.hashes, self.owner, self.place = h[order], owner[order], place[order]
        return self

    def tiles(self, text: str | None) -> Iterator[tuple[int, list[tuple[int, int, int]], int]]:
        """(item, tiles, words of the item) of every item that shares a passage with the text; a tile is (length, start in text, start in item)."""
        found = words(text)
        if len(found) < self.least or not len(self.hashes):
            return
        numbers = np.fromiter(map(self.number.__getitem__, found), np.uint64, len(found))
        gaps = np.flatnonzero(np.concatenate([[True], numbers == 0, [True]]))
        if np.diff(gaps).max() <= self.least:
            return
        h = rolling_hashes(numbers, self.least)
        left = np.searchsorted(self.hashes, h)
        hit = np.flatnonzero(self.hashes[np.minimum(left, len(self.hashes) - 1)] == h)
        if not len(hit):
            return
        count = np.searchsorted(self.hashes, h[hit], "right") - left[hit]
        at = np.repeat(hit, count)
        seed = np.repeat(left[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, place = self.owner[seed], self.place[seed]
        # Seeds on one diagonal that follow each other are one maximal run.
        order = np.lexsort((at, at - place, owner))
        at, place, owner = at[order], place[order], owner[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at))) + self.least - 1
        runs = defaultdict(list)
        for o, n, i, j in zip(owner[begin].tolist(), length.tolist(), at[begin].tolist(), place[begin].tolist()):
            same = numbers[i : i + n] == self.texts[o][j : j + n]
            if same.all():  # hashes that agree by chance end here
                runs[o].append((n, i, j))
        for o, found_runs in runs.items():
            yield self.items[o], greedy_tiles(found_runs, len(numbers), len(self.texts[o]), self.least), len(self.texts[o])


def greedy_tiles(runs: list[tuple[int, int, int]], n: int, m: int, least: int) -> list[tuple[int, int, int]]:
    """Marks the longest common run whose words are free on both sides, again and again; what is left of a run that was cut into competes on."""
    heap = [(-length, i, j) for length, i, j in runs]
    heapq.heapify(heap)
    in_text, in_item = bytearray(n), bytearray(m)
    tiles = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        taken = [a or b for a, b in zip(in_text[i : i + length], in_item[j : j + length])]
        if any(taken):
            start = None
            for k, t in enumerate([*taken, 1]):
                if not t and start is None:
                    start = k
                elif t and start is not None:
                    if k - start >= least:
                        heapq.heappush(heap, (start - k, i + start, j + start))
                    start = None
            continue
        in_text[i : i + length] = in_item[j : j + length] = b"\1" * length
        tiles.append((length, i, j))
    return tiles


COLUMNS = "doc_id bigint, item_id bigint, tiles int, longest int, covered int, item_words int, coverage double"


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, words_per_pass: int = WORDS_PER_PASS, least_coverage: float = 0.0) -> DataFrame:
    """One row per document (doc_id, text) and evaluation item (item_id, text) with a run of ``least`` words in common.

    tiles: passages found; longest: words of the longest; covered: words of the item within tiles; coverage: their
    share; pairs whose tiles cover less than ``least_coverage`` of the item are left out. Null, empty and short texts on either side match nothing; a text repeated under several ids is reported for
    each, as is a passage that items share; rows repeated under one id are reported again; other columns are ignored.
    The evaluation set may be of any size: it is indexed and broadcast ``words_per_pass`` words at a time.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    passes, held = [], 0
    index = SeedIndex(least)

    def search(index: SeedIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index.close())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for batch in batches:
                rows = [
                    (doc, item, len(t), max(x[0] for x in t), (c := sum(x[0] for x in t)), m, c / m)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                    for item, t, m in seeds.tiles(text.as_py())
                    if sum(x[0] for x in t) >= least_coverage * m
                ]
                cols = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

        return texts.mapInArrow(run, COLUMNS)

    for row in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(index.texts)
        index.add(row["item_id"], row["text"])
        held += sum(map(len, index.texts[n:]))
        if held >= words_per_pass:
            passes.append(search(index))
            index, held = SeedIndex(least), 0
    if index.texts or not passes:
        passes.append(search(index))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out
