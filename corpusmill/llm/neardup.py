"""Problem 4: near-duplicate records by dart signatures.

Every text is the set of its runs of successive words. Darts are thrown at each element as a hashed Poisson process:
the k-th dart of an element arrives at a rank that depends on the element alone, hits one coordinate, and has a height
below which the element's weight must not lie. A signature keeps, for each coordinate, the earliest dart that hits, so
two texts agree in a coordinate with the probability of their weighted Jaccard similarity, at a cost of about
k log k darts a text instead of k hashes an element. Signatures are cut into bands, and texts that share a band are
candidates. All elements weigh 1, as the similarity that decides counts them alike, so that no text depends on what
others hold.

Candidates of small buckets are compared exactly where their sets meet. To a larger bucket its texts bring their sets
and are compared in it, through their rare elements, so that only near ones leave it; of the largest buckets, which no
task should hold, the texts meet at their rare elements instead. No bucket is cut.

Texts of the same words share a fingerprint and are one class throughout; copies never meet in a bucket.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.textnorm import SHINGLE_TEXTS, WordHashes, distinct_pairs, mix64, shingle_sets, words
from corpusmill.session import materialise

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Texts that are hashed at a time, which bounds a worker's memory whatever the Arrow batch holds.
TEXTS_AT_A_TIME = SHINGLE_TEXTS
CHARACTERS_AT_A_TIME = 8_000_000
#: Elements and documents whose darts are thrown together, and their darts at a time: so many that they stay in a core's cache.
ELEMENTS_AT_A_TIME = 8_192
SIGNATURES_AT_A_TIME = 128
DARTS_AT_A_TIME = 32_768
NO_DART = np.uint64(np.iinfo(np.uint64).max)
#: Which half of a 64-bit number is the high one.
HIGH = int(sys.byteorder == "little")
#: Entries (band key and fingerprint) that one task gets to sort.
ENTRIES_PER_TASK = 4_000_000
#: Distinct texts in one bucket that are paired with each other; to a larger one they bring their sets.
LARGEST_BUCKET = 16
#: Distinct texts that bring their sets to one bucket; those of a larger one are searched by rare elements across tasks.
LARGEST_SEARCHED_BUCKET = 10_000
#: Candidate pairs held or emitted at a time.
PAIRS_AT_A_TIME = 200_000
#: Fingerprints that a worker remembers as sent, before it starts over; it only saves copies.
MEMO_PRINTS = 2_000_000


@dataclass(frozen=True)
class Similarity:
    """What counts as near. ``bands`` x ``rows`` coordinates find a pair of similarity s with 1 - (1 - s^rows)^bands."""

    words: int = 5
    least_words: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 5

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    def recall(self, s: float) -> float:
        return 1 - (1 - s**self.rows) ** self.bands


#: Half of the runs of three words in common; 0.998 of the pairs at exactly that similarity are candidates.
HALF_OF_THREE_WORDS = Similarity(words=3, least_words=20, threshold=0.5, bands=97, rows=4)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """(n_docs, k) winners: for each coordinate the identity of the earliest dart. Weights lie in (0, 1]; ``doc`` is sorted.

    Documents without elements get zeros.
    """
    out = np.zeros((n_docs, k), np.uint64)
    end = np.cumsum(np.bincount(doc, minlength=n_docs))
    weight = weight.astype(np.float32)
    lo = start = 0
    while lo < n_docs:
        hi = min(max(lo + 1, int(np.searchsorted(end, start + ELEMENTS_AT_A_TIME, "right"))), lo + SIGNATURES_AT_A_TIME, n_docs)
        some = slice(start, int(end[hi - 1]))
        out[lo:hi] = _earliest_darts(doc[some] - lo, element[some], weight[some], hi - lo, k)
        lo, start = hi, some.stop
    return out


def _earliest_darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures of a few documents: several darts of every element at a time, until none that is left can be earlier than a winner."""
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    open_ = total > 0
    once = np.divide(k, total, out=np.zeros(n_docs), where=open_)  # by this rank k darts have come
    limit = ((math.log(k) + 1.5) * once).astype(np.float32)
    best = np.full(n_docs * k, NO_DART)
    first, all_hit = doc * k, bool((weight >= 1).all())
    turns = np.arange(1, DARTS_AT_A_TIME + 1, dtype=np.uint64) * GOLDEN
    counter, arrival = element.copy(), np.zeros(len(element), np.float32)
    on = np.arange(len(element))
    while True:
        while len(on):
            before, until = arrival[on], limit[doc[on]]
            ahead = until - before
            n = int(ahead.max()) + 2 if len(on) * 64 < DARTS_AT_A_TIME else int(ahead.sum()) // len(on)
            n = min(max(1, n), max(1, DARTS_AT_A_TIME // len(on)))
            x = mix64(counter[on] + turns[:n, None])
            rank = np.ascontiguousarray(x.view(np.uint32)[:, HIGH::2]).astype(np.float32)
            rank += np.float32(0.5)
            rank *= np.float32(2.0**-32)
            np.log(rank, out=rank)
            np.subtract(before, rank[0], out=rank[0])
            for i in range(1, n):
                np.subtract(rank[i - 1], rank[i], out=rank[i])
            missed = None if all_hit else (x & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16) >= weight[on]
            x *= GOLDEN
            name = np.ascontiguousarray(x.view(np.uint32)[:, HIGH::2])
            where = (name - name // np.uint32(k) * np.uint32(k)).astype(np.int64)  # numpy's remainder takes longer
            where += first[on]
            x >>= np.uint64(32)
            x |= rank.view(np.uint32).astype(np.uint64) << np.uint64(32)
            if missed is not None:
                x[missed] = NO_DART
            np.minimum.at(best, where.ravel(), x.ravel())
            counter[on] += turns[n - 1]
            arrival[on] = rank[-1]
            on = on[rank[-1] < until]
        latest = best.reshape(n_docs, k).max(axis=1)
        rank = (latest >> np.uint64(32)).astype(np.uint32).view(np.float32)
        empty = latest == NO_DART
        open_ &= empty | (rank > limit)
        if not open_.any():
            best = best.reshape(n_docs, k)
            best[total == 0] = 0
            return best
        limit = np.where(open_, np.where(empty, limit + once, rank), limit).astype(np.float32)
        on = np.flatnonzero(open_[doc] & (arrival < limit[doc]))


def scope_hash(scope: str | None) -> int:
    return xxhash.xxh3_64_intdigest(scope or "")


def _word_lists(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[tuple[str, np.ndarray, list[list[str]], np.ndarray]]:
    """(scope, ids, words, fingerprints) of a few texts at a time that share a scope; texts with too few words have neither."""
    least = max(how.words, how.least_words)
    for batch in batches:
        scopes = batch.column("scope").to_pylist()
        length = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        edges = [0, *(i for i in range(1, len(scopes)) if scopes[i] != scopes[i - 1]), len(scopes)]
        for lo, hi in zip(edges, edges[1:]):
            seed = scope_hash(scopes[lo]) if lo < hi else 0
            at = lo
            while at < hi:
                upto = np.cumsum(length[at : min(at + TEXTS_AT_A_TIME, hi)])
                part = batch.slice(at, max(1, int(np.searchsorted(upto, CHARACTERS_AT_A_TIME, "right"))))
                at += len(part)
                found = [w if len(w) >= least else [] for w in map(words, part.column("text").to_pylist())]
                prints = np.array([xxhash.xxh3_64_intdigest(" ".join(w), seed) if w else 0 for w in found], np.uint64)
                yield scopes[lo] or "", part.column("id").to_numpy(zero_copy_only=False), found, prints


class _DistinctSets:
    """Sets of runs of the texts that this worker has not met before."""

    def __init__(self, how: Similarity) -> None:
        self.size, self.memo, self.seen = how.words, WordHashes(), set()

    def of(self, found: list[list[str]], prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Fingerprints, doc, element."""
        fresh, texts = [], []
        for p, w in zip(prints.tolist(), found):
            if w and p not in self.seen:
                self.seen.add(p)
                fresh.append(p)
                texts.append(w)
        if len(self.seen) > MEMO_PRINTS:
            self.seen.clear()
        return (np.array(fresh, np.uint64), *shingle_sets(texts, self.size, self.memo)) if fresh else None


PACKED = "task int, blob binary, scope string, fp array<bigint>, id array<bigint>"


def _members_and_bands(how: Similarity, tasks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scope, fingerprints and ids of a few texts, for any one task, and band keys of the distinct ones, packed for each task: counts per text, fingerprints, keys.

    Of a key 32 bits are left beside its task; the few texts that meet by chance are compared in vain.
    """
    types = [pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["task", "blob", "scope", "fp", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _DistinctSets(how)
        for scope, ids, found, prints in _word_lists(batches, how):
            some = np.flatnonzero([bool(w) for w in found])
            if not len(some):
                continue
            at = int(prints[some[0]]) % tasks
            members = pa.array([prints[some].view(np.int64)], types[3]), pa.array([ids[some].astype(np.int64)], types[4])
            yield pa.RecordBatch.from_arrays([pa.array([at], types[0]), pa.nulls(1, types[1]), pa.array([scope], types[2]), *members], names)
            fresh = sets.of(found, prints)
            if fresh is None:
                continue
            prints, doc, element = fresh
            signature = dart_signatures(doc, element, np.ones(len(element)), len(prints), how.coordinates)
            cut = (signature & np.uint64(0xFFFFFFFF)).reshape(len(prints), how.bands, how.rows)
            with np.errstate(over="ignore"):
                key = np.arange(how.bands, dtype=np.uint64)[None, :] * GOLDEN + np.uint64(scope_hash(scope))
                for r in range(how.rows):
                    key = mix64(key * GOLDEN + cut[:, :, r])
                key = key.ravel()
                task = ((key >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.uint16 if tasks <= 1 << 16 else np.int64)  # short numbers sort faster
            owner = np.repeat(np.arange(len(prints)), how.bands)
            order = np.argsort(task, kind="stable")
            key, owner, task = key[order].astype(np.uint32), owner[order], task[order]
            edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            blobs = []
            for lo, hi in zip(edge, edge[1:]):
                own = owner[lo:hi]
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                who, count = own[begin], np.diff(np.append(begin, hi - lo))
                blobs.append(b"".join([np.array([len(who), hi - lo], np.uint32).tobytes(), count.astype(np.uint16).tobytes(), prints[who].tobytes(), key[lo:hi].tobytes()]))
            none = (pa.nulls(len(blobs), kind) for kind in types[2:])
            yield pa.RecordBatch.from_arrays([pa.array(task[edge[:-1]].astype(np.int32)), pa.array(blobs, types[1]), *none], names)

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints."""
    n, m = map(int, np.frombuffer(blob, np.uint32, 2))
    count = np.frombuffer(blob, np.uint16, n, 8)
    who = np.frombuffer(blob, np.uint64, n, 8 + 2 * n)
    return np.frombuffer(blob, np.uint32, m, 8 + 10 * n), np.repeat(who, count)


def _grouped(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries (key, fingerprint) of keys that occur more than once, sorted. Keys have 32 bits, entries fewer than 2^32."""
    both = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    key, at = (both >> np.uint64(32)).astype(np.uint32), both & np.uint64(0xFFFFFFFF)
    same = key[1:] == key[:-1]
    kept = np.zeros(len(key), bool)
    kept[1:] = same
    kept[:-1] |= same
    return distinct_pairs(key[kept], who[at[kept].astype(np.int64)])


MET = "a bigint, b bigint, bucket bigint, n bigint, scope string"


def _candidates(largest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of fingerprints that share a key, of the blobs of one task (a, b); the members of larger buckets (a, bucket, n texts in it); fingerprints and ids of records (a, b, scope)."""

    def row_batch(a: np.ndarray, b: np.ndarray | None = None, bucket: np.ndarray | None = None, n: np.ndarray | None = None, scope: str | None = None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b, bucket, n)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([scope] * len(a), pa.string())], ["a", "b", "bucket", "n", "scope"])

    def pairs(first: list[np.ndarray], second: list[np.ndarray]) -> pa.RecordBatch:
        return row_batch(*distinct_pairs(np.concatenate(first), np.concatenate(second)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, task = [], 0
        for batch in batches:
            task = batch.column("task")[0].as_py() if len(batch) else task
            for blob, scope, fp, i in zip(*(batch.column(c) for c in ("blob", "scope", "fp", "id"))):
                if blob.is_valid:
                    got.append(_unpack(blob.as_py()))
                else:
                    yield row_batch(fp.values.to_numpy(), i.values.to_numpy(), scope=scope.as_py())
        if not got:
            return
        key, who = (np.concatenate(x) for x in zip(*got))
        del got
        key, who = _grouped(key, who)
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        begin, size = edge[:-1], np.diff(edge)
        large = np.flatnonzero(size > largest)
        if len(large):
            n = size[large]
            bucket = np.repeat(key[begin[large]].astype(np.int64) | task << 32, n)
            a = who[_ranges(begin[large], n)].view(np.int64)
            yield row_batch(a, bucket=bucket, n=np.repeat(n, n))
        first, second, held = [], [], 0
        for n in range(2, largest + 1):
            at = begin[size == n]
            for shift in range(1, n):
                rows = max(1, PAIRS_AT_A_TIME // (n - shift))
                for lo in range(0, len(at), rows):
                    left = (at[lo : lo + rows, None] + np.arange(n - shift)[None, :]).ravel()
                    x, y = who[left].view(np.int64), who[left + shift].view(np.int64)
                    first.append(np.minimum(x, y))
                    second.append(np.maximum(x, y))
                    held += len(left)
                    if held >= PAIRS_AT_A_TIME:
                        yield pairs(first, second)
                        first, second, held = [], [], 0
        if held:
            yield pairs(first, second)

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _shared(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of elements that the sets of each pair share."""
    n, m = size[a], size[b]
    pair = np.repeat(np.r_[: len(a), : len(b)].astype(np.uint64), np.r_[n, m])
    both = np.sort(pair << np.uint64(32) | flat[_ranges(np.r_[start[a], start[b]], np.r_[n, m])], kind="stable")
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(a))


def _near_sets(size: np.ndarray, flat: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets with at least the similarity, by row, and that similarity; exact, a pair perhaps more than once.

    Each set's elements are ordered by their frequency here. Near sets share one of their first elements, and after the
    first that they share enough must be left in both.
    """
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    _, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((flat, often[place], row))
    row, code, often = row[order], flat[order], often[place][order]
    left = start[row] + size[row] - np.arange(len(row))
    kept = (left >= np.ceil(threshold * size[row] - 1e-9)) & (often > 1)
    code, row, left = code[kept], row[kept], left[kept]
    order = np.lexsort((size[row], code))
    code, row, left = code[order], row[order], left[order]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, int)
    begin, n_in = edge[:-1], np.diff(edge)
    first, second, held = [], [], 0

    def near() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b = distinct_pairs(np.concatenate(first), np.concatenate(second))
        for lo in range(0, len(a), 5_000):
            x, y = a[lo : lo + 5_000], b[lo : lo + 5_000]
            shared = _shared(flat, start, size, x, y)
            similarity = shared / (size[x] + size[y] - shared)
            kept = similarity >= threshold - 1e-12
            yield x[kept], y[kept], similarity[kept]

    for n in np.unique(n_in[n_in > 1]):
        at = begin[n_in == n]
        for shift in range(1, n):
            step = max(1, PAIRS_AT_A_TIME // int(n - shift))
            for lo in range(0, len(at), step):
                i = (at[lo : lo + step, None] + np.arange(n - shift)[None, :]).ravel()
                a, b = row[i], row[i + shift]
                could = np.minimum(left[i], left[i + shift]) * (1 + threshold) >= threshold * (size[a] + size[b]) - 1e-6
                first.append(np.minimum(a, b)[could])
                second.append(np.maximum(a, b)[could])
                held += len(first[-1])
                if held >= PAIRS_AT_A_TIME:
                    yield from near()
                    first, second, held = [], [], 0
    if held:
        yield from near()


def _near_in_bucket(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Near pairs among the texts of one bucket (fp, members)."""

    def run(bucket: pa.Table) -> pa.Table:
        who = bucket.column("fp").to_numpy()
        members = bucket.column("members").to_pylist()
        size = np.array([len(m) // 4 for m in members], np.int64)
        found = [(who[x], who[y], s) for x, y, s in _near_sets(size, np.frombuffer(b"".join(members), np.uint32), threshold)]
        x, y, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "similarity": s})

    return run


def _sets(how: Similarity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of the distinct texts, as sorted 32-bit values: a pair of sets is compared wrongly about once in a million times, by one element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _DistinctSets(how)
        for _, _, found, prints in _word_lists(batches, how):
            fresh = sets.of(found, prints)
            if fresh is None:
                continue
            prints, doc, element = fresh
            small = (element >> np.uint64(21)).astype(np.uint32)
            kept = np.concatenate([[True], (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])])
            edge = np.searchsorted(doc[kept], np.arange(len(prints) + 1)) * 4
            small = small[kept].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array([small[lo:hi] for lo, hi in zip(edge, edge[1:])], pa.binary())], ["fp", "members"])

    return run


def _compare(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        n = np.array([len(v) // 4 for v in values], np.int64)
        return np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32) | np.frombuffer(b"".join(values), np.uint32), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 5_000):
                part = whole.slice(lo, 5_000)
                (x, n), (y, m) = flat(part.column("members_a")), flat(part.column("members_b"))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = both[1:][both[1:] == both[:-1]]
                common = np.bincount((shared >> np.uint64(32)).astype(np.int64), minlength=len(n))
                similarity = common / np.maximum(n + m - common, 1)
                keep = np.flatnonzero(similarity >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(pa.array(keep)), part.column("b").take(pa.array(keep)), pa.array(similarity[keep])], ["a", "b", "similarity"]
                )

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members").to_pylist()
        size = np.array([len(m) // 4 for m in members], np.int64)
        row = pa.array(np.repeat(np.arange(len(size)), size))
        element = pa.array(np.frombuffer(b"".join(members), np.uint32).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("scope").take(row), batch.column("fp").take(row), pa.array(np.repeat(size, size)), element], ["scope", "fp", "size", "element"])


def _pairs_by_rare_elements(fps: DataFrame, members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates among the texts of ``fps``, none lost: those that share one of their first elements by frequency, with enough left after it.

    What many such texts have in common comes last, so that only texts close to each other meet.
    """
    scopes = members.join(fps, "fp", "left_semi").select("fp", "scope").distinct()
    each = sets.join(scopes, "fp").select("scope", "fp", "members").mapInArrow(_elements, "scope string, fp bigint, size bigint, element bigint")
    each = materialise(each)
    often = each.groupBy("scope", "element").count().where("count > 1")
    ordered = each.join(often, ["scope", "element"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("fp").orderBy(F.coalesce("count", F.lit(1)), "element")))
    left = F.col("size") - F.col("nth") + 1
    first = ordered.where(F.col("count").isNotNull() & (left >= F.ceil(threshold * F.col("size") - 1e-9))).select("scope", "element", "fp", "size", left.alias("left"))
    first = materialise(first)
    one, other = (first.select("scope", "element", F.col("fp").alias(x), F.col("size").alias(f"size_{x}"), F.col("left").alias(f"left_{x}")) for x in "ab")
    enough = F.least("left_a", "left_b") * (1 + threshold) >= threshold * (F.col("size_a") + F.col("size_b")) - 1e-6
    return one.join(other, ["scope", "element"]).where("a < b").where(enough).select("a", "b").distinct()


@dataclass
class NearDuplicates:
    """``members``: scope, fp, id of every record that takes part. ``links``: a, b, similarity of different classes, each pair once."""

    members: DataFrame
    links: DataFrame


def near_duplicates(records: DataFrame, how: Similarity) -> NearDuplicates:
    """Classes and links of ``records`` (scope string, id bigint, text string; other columns are ignored).

    Records only meet within their scope. Null, empty and short texts (fewer than ``least_words`` words) take no part;
    repeated rows and texts of the same words share a class; an empty table gives empty results. Texts with one 64-bit
    fingerprint are taken for identical (for a billion classes a wrong pair is expected 0.03 times).
    """
    spark = records.sparkSession
    records = records.select("scope", "id", "text")
    tasks = max(math.ceil(records.count() * how.bands / ENTRIES_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = records.mapInArrow(_members_and_bands(how, tasks), PACKED).repartitionById(tasks, F.col("task"))
    found = materialise(packed.mapInArrow(_candidates(LARGEST_BUCKET), MET))
    members = found.where("scope is not null").select("scope", F.col("a").alias("fp"), F.col("b").alias("id"))
    met = found.where("scope is null")
    sets = records.mapInArrow(_sets(how), "fp bigint, members binary").groupBy("fp").agg(F.first("members").alias("members"))

    pairs = met.where("bucket is null").select("a", "b").distinct()
    largest = met.where(F.col("n") > LARGEST_SEARCHED_BUCKET).select(F.col("a").alias("fp")).distinct()
    if largest.limit(1).count():
        pairs = pairs.union(_pairs_by_rare_elements(largest, members, sets, how.threshold)).distinct()
    compared = (
        pairs.join(sets.hint("shuffle_merge").select(F.col("fp").alias("a"), F.col("members").alias("members_a")), "a")
        .join(sets.hint("shuffle_merge").select(F.col("fp").alias("b"), F.col("members").alias("members_b")), "b")
        .select("a", "b", "members_a", "members_b")
        .mapInArrow(_compare(how.threshold), "a bigint, b bigint, similarity double")
    )
    large = met.where(F.col("n") <= LARGEST_SEARCHED_BUCKET).select(F.col("a").alias("fp"), "bucket")
    searched = large.join(sets.hint("shuffle_merge"), "fp").groupBy("bucket").applyInArrow(_near_in_bucket(how.threshold), "a bigint, b bigint, similarity double")
    return NearDuplicates(members, compared.union(searched).dropDuplicates(["a", "b"]))


def record_pairs(near: NearDuplicates) -> DataFrame:
    """scope, id_a, id_b of all pairs of records, id_a < id_b: linked classes, and copies within a class."""
    same = near.members.groupBy("fp").count().where("count > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    links = near.links.select("a", "b").union(same)
    left = near.members.select(F.col("fp").alias("a"), "scope", F.col("id").alias("x"))
    right = near.members.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    return (
        links.join(left, "a").join(right, "b").where("a <> b or x < y")
        .select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def groups(near: NearDuplicates) -> DataFrame:
    """One row per record: scope, id, class_id (smallest id of its copies), n_links (classes linked to its own), group_id (smallest id reached over links).

    Labels spread by minimum over the links and are shortened by looking up the label of the label, so that the number
    of rounds grows with the logarithm of a chain's length. Each round is checkpointed.
    """
    links = materialise(near.links.select("a", "b"))
    both = links.union(links.select("b", "a")).toDF("fp", "other")
    classes = near.members.groupBy("fp").agg(F.min("id").alias("class_id"))
    labels = materialise(both.select("fp").distinct().withColumn("label", F.col("fp")))
    changed = labels.limit(1).count()
    while changed:
        near_by = both.join(labels.withColumnRenamed("fp", "other"), "other").groupBy("fp").agg(F.min("label").alias("seen"))
        step = labels.join(near_by, "fp").select("fp", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("fp").alias("label"), F.col("label").alias("further"))
        after = materialise(step.join(jump, "label").select("fp", F.least("label", "further").alias("label"), "was"))
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("fp", "label")
    degree = both.groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(degree, "fp").join(classes, "fp")
    heads = linked.groupBy("label").agg(F.min("class_id").alias("group_id"))
    linked = linked.join(heads, "label").select("fp", "n_links", "group_id")
    return (
        near.members.join(classes, "fp").join(linked, "fp", "left")
        .select("scope", "id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )


def chat_text(messages: str = "messages") -> Column:
    """Contents of the messages other than those of role system, joined by line breaks; null messages and contents are left out."""
    kept = F.filter(F.col(messages), lambda m: m.isNotNull() & m["content"].isNotNull() & (F.coalesce(m["role"], F.lit("")) != "system"))
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")
