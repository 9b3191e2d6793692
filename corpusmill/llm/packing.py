"""Problem 5: filling fixed windows with documents.

Documents are spread over partitions by a hash, and each partition packs its own by best fit decreasing. A lower bound
from dual feasible functions certifies a partition that needs no window more than it must. Partitions with a gap give
up the documents of their emptier windows, which meet in fewer, new partitions and are packed again; so do the few
windows that every partition leaves partly empty. The exchange ends when one partition is left, or after ROUNDS.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise

#: Items that one task packs.
ITEMS_PER_TASK = 20_000
#: Windows filled to less than this go to the next exchange, unless the partition is certified; the emptiest always does.
FULL = 0.995
ROUNDS = 6


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Windows that ``sizes`` (each from 1 to ``capacity``) need at least: the best of three families of dual feasible functions.

    A function u on [0, 1] is dual feasible if sizes that fit one window have values that sum to 1 at most; the sum over
    all items then bounds the windows. Used are the identity, the rounding functions for k = 1..32, and, for thresholds e
    among the sizes up to half a window, the one that drops items below e and rounds those above 1 - e up.
    """
    if not len(sizes):
        return 0
    value, count = np.unique(sizes.astype(np.int64), return_counts=True)
    best = -(-int((value * count).sum()) // capacity)
    for k in range(1, 33):
        scaled = value * (k + 1)
        u = np.where(scaled % capacity == 0, (scaled // capacity) * k, (scaled // capacity) * (k + 1))  # in units of 1 / (k * (k + 1))
        best = max(best, -(-int((u * count).sum()) // (k * (k + 1))))
    small = value[value <= capacity // 2]
    for e in np.unique(small[np.linspace(0, len(small) - 1, min(len(small), 64)).astype(int)]) if len(small) else ():
        u = np.where(value > capacity - e, capacity, np.where(value >= e, value, 0))
        best = max(best, -(-int((u * count).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item: largest first, each into the fullest window that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    window = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a window with room r is open
    opened = 0
    for i in order.tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            w = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, w = capacity, opened
            opened += 1
        left = room - size
        if left:
            by_room[left].append(w)
            rooms |= 1 << left
        window[i] = w
    return window


PACKED = "phase string, capacity int, task bigint, id bigint, part int, size int, window bigint, fill int, settled boolean, bound bigint, windows bigint"


def _pack(last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "part"], ascending=[False, True, True], ignore_index=True)
        capacity = int(group["capacity"].iloc[0])
        sizes = group["size"].to_numpy()
        window = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(window, weights=sizes).astype(np.int64)
        bound = lower_bound(sizes, capacity)
        if last:
            settled = np.ones(len(fill), bool)
        else:
            settled = fill >= FULL * capacity if len(fill) > bound else np.ones(len(fill), bool)
            settled &= fill > fill.min() if fill.min() < capacity else True
        return group.assign(window=window, fill=fill[window], settled=settled[window], bound=bound, windows=len(fill))[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def _per_task(items: DataFrame, round_: int) -> DataFrame:
    """A task number for each item, about ITEMS_PER_TASK to a task within each phase."""
    sizes = items.groupBy("phase").count().withColumn("tasks", F.ceil(F.col("count") / ITEMS_PER_TASK)).select("phase", "tasks")
    return items.join(F.broadcast(sizes), "phase").withColumn("task", F.pmod(F.xxhash64("id", "part", F.lit(round_)), "tasks")).drop("tasks")


def contexts(curriculum: DataFrame) -> dict[str, int]:
    """Phase and context length: configuration, read by the driver."""
    phases = curriculum.where("ctx > 0 and phase is not null").groupBy(F.trim("phase").alias("phase")).agg(F.max("ctx").cast("int").alias("capacity"))
    return dict(sorted(map(tuple, phases.collect())))


def _in_each(documents: DataFrame, phases: dict[str, int]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(c).alias("capacity")) for p, c in phases.items()])
    return documents.select("id", "size", F.explode(each).alias("in")).select("in.phase", "in.capacity", "id", "size")


def split_items(documents: DataFrame, phases: dict[str, int]) -> DataFrame:
    """Items of every phase: a document as it is, or, if it is longer than the window, whole windows and a remainder."""
    sized = _in_each(documents.where("size > 0"), phases)
    parts = F.sequence(F.lit(0), (F.ceil(F.col("size") / F.col("capacity")) - 1).cast("int"))
    return sized.select("phase", "capacity", "id", F.col("size").alias("whole"), F.explode(parts).alias("part")).select(
        "phase", "capacity", "id", "part", F.least(F.col("capacity").cast("long"), F.col("whole") - F.col("part") * F.col("capacity").cast("long")).cast("int").alias("size")
    )


def pack(items: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Windows of ``items`` (phase, capacity, id, part, size from 1 to capacity): these columns, window_id, fill, certified.

    A window is certified if the partition that it was packed in needs no window less by its lower bound.
    Items of one id and part are packed each on their own. Whole windows need no packing and never meet a task.
    """
    columns = ["phase", "capacity", "id", "part", "size"]
    full = items.where("size = capacity").select(*columns, F.concat_ws("-", F.lit("w"), "phase", "id", "part").alias("window_id"), F.col("capacity").alias("fill"), F.lit(True).alias("certified"))
    open_ = materialise(items.where("size < capacity").select(*columns))
    done = [full]
    left = open_.groupBy("phase").count().agg(F.max("count")).first()[0] or 0
    for round_ in range(rounds):
        if not left:
            break
        last = left <= ITEMS_PER_TASK or round_ == rounds - 1
        packed = _per_task(open_, round_).groupBy("phase", "task").applyInPandas(_pack(last), PACKED)
        packed = materialise(packed)
        name = F.concat_ws("-", F.lit(f"r{round_}"), "phase", "task", "window")
        done.append(packed.where("settled").select(*columns, name.alias("window_id"), "fill", (F.col("windows") == F.col("bound")).alias("certified")))
        open_ = packed.where("not settled").select(*columns)
        left = open_.groupBy("phase").count().agg(F.max("count")).first()[0] or 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def windows(documents: DataFrame, curriculum: DataFrame) -> DataFrame:
    """One row per phase, document and part: phase, capacity, id, part, size, window_id, fill, certified.

    ``documents``: id and size in tokens; ``curriculum``: phase and ctx. A document without tokens has one row with part
    0, size 0 and no window. Null or non-positive contexts are left out; a phase listed twice counts once, with its
    largest context. Rows repeated under one id are placed each on their own.
    """
    phases = contexts(curriculum)
    if not phases:
        phases, documents = {"": 1}, documents.limit(0)
    placed = pack(split_items(documents, phases))
    none = _in_each(documents.where("size <= 0 or size is null"), phases).select(
        "phase", "capacity", "id", F.lit(0).alias("part"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("window_id"), F.lit(None).cast("int").alias("fill"), F.lit(None).cast("boolean").alias("certified")
    )
    return placed.unionByName(none)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per phase: windows, the bound below which no packing can go, tokens, and the share of space left over.

    The bound takes the identity and, for k = 1..8, the rounding dual feasible functions over all items at once.
    """
    used = placed.where("window_id is not null")
    terms = [F.sum(F.col("size").cast("long")) / F.first("capacity")]
    for k in range(1, 9):
        scaled = F.col("size").cast("long") * (k + 1)
        u = F.when(scaled % F.col("capacity") == 0, scaled / F.col("capacity") / (k + 1)).otherwise(F.floor(scaled / F.col("capacity")) / k)
        terms.append(F.sum(u))
    per_phase = used.groupBy("phase", "capacity").agg(
        F.countDistinct("window_id").alias("windows"), F.countDistinct(F.when(F.col("certified"), F.col("window_id"))).alias("certified_windows"), F.sum(F.col("size").cast("long")).alias("tokens"), F.ceil(F.greatest(*terms) - 1e-6).alias("least_windows")
    )
    return per_phase.withColumn("unused_share", 1 - F.col("tokens") / (F.col("windows") * F.col("capacity"))).withColumn("gap", F.col("windows") - F.col("least_windows"))
