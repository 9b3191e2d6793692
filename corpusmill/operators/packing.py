"""Fixed-length sequences, evaluation windows and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.prefix import running_total

#: Character that closes a document in a packed stream of characters.
END_MARK = "\x01"


def pack_sequences(docs: DataFrame, length: int, stream: str = "stream", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of ``length`` + 1 characters of each stream's documents, every one closed by END_MARK; the unfinished block is dropped.

    Columns: stream, block, content (block text), cu (offsets of the document ends within it, from 0 to ``length``).
    A document is cut once per block it touches, so a block is gathered from the few documents in it; streams of any
    size spread over tasks. Documents without text are left out; ``order`` is unique within a stream.
    """
    size = length + 1
    texts = docs.where(F.col(text) != "")
    # Only keys and lengths are ordered, summed and checkpointed; texts are joined to their places, and moved once.
    sized = texts.select(stream, order, (F.length(text) + 1).alias("n"))
    ends = running_total(sized, "n", [order], [stream], "end").withColumn("begin", F.col("end") - F.col("n"))
    closed = texts.select(F.col(stream).alias("__stream"), F.col(order).alias("__order"), F.concat(F.col(text), F.lit(END_MARK)).alias("closed"))
    placed = ends.join(closed, ends[stream].eqNullSafe(closed["__stream"]) & (ends[order] == closed["__order"])).drop("__stream", "__order")
    first, last = F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size)
    touched = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    left = F.greatest(F.col("block") * size, F.col("begin"))
    right = F.least((F.col("block") + 1) * size, F.col("end"))
    part = F.substr("closed", (left - F.col("begin") + 1).cast("int"), (right - left).cast("int"))
    ends_here = (F.col("end") <= (F.col("block") + 1) * size) & (F.col("end") - F.col("block") * size <= length)
    cut = touched.select(
        stream, "block", F.struct(left.alias("at"), part.alias("part")).alias("piece"), F.when(ends_here, (F.col("end") - F.col("block") * size).cast("int")).alias("edge")
    )
    blocks = cut.groupBy(stream, "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.collect_set("edge").alias("edges"))
    content = F.array_join(F.transform("pieces", lambda p: p["part"]), "")
    cu = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(length)), "edges")))
    return blocks.select(stream, "block", content.alias("content"), cu.alias("cu")).where(F.length("content") == size)


def inputs_and_targets(ids: Column, length: int) -> tuple[Column, Column]:
    """x and y of a block: its ids without the last and without the first."""
    return F.slice(ids, 1, length), F.slice(ids, 2, length)


def segment_ids(cu: Column, length: int) -> Column:
    """Number of the document at every position, from the ascending document bounds of a block, the first of which is 0.

    Bounds beyond ``length`` are dropped; what follows the last one kept is a segment of its own.
    """
    kept = F.array_distinct(F.array_append(F.filter(cu, lambda c: c <= length), F.lit(length)))
    n = F.size(kept) - 1
    spans = F.zip_with(F.slice(kept, 1, n), F.slice(kept, 2, n), lambda begin, end: (end - begin).cast("int"))
    return F.flatten(F.transform(spans, lambda span, i: F.array_repeat(i, span)))


def segment_changes(segments: Column) -> Column:
    """Positions at which a segment differs from the one before."""
    n = F.size(segments) - 1
    changed = F.zip_with(F.slice(segments, 1, n), F.slice(segments, 2, n), lambda before, here: before != here)
    return F.filter(F.transform(changed, lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())


def eval_windows(n: Column, length: int) -> Column:
    """Begins of the windows over n tokens: every ``length``, as long as two tokens are left."""
    return F.when(n >= 2, F.sequence(F.lit(0), (n - 2).cast("int"), F.lit(length))).otherwise(F.array().cast("array<int>"))


def collate_bounds(packed: DataFrame, batch: str, cu: str = "cu") -> DataFrame:
    """Packed samples with their bounds filled up with -1 to the most of their batch, as ``cu_padded``, and the number of those that count, ``n_segs``.

    The longest of a batch is aggregated and joined back, so that a batch of any size gathers nowhere.
    """
    longest = packed.groupBy(batch).agg(F.max(F.size(cu)).alias("__longest"))
    joined = packed.join(longest, packed[batch].eqNullSafe(longest[batch])).drop(longest[batch])
    return joined.withColumn("n_segs", F.size(cu)).withColumn("cu_padded", F.concat(F.col(cu).cast("array<int>"), F.array_repeat(F.lit(-1), F.col("__longest") - F.col("n_segs")))).drop("__longest")


def pad_batches(df: DataFrame, batch: str, column: str, fill: int, out: str = "padded") -> DataFrame:
    """Arrays filled up to the longest of their batch, and their own length as ``n``."""
    longest = F.max(F.size(column)).over(Window.partitionBy(batch))
    return df.withColumn("__longest", longest).withColumn("n", F.size(column)).withColumn(
        out, F.concat(column, F.array_repeat(F.lit(fill), F.col("__longest") - F.col("n")))
    ).drop("__longest")
