"""Word census, vocabulary, corpus budgets and greedy batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusmill.functions.text import piece_words, pieces, rejoin, trim_text
from corpusmill.operators.prefix import running_total


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, cnt over all documents; counts are summed within tasks before they are shuffled."""
    return docs.select(F.explode(piece_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def allowed_words(counts: DataFrame, least: int, most: int) -> DataFrame:
    """Words counted ``least`` times or more, of these the ``most`` frequent; equally frequent ones by spelling."""
    return counts.where(F.col("cnt") >= least).orderBy(F.desc("cnt"), "word").limit(most)


def prune_threshold(counts: DataFrame, target: int) -> DataFrame:
    """The smallest count that at most ``target`` words reach, and how many do: from the histogram of counts.

    The histogram has a row per distinct count, at most the square root of twice the corpus; its running sum is taken in
    the two-level way.
    """
    histogram = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("words")).withColumn("down", -F.col("cnt"))
    upto = running_total(histogram, "words", ["down"], out="reach")
    fits = upto.where(F.col("reach") <= target)
    return fits.agg(F.min("cnt").alias("threshold"), F.max("reach").alias("words_kept"))


#: A vocabulary of up to so many words (about 30 MB) is sent to every worker; a larger one is joined.
BROADCAST_WORDS = 1_000_000
_PIECES = regex.compile(r"([\t-\r\x1c-\x20\x85\p{Z}]+)|([\p{L}\p{N}_]+)|(?s:.)")


def keep_allowed(text: str, allowed: frozenset[str]) -> str | None:
    """A text without the words outside ``allowed``, as ``functions.text.rejoin`` has it, in one pass."""
    out: list[str] = []
    blank_before, kept_before = True, False
    for m in _PIECES.finditer(text):
        piece, kind = m[0], m.lastindex
        if kind == 1:
            line = "\n" in piece
            out.append("\n" if line else " ")
            blank_before, kept_before = not line, False
        elif kind == 2 and piece not in allowed:
            if not blank_before:
                out.append(" ")
            blank_before = kept_before = False
        else:
            if kept_before:
                out.append(" ")
            out.append(piece)
            blank_before, kept_before = False, True
    return _EDGES.sub("", "".join(out)) or None


_EDGES = regex.compile(r"\A[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+\Z")


def normalise(docs: DataFrame, allowed: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the words outside the vocabulary; ``normalised`` is null where nothing is left.

    The vocabulary is counted; up to BROADCAST_WORDS it travels to the workers and no text moves. A larger one is joined.
    """
    words = [r[0] for r in allowed.select("word").limit(BROADCAST_WORDS + 1).collect()]
    if len(words) > BROADCAST_WORDS:
        return normalise_by_join(docs, allowed, order, text)
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    @arrow_udf("string")
    def kept(texts: pa.Array) -> pa.Array:
        vocabulary = shared.value
        return pa.array([None if t is None else keep_allowed(t, vocabulary) for t in texts.to_pylist()], pa.string())

    return docs.withColumn("normalised", kept(F.col(text)))


def normalise_by_join(docs: DataFrame, allowed: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """``normalise`` for a vocabulary of any size: every distinct word of a document meets it once, and what is found comes back as an array."""
    split = docs.withColumn("pieces", pieces(F.col(text)))
    words = split.select(order, F.explode(F.array_distinct(piece_words(F.col(text)))).alias("word"))
    kept = words.join(allowed.select("word"), "word", "left_semi").groupBy(order).agg(F.collect_set("word").alias("kept"))
    marked = split.join(kept, order, "left").withColumn("ok", F.transform("pieces", lambda p: F.coalesce(F.array_contains("kept", p), F.lit(False))))
    return marked.withColumn("normalised", rejoin(F.col("pieces"), F.col("ok"))).drop("pieces", "kept", "ok")


def within_bytes(docs: DataFrame, cap: int, order: list[str], text: str = "text") -> DataFrame:
    """Keys (``order``) of documents as long as those before them hold fewer than ``cap`` bytes, and the bytes up to each; the one that crosses the cap is kept.

    Texts do not move: only keys and lengths are ordered.
    """
    sized = docs.select(*order, F.octet_length(text).alias("__bytes"))
    return running_total(sized, "__bytes", order, out="bytes_upto").where(F.col("bytes_upto") - F.coalesce(F.col("__bytes"), F.lit(0)) < cap).drop("__bytes")


def within_bytes_kept(docs: DataFrame, cap: int, order: list[str], text: str, kept: str) -> DataFrame:
    """As ``within_bytes``, where only documents whose ``kept`` text is left end the stream: the cap is tested after such a one."""
    sized = docs.select(*order, F.octet_length(text).alias("__bytes"), F.when(F.col(kept).isNotNull(), True).alias("__kept"))
    upto = running_total(sized, "__bytes", order, out="bytes_upto").drop("__bytes")
    over = upto.where(F.col("__kept").isNotNull() & (F.col("bytes_upto") >= cap)).agg(F.min("bytes_upto").alias("stop"))
    return upto.join(F.broadcast(over)).where(F.col("__kept").isNotNull() & (F.col("stop").isNull() | (F.col("bytes_upto") <= F.col("stop")))).drop("stop", "__kept")  # one row


def greedy_batches(docs: DataFrame, most_docs: int, most_chars: int, stream: str, order: str, text: str = "text") -> DataFrame:
    """``batch`` of each document: a batch is closed after the document that brings it to ``most_docs`` or ``most_chars``.

    A stream is sequential by definition: each passes one task in order, streamed, with two counters of state.
    """
    lengths = docs.where(F.col(text) != "").select(stream, order, F.length(text).cast("long").alias("chars"))
    sorted_ = lengths.repartition(stream).sortWithinPartitions(stream, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n, chars = object(), 0, 0, 0
        for batch in batches:
            out = []
            for s, c in zip(batch.column(stream).to_pylist(), batch.column("chars").to_pylist()):
                if s != now:
                    now, number, n, chars = s, 0, 0, 0
                out.append(number)
                n, chars = n + 1, chars + c
                if n >= most_docs or chars >= most_chars:
                    number, n, chars = number + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "batch"])

    kind = lengths.schema[order].dataType.simpleString()
    return sorted_.mapInArrow(run, f"{stream} string, {order} {kind}, chars bigint, batch bigint")


def trimmed(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    return docs.withColumn(text, trim_text(F.col(text), limit)).where(F.col(text).isNotNull())
