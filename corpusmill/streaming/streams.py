"""Structured Streaming: growing corpora, event windows, packing across micro-batches, delivery of new files."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.checkpoints import whole_archives
from corpusmill.operators.packing import END_MARK
from corpusmill.session import ensure_checkpoint_dir


def files(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, also those that come later; each is read once."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    inside = f"{folder}/{name}"
    return reader.parquet(inside) if os.path.isdir(inside) else reader.option("pathGlobFilter", name).parquet(folder)


def windowed(stream: DataFrame, at: str, width: str, keys: list[str], *sums: Column, late: str) -> DataFrame:
    """Aggregates over tumbling windows of event time; rows later than ``late`` behind the newest are left out."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), *keys).agg(*sums)


def unique(stream: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Each key once, as long as its repeats come within ``late``."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str, seconds: int = 300) -> DataFrame:
    """What is there now, run through and kept as a table in memory: for results as small as an aggregate's."""
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    state = f"{ensure_checkpoint_dir(spark)}/{name}"
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        if not run.awaitTermination(seconds):
            raise TimeoutError(f"{name} did not end within {seconds} s")
    finally:
        run.stop()
    return spark.table(name)


def pack_stream(stream: DataFrame, length: int, key: str = "stream", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of ``length`` + 1 characters as in ``operators.packing``; what is left of a micro-batch waits for the next.

    Documents are taken in ``order`` within a micro-batch, micro-batches as they come.
    """
    size = length + 1

    def pack(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, rest = state.get if state.exists else (0, "")
        new = pd.concat(list(parts), ignore_index=True).sort_values(order)
        buffer = rest + "".join(t + END_MARK for t in new[text] if t)
        n = len(buffer) // size
        state.update((block + n, buffer[n * size :]))
        yield pd.DataFrame({key: [name[0]] * n, "block": range(block, block + n), "content": [buffer[i * size : (i + 1) * size] for i in range(n)]})

    return stream.select(key, order, text).groupBy(key).applyInPandasWithState(
        pack, f"{key} string, block bigint, content string", "block bigint, rest string", "append", GroupStateTimeout.NoTimeout
    )


FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark knows it by."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


class Delivery:
    """Hands new files to ``send`` once, when they are old enough, not empty, no longer growing and sound; the others are offered again.

    Files that wait are kept in ``folder``, a version per micro-batch, so that a restart neither forgets nor repeats any.
    ``send`` gets paths; a file whose sending fails waits. With ``settled`` a file goes out only if it has the size and
    time that it had a micro-batch before; with ``archives`` only if its content is a zip archive that can be read to
    its end.
    """

    def __init__(self, folder: str, send: Callable[[str], bool], min_age: float, now: Callable[[], float] = time.time, settled: bool = False, archives: bool = False):
        self.folder, self.send, self.min_age, self.now, self.settled, self.archives = folder, send, min_age, now, settled, archives

    def _listed_now(self, spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, float]]:
        """Length and time of files as they are now."""
        out = {}
        for p in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            system = where.getFileSystem(spark._jsc.hadoopConfiguration())
            if system.exists(where):
                status = system.getFileStatus(where)
                out[p] = (int(status.getLen()), status.getModificationTime() / 1000)
        return out

    def _sound(self, spark: SparkSession, paths: list[str]) -> set[str]:
        if not self.archives or not paths:
            return set(paths)
        read = spark.read.format("binaryFile").load(paths)
        names = {p.split("://")[-1].split(":", 1)[-1].lstrip("/"): p for p in paths}
        return {names[k] for r in whole_archives(read).select("path").collect() if (k := r["path"].split("://")[-1].split(":", 1)[-1].lstrip("/")) in names}

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("path", "length", F.unix_timestamp("modificationTime").cast("double").alias("mtime"))
        before = f"{self.folder}/waiting-{number - 1}"
        waited = set()
        if path_exists(spark, before):
            old = spark.read.parquet(before).select("path", "length", "mtime")
            waited = {r["path"] for r in old.collect()}
            new = new.unionByName(old)
        listed = [tuple(r) for r in new.select("path", "length", "mtime").collect()]  # a listing of files, not their content
        there = self._listed_now(spark, [p for p, _, _ in listed]) if self.settled else {}
        here = [(p, *there.get(p, (n, t))) for p, n, t in listed]
        steady = {p for p, n, t in listed if not self.settled or p in waited and there.get(p) == (n, t)}
        ready = [p for p, n, t in here if p in steady and n > 0 and (self.min_age <= 0 or self.now() - t >= self.min_age)]
        sound = self._sound(spark, ready)
        left = [x for x in here if not (x[0] in sound and self.send(x[0]))]
        spark.createDataFrame(left, "path string, length bigint, mtime double").write.mode("overwrite").parquet(f"{self.folder}/waiting-{number}")

    def watch(self, spark: SparkSession, folder: str, glob: str, state: str):
        stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(folder)
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", state)
