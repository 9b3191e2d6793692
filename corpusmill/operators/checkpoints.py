"""Selection among files that carry a step in their name."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusmill.operators.paths import checkpoint_step


def with_step(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("step", checkpoint_step(F.col(path)))


def latest(files: DataFrame, n: int) -> DataFrame:
    """The last ``n`` by step and path, in that order; all for 0, as for a slice that ends at nothing."""
    ordered = with_step(files)
    return ordered.orderBy("step", "path") if n == 0 else ordered.orderBy(F.desc("step"), F.desc("path")).limit(n).orderBy("step", "path")


def select(files: DataFrame, steps: str = "", indices: str = "", n_latest: int | None = None) -> DataFrame:
    """By steps, else by indices into the sorted list (negative from its end, others skipped, first of repeated ones), else the latest (5)."""
    ordered = with_step(files)
    if steps.strip():
        return ordered.where(F.col("step").isin([int(s) for s in steps.split(",") if s.strip()])).orderBy("step", "path")
    if indices.strip():
        wanted = [int(i) for i in indices.split(",") if i.strip()]
        place = F.row_number().over(Window.orderBy("step", "path")) - 1  # a listing of checkpoints, not data
        numbered = ordered.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
        asked = F.array(*[F.lit(i) for i in wanted])
        rank = F.array_min(F.transform(asked, lambda a, i: F.when(F.when(a < 0, a + F.col("n")).otherwise(a) == F.col("place"), i)))
        return numbered.withColumn("nth", rank).where("nth is not null").orderBy("nth").drop("place", "n", "nth")
    return latest(files, 5 if n_latest is None else n_latest)


def newest(files: DataFrame) -> DataFrame:
    """The file of the highest step, with its counters; missing counters are 0."""
    return with_step(files).agg(F.max_by("path", F.struct("step", "path")).alias("path"), F.coalesce(F.max("step"), F.lit(0)).alias("step"))


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    return files.join(seen.select("path"), "path", "left_anti")


def ready(files: DataFrame, earlier: DataFrame, now: float, min_age: float) -> DataFrame:
    """Files (path, size, mtime in seconds) that are old enough and, against an earlier listing, not growing."""
    old = F.lit(min_age <= 0) | (F.lit(now) - F.col("mtime") >= min_age)
    before = earlier.select("path", F.col("size").alias("size_before"), F.col("mtime").alias("mtime_before"))
    return files.where(old & (F.col("size") > 0)).join(before, "path").where("size = size_before and mtime = mtime_before").select("path", "size", "mtime")


def discover(spark: SparkSession, folder: str, glob: str = "step_*.pt") -> DataFrame:
    """path, size, mtime (seconds), step of the files of a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return with_step(found.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("mtime"))).withColumn("mtime", F.col("mtime") / 1e6)


def whole_archives(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose content is a zip archive that can be read to its end; the first bytes are looked at before Python is asked."""

    @arrow_udf("boolean")
    def readable(blobs: pa.Array) -> pa.Array:
        def check(blob: bytes | None) -> bool:
            try:
                with zipfile.ZipFile(io.BytesIO(blob or b"")) as archive:
                    return archive.testzip() is None
            except (zipfile.BadZipFile, OSError, EOFError, ValueError):
                return False

        return pa.array([check(b) for b in blobs.to_pylist()])

    return files.where(F.substring(content, 1, 2) == F.lit(b"PK")).where(readable(F.col(content)))
