"""Problem 2: mixing sources to target weights.

Each phase gets the largest total at which every source that has records can still reach its share under its cap of
repeats, or a total of the caller's. A source whose target exceeds its size is used in complete epochs first; the rest
is an Efraimidis-Spirakis sample: records are ordered by exponential keys divided by their quality, and taken while
their running size stays within what is left of the target.

The running sum needs no global sort. Keys are cut into buckets of equal ratio, so that whatever the qualities are a
bucket holds a small part of a source; sizes are summed by bucket, a running sum over buckets finds the one in which the
target ends, and only that bucket's records are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokens import token_count
from corpusmill.operators.paths import common_path
from corpusmill.session import materialise

#: Buckets for each factor e between keys: no bucket holds more than about 1 in 2.7 x this of the records of one quality.
BUCKETS = 4_096
LEAST_QUALITY = 0.05


def entries(config: DataFrame) -> DataFrame:
    """One row per phase, name and folder: weight, max_repeat. Spellings of phase, name and folder are made alike.

    An entry repeated for a phase, name and folder counts once, the first by entry_id; null or negative weights are 0,
    null or negative repeats 0; entries without phase, name or path are left out.
    """
    clean = config.where("phase is not null and name is not null and path is not null").select(
        F.trim("phase").alias("phase"), F.lower(F.trim("name")).alias("name"), common_path(F.trim("path")).alias("folder"), "entry_id",
        F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).cast("int").alias("max_repeat"),
    )
    first = F.row_number().over(Window.partitionBy("phase", "name", "folder").orderBy("entry_id"))
    return clean.withColumn("nth", first).where("nth = 1").drop("nth", "entry_id")


def names(folders: DataFrame) -> DataFrame:
    """One row per phase and name: the weights of its folders together, the least of their repeats."""
    return folders.groupBy("phase", "name").agg(F.sum("weight").alias("weight"), F.min("max_repeat").alias("max_repeat"))


def quality(text: Column) -> Column:
    """Share of letters in the whole text, not below LEAST_QUALITY: tables, logs and noise are drawn less often."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return F.greatest(F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)), F.lit(LEAST_QUALITY))


def place_records(records: DataFrame, folders: DataFrame) -> DataFrame:
    """Records (id, size, quality, folder) under every phase whose entry's folder is above them; the deepest folder of a phase wins, then the first name.

    Each row is placed on its own: an entry does not take what lies under another of its phase that is nearer to it.
    Records without size or path are left out: they add nothing to any total.
    """
    nearer = F.expr("b.phase = a.phase and startswith(b.folder, a.folder) and (b.folder <> a.folder or b.name < a.name)")
    others = folders.alias("a").join(folders.alias("b"), nearer).groupBy("a.phase", "a.name", "a.folder").agg(F.collect_set("b.folder").alias("nearer"))
    entries_ = folders.join(others, ["phase", "name", "folder"], "left")
    parts = F.split("folder", "/")  # an empty part at either end
    upward = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, n), "/"), F.lit("/")))
    sized = records.where("size > 0 and folder is not null and folder <> '//'").select("id", "size", "quality", F.col("folder").alias("whole"), F.explode(upward).alias("folder"))
    # The entries are configuration: a row for each phase, name and folder.
    joined = sized.join(F.broadcast(entries_), "folder")
    mine = F.col("nearer").isNull() | ~F.exists("nearer", lambda f: F.startswith(F.col("whole"), f))
    return joined.where(mine).select("phase", "name", "id", "size", "quality")


def plan_targets(placed: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per phase and name: available size, target size, epochs that are complete, and the size left to sample."""
    sizes = placed.groupBy("phase", "name").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("n_records"))
    phase = Window.partitionBy("phase")
    both = targets.join(sizes, ["phase", "name"], "left").fillna(0, ["available", "n_records"])
    usable = (F.col("weight") > 0) & (F.col("available") > 0) & (F.col("max_repeat") > 0)
    share = F.when(usable, F.col("weight") / F.sum(F.when(usable, F.col("weight"))).over(phase)).otherwise(0.0)
    both = both.withColumn("asked_share", F.when(F.sum("weight").over(phase) > 0, F.col("weight") / F.sum("weight").over(phase)).otherwise(0.0)).withColumn("share", share)
    room = F.when(F.col("share") > 0, F.col("available") * F.col("max_repeat") / F.col("share"))
    whole = F.lit(float(total)) if total is not None else F.floor(F.min(room).over(phase) + 1e-6)
    target = F.least(F.col("share") * F.coalesce(whole, F.lit(0.0)), F.col("available") * F.col("max_repeat").cast("double"))
    both = both.withColumn("target", F.coalesce(target, F.lit(0.0)))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("target") / F.col("available") + 1e-9).cast("int")).otherwise(0)
    return both.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("available"), F.lit(0.0)))


def mix(records: DataFrame, config: DataFrame, total: int | None = None, seed: int = 0, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(selection, plan). Selection: phase, name, id, size, uses; plan: a row per phase and name, from ``plan_targets``.

    A record is taken in the last, partial epoch if more than half of it lies within the target, so a source misses its
    share by half a record at most. Ties of keys are broken by a second hash; rows repeated under one id are drawn each
    on their own. Empty tables give an empty selection.
    """
    folders = entries(config)
    targets = names(folders)
    placed = place_records(records, folders)
    unit = (F.xxhash64(F.lit(seed), "phase", "name", "id").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    placed = placed.withColumn("key", -F.log(unit) / F.col("quality")).withColumn("bucket", F.floor(F.log("key") * buckets).cast("int"))
    placed = materialise(placed.drop("quality"))
    plan = materialise(plan_targets(placed, targets, total))
    wanted = F.broadcast(plan.where("target > 0").select("phase", "name", "epochs", "rest"))  # as many rows as the configuration
    sums = placed.groupBy("phase", "name", "bucket").agg(F.sum("size").alias("held"))
    before = F.sum("held").over(Window.partitionBy("phase", "name").orderBy("bucket")) - F.col("held")
    edge = sums.withColumn("before", before).join(wanted, ["phase", "name"]).where("before < rest and before + held >= rest")
    edge = edge.select("phase", "name", F.col("bucket").alias("last"), "before")
    chosen = placed.join(wanted, ["phase", "name"]).join(F.broadcast(edge), ["phase", "name"], "left")
    certain = chosen.where("last is null or bucket <> last").withColumn("extra", F.when(F.col("bucket") < F.col("last"), 1).otherwise(0))
    tie = F.xxhash64(F.lit(seed + 1), "phase", "name", "id")
    order = Window.partitionBy("phase", "name").orderBy("key", tie, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = chosen.where("bucket = last").withColumn("upto", F.sum("size").over(order))
    split = split.withColumn("extra", F.when(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    picked = certain.unionByName(split).withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0")
    return picked.select("phase", "name", "id", "size", "uses"), plan


def shares(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Per phase and name: the share asked for and the one got, records and uses, most uses of a record against the cap."""
    got = selection.groupBy("phase", "name").agg(
        F.sum(F.col("size") * F.col("uses")).alias("size_used"), F.count(F.lit(1)).alias("records_used"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses")
    )
    both = plan.join(F.broadcast(got), ["phase", "name"], "left").fillna(0, ["size_used", "records_used", "uses", "most_uses"])
    all_used = F.sum("size_used").over(Window.partitionBy("phase"))
    return both.select(
        "phase", "name", "weight", "max_repeat", "n_records", "available", "asked_share", F.col("share").alias("target_share"), "target", "size_used",
        F.when(all_used > 0, F.col("size_used") / all_used).otherwise(0.0).alias("actual_share"), "records_used", "uses", "most_uses",
    )


def document_records(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Documents as records: size in tokens, quality from the share of letters, folder from the path."""
    return documents.select(
        F.col("doc_id").alias("id"), token_count(spark, F.col("text")).alias("size"), quality(F.col("text")).alias("quality"), common_path(F.col("path")).alias("folder")
    )
