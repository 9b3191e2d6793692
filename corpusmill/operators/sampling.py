"""Quotas, shares, head and tail selection, shuffles and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.paths import DOMAINS
from corpusmill.operators.prefix import running_total


def first_seen(df: DataFrame, value: str, order: str, out: str = "place") -> DataFrame:
    """Distinct values in the order in which they are first seen: value, ``first`` (its order there) and ``place`` from 0. A null is a value."""
    firsts = df.groupBy(value).agg(F.min(order).alias("first")).withColumn("__one", F.lit(1))
    placed = running_total(firsts, "__one", ["first"], out=out)
    return placed.withColumn(out, F.col(out) - 1).drop("__one")


def normalise_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights of all domains, scaled to sum to 1."""
    if missing := [d for d in DOMAINS if d not in weights]:
        raise ValueError(f"weights lack {', '.join(missing)}")
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative and need a positive sum")
    total = sum(weights.values())
    return {d: w / total for d, w in weights.items()}


def largest_remainder(shares: DataFrame, total: int, name: str = "domain", weight: str = "weight", order: str = "ord") -> DataFrame:
    """``quota`` of each share: the floor, and one more for the largest fractions until the total is reached; ties in ``order``."""
    every = Window.partitionBy()  # as many rows as domains
    exact = shares.withColumn("__exact", F.col(weight) / F.sum(weight).over(every) * total)
    floors = exact.withColumn("__floor", F.floor("__exact")).withColumn("__left", F.lit(total) - F.sum("__floor").over(every))
    nth = F.row_number().over(Window.orderBy(F.desc(F.col("__exact") - F.col("__floor")), order))
    return floors.withColumn("quota", (F.col("__floor") + F.when(nth <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__exact", "__floor", "__left")


def within_quota(docs: DataFrame, quotas: DataFrame, order: list[str], domain: str = "domain") -> DataFrame:
    """The first documents of each domain, as many as its quota; ranks are running totals, so a large domain spreads over tasks."""
    ranked = running_total(docs.withColumn("__one", F.lit(1)), "__one", order, [domain], "nth").drop("__one")
    return ranked.join(F.broadcast(quotas.select(domain, "quota")), domain).where(F.col("nth") <= F.col("quota"))  # a row per domain


def domain_lines(docs: DataFrame, domain: str = "domain") -> DataFrame:
    """Lines of every domain, zeros included, and the total."""
    spark = docs.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias(domain))
    counted = known.join(docs.groupBy(domain).agg(F.count(F.lit(1)).alias("n")), domain, "left").fillna(0, ["n"])
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy()))  # five rows


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last rows, in their order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def selection_indices(total: int, requested: int, selection: str) -> range:
    if requested <= 0 or total <= 0:
        raise ValueError("row counts must be positive")
    if requested > total:
        raise ValueError(f"{requested} rows asked of {total}")
    if selection not in ("head", "tail"):
        raise ValueError(f"unknown selection {selection!r}")
    return range(requested) if selection == "head" else range(total - requested, total)


def rebalance(specs: DataFrame) -> DataFrame:
    """Rows that every pillar can give: the least of requested, hinted and probed rows, and which pillars set it."""
    own = F.least(F.col("rows"), F.coalesce("max_rows_hint", "rows"), F.coalesce("probed", "rows"))
    specs = specs.withColumn("effective_rows", own)
    least = F.min("effective_rows").over(Window.partitionBy())  # a row per pillar
    return specs.withColumn("balanced_rows", least).withColumn("limiting", F.col("effective_rows") == least)


def shuffled_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``rank`` from 0 in an order drawn by hash; ranks are running totals over ranges of it."""
    drawn = df.withColumn("draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).withColumn("__one", F.lit(1))
    return running_total(drawn, "__one", ["draw", key], out="rank").drop("__one").withColumn("rank", F.col("rank") - 1)


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key's hash."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw_streams(draws: DataFrame, streams: DataFrame, seed: int, key: str = "draw") -> DataFrame:
    """The stream of every draw by cumulative weight, its ordinal there, and the element it yields, streams running endlessly.

    ``streams``: stream, weight, n (elements). Columns added: stream, ordinal (from 0), element (ordinal modulo n), epoch.
    """
    upto = F.sum("weight").over(Window.orderBy("stream").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("weight").over(Window.partitionBy())
    # A row per stream; cumulative weights become one array, looked up in every draw without a join.
    bounds = streams.where("weight > 0 and n > 0").withColumn("hi", upto / total).agg(F.array_sort(F.collect_list(F.struct("hi", "stream", "n"))).alias("bounds"))
    u = draws.join(F.broadcast(bounds)).withColumn("u", unit_draw(F.col(key), seed))
    chosen = F.coalesce(F.get(F.filter("bounds", lambda b: F.col("u") < b["hi"]), F.lit(0)), F.element_at("bounds", -1))
    picked = u.withColumn("__b", chosen).select(*draws.columns, "u", F.col("__b.stream").alias("stream"), F.col("__b.n").alias("n"), F.lit(1).alias("__one"))
    counted = running_total(picked, "__one", [key], ["stream"], "nth")
    ordinal = F.col("nth") - 1
    return counted.select(*draws.columns, "stream", ordinal.alias("ordinal"), F.pmod(ordinal, F.col("n")).alias("element"), F.floor(ordinal / F.col("n")).alias("epoch"))


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """A bounded source read ``epochs`` times over."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def take_split(df: DataFrame, rows: int, selection: str, order: list[str], allow_partial: bool = False) -> DataFrame:
    """The head or tail of a split; fewer rows than asked are refused unless ``allow_partial``, none always."""
    there = df.count()
    if there == 0 or (there < rows and not allow_partial):
        raise ValueError(f"{rows} rows asked of {there}")
    return head(df, rows, order) if selection == "head" else tail(df, rows, order)
