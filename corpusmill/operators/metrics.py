"""Token-weighted evaluation metrics, tokenizer reports and their gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def pillar_metrics(windows: DataFrame, pillar: str = "pillar") -> DataFrame:
    """Per pillar, and over all (pillar null), from one row per window: document, loss (summed over its tokens), tokens."""
    rolled = windows.rollup(pillar).agg(
        F.sum("loss").alias("loss_sum"), F.sum("tokens").alias("tokens"), F.countDistinct("document").alias("documents"), F.count("document").alias("windows")
    )
    mean = F.col("loss_sum") / F.greatest(F.col("tokens"), F.lit(1))
    return rolled.withColumn("loss", mean).withColumn("perplexity", perplexity(mean))


def ratio_report(samples: DataFrame) -> DataFrame:
    """Samples (name, base_tokens, custom_tokens, …) with the ratio of their tokens; null where the base has none."""
    return samples.withColumn("ratio", F.when(F.col("base_tokens") > 0, F.col("custom_tokens") / F.col("base_tokens")))


def failures(
    report: DataFrame, max_average: float | None = None, max_sample: float | None = None, roundtrip: bool = False,
    normalized_roundtrip: bool = False, max_unknown: float | None = None, max_markers: int | None = None,
) -> DataFrame:
    """gate, message: one row per limit that the report (name, ratio, roundtrip_exact, roundtrip_normalized, unk_ratio, byte_markers) breaks."""
    gates: list[DataFrame] = []

    def gate(name: str, rows: DataFrame, message: Column) -> None:
        gates.append(rows.select(F.lit(name).alias("gate"), message.alias("message")))

    number = lambda c: F.format_string("%.3f", c)
    named = F.concat(F.lit("sample '"), F.col("name"), F.lit("' "))
    if max_average is not None:
        mean = report.agg(F.avg("ratio").alias("mean"))
        none = F.lit("average ratio unavailable (all base token counts were zero)")
        above = F.concat(F.lit("average ratio "), number(F.col("mean")), F.lit(f" exceeded max-average-ratio {max_average:.3f}"))
        gate("average", mean.where(F.col("mean").isNull() | (F.col("mean") > max_average)), F.coalesce(F.when(F.col("mean").isNull(), none), above))
    if max_sample is not None:
        gate("sample", report.where(F.col("ratio") > max_sample), F.concat(named, F.lit("ratio "), number(F.col("ratio")), F.lit(f" exceeded max-sample-ratio {max_sample:.3f}")))
    if roundtrip:
        gate("roundtrip", report.where(~F.coalesce("roundtrip_exact", F.lit(False))), F.concat(named, F.lit("failed exact roundtrip")))
    if normalized_roundtrip:
        gate("normalized", report.where(~F.coalesce("roundtrip_normalized", F.lit(False))), F.concat(named, F.lit("failed normalized roundtrip")))
    if max_unknown is not None:
        gate("unknown", report.where(F.col("unk_ratio") > max_unknown), F.concat(named, F.lit("custom unk ratio "), number(F.col("unk_ratio")), F.lit(f" exceeded max-unk-ratio {max_unknown:.3f}")))
    if max_markers is not None:
        gate("markers", report.where(F.col("byte_markers") > max_markers), F.concat(named, F.lit("byte marker count "), F.col("byte_markers").cast("string"), F.lit(f" exceeded max-byte-markers {max_markers}")))
    if not gates:
        return report.select(F.lit("").alias("gate"), F.lit("").alias("message")).limit(0)
    return reduce(DataFrame.unionByName, gates)
