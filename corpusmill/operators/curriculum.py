"""Phases of training: boundaries, learning rates, token counts, source mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundaries(phases: DataFrame, steps: int) -> DataFrame:
    """Each phase with lo, hi (steps), and its place: running sums of whole shares of ``steps``."""
    by = Window.orderBy("phase")  # a row per phase
    hi = F.sum(F.floor(F.lit(steps) * F.col("pct") + 1e-9)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return phases.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0))).withColumn("place", F.row_number().over(by) - 1)


def schedule(steps: DataFrame, phases: DataFrame, total: int, peak: float, end: float) -> DataFrame:
    """Learning rates and context of every step: a rise, two plateaus, a cosine descent; ``Complete`` after the last phase.

    The phases, a few rows of configuration, become one array that each step looks itself up in.
    """
    rows = boundaries(phases, total).agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi", "ctx", "phase"))).alias("phases"))
    looked = steps.join(F.broadcast(rows)).withColumn("at", F.get(F.filter("phases", lambda p: F.col("step") < p["hi"]), F.lit(0)))
    progress = (F.col("step") - F.col("at.lo")) / (F.col("at.hi") - F.col("at.lo"))
    place = F.col("at.place")
    lr = (
        F.when(place.isNull(), end)
        .when(place == 0, end + progress * (peak - end))
        .when(place <= 2, peak)
        .otherwise(end + (peak - end) * 0.5 * (1 + F.cos(F.pi() * progress)))
    )
    return looked.select(
        *steps.columns, lr.alias("lr"), (lr * 0.1).alias("core_lr"), F.coalesce("at.ctx", F.element_at("phases", -1)["ctx"]).alias("ctx"),
        F.coalesce("at.phase", F.lit("Complete")).alias("phase"),
    )


def tokens_per_step(ctx: Column, batch: int, accumulation: int) -> Column:
    return ctx * (batch * accumulation)


def phase_mix(phase: Column, mixes: dict[str, list[str]], default: str = "Phase_2") -> Column:
    """Sources of a phase; a phase without a mix has the default's."""
    table = F.create_map(*[x for k, v in mixes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, phase), F.try_element_at(table, F.lit(default)))
