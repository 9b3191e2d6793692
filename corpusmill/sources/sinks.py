"""Writers: one-file bundles, manifests, line corpora, metrics."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_pillar(df: DataFrame, folder: str) -> int:
    """A held-out pillar as one Parquet file; its rows are counted while they are written. Pillars are bounded by their row budget."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(folder)
    return seen.get["rows"]


def write_json(path: str, value: Any, sort: bool = False) -> None:
    """A document, written beside its place and moved there when it is whole."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    beside = f"{path}.part"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=sort)
    os.replace(beside, path)


def bundle_manifest(preset: str, rows: int, pillars: list[dict], notes: list[str] | None = None) -> dict:
    return {
        "created_at": datetime.now(UTC).isoformat(), "preset": preset, "rows_per_pillar_default": rows,
        "training_alignment_notes": notes or [], "pillars": pillars,
    }


def write_lines(df: DataFrame, folder: str, text: str = "text") -> None:
    """One sentence a line; a text with line breaks becomes several lines."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(folder)


def write_generated(df: DataFrame, folder: str) -> None:
    """strategy, source (its first 500 characters), generated, as JSON lines."""
    df.select("strategy", F.substring("source", 1, 500).alias("source"), "generated").write.mode("overwrite").json(folder)


def append_metrics(df: DataFrame, folder: str) -> None:
    """step, pillar, metric, value, appended."""
    df.select("step", "pillar", "metric", "value").write.mode("append").parquet(folder)


def fill_template(template: str, text: str) -> Column:
    return F.replace(F.lit(template), F.lit("{text}"), F.col(text))
