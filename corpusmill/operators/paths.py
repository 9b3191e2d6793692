"""Paths: domains, training steps and a common spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The domains, in the order in which a path is tested for them.
DOMAINS = ("logic", "code", "tools", "web", "other")


def forward_slashes(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def infer_domain(path: Column) -> Column:
    """Domain of a shard: the first of the named folders found in its path, else ``other`` (also for null)."""
    p = forward_slashes(path)
    rule = F.when(F.contains(p, F.lit(f"/{DOMAINS[0]}/")), DOMAINS[0])
    for name in DOMAINS[1:-1]:
        rule = rule.when(F.contains(p, F.lit(f"/{name}/")), name)
    return rule.otherwise(DOMAINS[-1])


def checkpoint_step(path: Column) -> Column:
    """Step of ``…step_<n>.pt``; -1 for other names and null."""
    return F.coalesce(F.expr("try_cast(null as bigint)"), F.regexp_extract(path, r"step_(\d+)\.pt\z", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def common_path(path: Column) -> Column:
    """One spelling per folder: forward slashes, lower case, no drive, mount, ``.`` or doubled slash; starts and ends with ``/``."""
    p = F.regexp_replace(forward_slashes(path), r"/(\./)+|/{2,}", "/")
    p = F.regexp_replace(p, r"^[a-z]:/data/", "/local_data/")
    p = F.regexp_replace(p, r"^\./|^[a-z]:/|^/mnt/", "/")
    return F.concat(F.lit("/"), F.regexp_replace(p, r"^/+|/+$", ""), F.lit("/"))
