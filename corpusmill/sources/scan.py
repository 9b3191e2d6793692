"""Readers of corpora whose schemas differ from file to file."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import SYNTHESIS_COLUMNS, canonical_text, strip, text_column

SUFFIXES = (".jsonl", ".json", ".parquet")
#: Characters of a first line that are looked at to tell JSON lines from JSON over several lines; a longer line is one of lines.
LONGEST_HEAD = 1 << 24


def walk_files(root: str, suffixes: tuple[str, ...] = SUFFIXES, follow_links: bool = False) -> list[str]:
    """Data files under ``root``: names sorted, a folder's own files before those of its sub-folders."""
    out = []
    for here, folders, names in os.walk(root, followlinks=follow_links):
        folders.sort()
        out += [os.path.join(here, n) for n in sorted(names) if n.lower().endswith(suffixes)]
    return out


def read_jsonl(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines; blank lines, malformed ones and those that hold no object are left out."""
    return spark.read.option("mode", "DROPMALFORMED").json(paths).transform(_objects)


def _objects(df: DataFrame) -> DataFrame:
    """Rows of which any column is set: lines that hold no object give none."""
    if not df.columns:
        return df
    condition = F.col(f"`{df.columns[0]}`").isNotNull()
    for c in df.columns[1:]:
        condition = condition | F.col(f"`{c}`").isNotNull()
    return df.where(condition)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, by its suffix."""
    lower = path.lower()
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if lower.endswith(".json"):
        return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    raise ValueError(f"no reader for {path}")


def texts_of_file(spark: SparkSession, path: str, order: int = 0) -> DataFrame | None:
    """(file_ord, text) of one file: the preferred string column, stripped; None if it has no string column.

    Only that column is read from Parquet.
    """
    df = read_file(spark, path)
    column = text_column(df.schema)
    if column is None:
        return None
    return df.select(F.lit(order).alias("file_ord"), strip(F.col(column)).alias("text")).where("text <> ''")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """Texts of all data files under ``root``, each file by its own schema, in walk order by ``file_ord``."""
    found = [d for i, p in enumerate(walk_files(root)) if (d := texts_of_file(spark, p, i)) is not None]
    if not found:
        raise FileNotFoundError(f"no texts under {root}")
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


@dataclass(frozen=True)
class Leaf:
    """A source with one schema and its share of the mixture."""

    name: str
    path: str
    format: str
    weight: float


def leaves(name: str, path: str, format: str, weight: float) -> list[Leaf]:
    """Sub-folders that hold files of the format, sharing the weight equally; without any, the folder itself."""
    children = sorted(
        e.path for e in os.scandir(path) if e.is_dir() and any(f.endswith(f".{format}") for _, _, names in os.walk(e.path) for f in names)
    )
    if not children:
        return [Leaf(name, path, format, weight)]
    return [Leaf(f"{name}/{os.path.basename(c)}", c, format, weight / len(children)) for c in children]


def _in_lines(path: str) -> bool:
    """Whether a JSON file's first line that is not blank is a value of its own."""
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        while (line := f.readline(LONGEST_HEAD)) and not line.strip():
            pass
    if len(line) == LONGEST_HEAD:
        return True
    try:
        json.loads(line)
    except (ValueError, RecursionError):
        return not line
    return True


def read_leaf(spark: SparkSession, leaf: Leaf) -> DataFrame:
    """Canonical texts of a leaf: source, text. JSON files may hold lines, or one array or object over several lines, which must be sound."""
    if leaf.format == "json" and (whole := [p for p in walk_files(leaf.path, (".json",)) if not _in_lines(p)]):
        lines = sorted(set(walk_files(leaf.path, (".json",))) - set(whole))
        read = [spark.read.option("multiLine", True).option("mode", "FAILFAST").json(whole)]
        read += [spark.read.option("mode", "DROPMALFORMED").json(lines)] if lines else []
        texts = [df.select(F.lit(leaf.name).alias("source"), canonical_text(df).alias("text")).where("text <> ''") for df in read]
        return texts[0].unionByName(texts[-1]) if lines else texts[0]
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{leaf.format}")
    df = {"parquet": reader.parquet, "json": reader.option("mode", "DROPMALFORMED").json, "jsonl": reader.option("mode", "DROPMALFORMED").json}[leaf.format](leaf.path)
    return df.select(F.lit(leaf.name).alias("source"), canonical_text(df).alias("text")).where("text <> ''")


def tuning_files(root: str, hint: str | None = None, follow_links: bool = True) -> tuple[str, list[str]]:
    """(format, files): those of the hinted format, else Parquet if there is any, else JSON."""
    by = {s: [p for p in walk_files(root, (s,), follow_links)] for s in SUFFIXES}
    if hint:
        if not by.get(f".{hint}"):
            raise FileNotFoundError(f"no .{hint} files under {root}")
        return hint, by[f".{hint}"]
    if by[".parquet"]:
        return "parquet", by[".parquet"]
    if both := sorted(by[".json"] + by[".jsonl"]):
        return "json", both
    raise FileNotFoundError(f"no data files under {root}")


def source_text(df: DataFrame, least: int = 50) -> Column:
    """The first of the synthesis columns whose text is longer than ``least``; null if none is."""
    strings = [n for n in SYNTHESIS_COLUMNS if dict(df.dtypes).get(n) == "string"]
    return F.coalesce(*[F.when(F.length(n) > least, F.col(n)) for n in strings], F.lit(None).cast("string"))


def pick_shard(paths: list[str], patterns: list[str], index: int) -> str:
    """The index-th (negative: from the end) of the sorted files that match the first pattern to match any."""
    for pattern in patterns:
        matched = sorted(p for p in paths if fnmatch.fnmatch(p, pattern))
        if matched:
            if not -len(matched) <= index < len(matched):
                raise IndexError(f"shard {index} of {len(matched)}")
            return matched[index]
    raise FileNotFoundError(f"nothing matches {', '.join(patterns)}")


def read_shard(spark: SparkSession, root: str, spec: Mapping, fallbacks: Sequence[str] = (), allow_partial: bool = False) -> tuple[DataFrame, dict]:
    """The first rows of one shard of a glob, and where they are from.

    ``spec``: rows, file_glob and shard_index (0 if absent; negative ones count from the end) below ``root``. Later patterns are tried
    where the first matches nothing. A shard without rows is refused, and one with fewer than asked for unless
    ``allow_partial``. Rows are counted up to the number asked for, so that a long shard is not read to its end.
    """
    rows, index = int(spec["rows"]), int(spec.get("shard_index", 0))
    tried = list(dict.fromkeys([*([spec["file_glob"]] if "file_glob" in spec else []), *fallbacks]))
    paths = walk_files(root, (".parquet",))
    relative = {os.path.relpath(p, root): p for p in paths}
    chosen = pick_shard(list(relative), tried, index)
    matched = next(p for p in tried if any(fnmatch.fnmatch(x, p) for x in relative))
    shards = sum(fnmatch.fnmatch(x, matched) for x in relative)
    head = spark.read.parquet(relative[chosen]).limit(rows)
    actual = head.count()
    if not actual:
        raise ValueError(f"spec {spec.get('name', '?')}: no rows in shard {index}")
    if actual < rows and not allow_partial:
        raise ValueError(f"spec {spec.get('name', '?')}: {rows} rows asked for, the shard holds {actual}")
    return head, {
        "resolved_file": relative[chosen], "selection": "head", "requested_rows": rows, "actual_rows": actual,
        "shard_count": shards, "shard_index": index % shards, "matched_glob": matched, "tried_globs": tried[: tried.index(matched) + 1],
    }


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """name, text of a JSON list; anything else is refused."""
    df = spark.read.option("multiLine", True).json(path)
    kinds = dict(df.dtypes)
    if kinds.get("name") != "string" or kinds.get("text") != "string":
        raise ValueError("samples need a name and a text, both strings")
    bad = df.where("name is null or text is null").limit(1).count()
    if bad:
        raise ValueError("a sample lacks its name or text")
    return df.select("name", "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Pillars of a bundle manifest, a row each, with ``resolved``: the path as it is, else relative to the manifest's folder."""
    base = os.path.dirname(os.path.abspath(path))
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("pillars").alias("p")).select("p.*")
    there = {r["path"]: r["path"] if os.path.exists(r["path"]) else os.path.join(base, r["path"]) for r in rows.select("path").collect()}
    table = F.create_map(*[F.lit(x) for pair in there.items() for x in pair])
    return rows.withColumn("resolved", table[F.col("path")])
