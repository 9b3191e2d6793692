"""External tokenizers and models behind Arrow functions, and the reports made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusmill.functions.text import byte_markers, collapse_space, trim_text
from corpusmill.operators.metrics import ratio_report


class Tokenizer(Protocol):
    """What the operators ask of a tokenizer. Ids that it lacks are None."""

    eos_id: int | None
    pad_id: int | None
    unk_id: int | None

    def encode(self, text: str) -> list[int]: ...
    def decode(self, ids: list[int]) -> str: ...


class PieceTokenizer:
    """A SentencePiece model; its bytes travel, so that workers need no file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()
        self._open()

    def _open(self) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        known = lambda i: None if i < 0 else i
        self.eos_id, self.pad_id, self.unk_id = known(self.model.eos_id()), known(self.model.pad_id()), known(self.model.unk_id())

    def __getstate__(self) -> bytes:
        return self.proto

    def __setstate__(self, proto: bytes) -> None:
        self.proto = proto
        self._open()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


class CodePoints:
    """A tokenizer without a vocabulary: an id per code point, shifted past its special ids; for tests and dry runs."""

    eos_id, pad_id, unk_id = 0, 1, 2

    def encode(self, text: str) -> list[int]:
        return [ord(c) + 3 if ord(c) < 0x10000 else 2 for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(chr(i - 3) if i >= 3 else "�" for i in ids)


class Utf8Bytes:
    """A tokenizer of UTF-8 bytes, shifted past its special ids."""

    eos_id, pad_id, unk_id = 0, 1, 2

    def encode(self, text: str) -> list[int]:
        return [b + 3 for b in text.encode("utf-8", "replace")]

    def decode(self, ids: list[int]) -> str:
        return bytes(i - 3 for i in ids if i >= 3).decode("utf-8", "replace")


def ids_of(tokenizer: Tokenizer, text: Column) -> Column:
    """Token ids, an Arrow batch at a time; null for null."""

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else tokenizer.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(text)


def text_of(tokenizer: Tokenizer, ids: Column) -> Column:
    @arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else tokenizer.decode(x) for x in lists.to_pylist()], pa.string())

    return decode(ids)


def within_tokens(tokenizer: Tokenizer, text: Column, most: int) -> Column:
    """A text cut to its first ``most`` tokens; shorter ones as they are."""
    ids = ids_of(tokenizer, text)
    return F.when(F.size(ids) > most, text_of(tokenizer, F.slice(ids, 1, most))).otherwise(text)


def first_id(tokenizer: Tokenizer, text: str, fallback: str | None = None) -> int:
    """The first id of a text, else of another, else the tokenizer's end, padding or unknown id, else 0."""
    for candidate in (text, fallback):
        if candidate is not None and (ids := tokenizer.encode(candidate)):
            return ids[0]
    return next((i for i in (tokenizer.eos_id, tokenizer.pad_id, tokenizer.unk_id) if i is not None), 0)


def compare(samples: DataFrame, base: Tokenizer, custom: Tokenizer) -> DataFrame:
    """Tokenizer report of samples (name, text): token counts and their ratio, round trips, unknown ids, byte markers, previews."""
    unknown = F.lit(-1 if custom.unk_id is None else custom.unk_id)
    both = samples.select("name", "text", ids_of(base, F.col("text")).alias("base_ids"), ids_of(custom, F.col("text")).alias("custom_ids"))
    both = both.withColumn("decoded", text_of(custom, F.col("custom_ids")))
    unks = F.size(F.filter("custom_ids", lambda i: i == unknown))
    return ratio_report(both.select(
        "name", F.length("text").alias("chars"), F.size("base_ids").alias("base_tokens"), F.size("custom_ids").alias("custom_tokens"),
        (F.col("decoded") == F.col("text")).alias("roundtrip_exact"), (collapse_space(F.col("decoded")) == collapse_space(F.col("text"))).alias("roundtrip_normalized"),
        unks.alias("unk_count"), F.when(F.size("custom_ids") > 0, unks / F.size("custom_ids")).otherwise(0.0).alias("unk_ratio"),
        byte_markers(F.col("decoded")).alias("byte_markers"), F.substring("decoded", 1, 160).alias("preview"),
        F.slice("base_ids", 1, 20).alias("first_base_ids"), F.slice("custom_ids", 1, 20).alias("first_custom_ids"),
    ))


def prompts(texts: DataFrame, templates: dict[str, str], text: str = "text") -> DataFrame:
    """Every text under every strategy: strategy, source, prompt. ``{text}`` is replaced once and for all; other braces stay."""
    each = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v).alias("template")) for k, v in templates.items()])
    spread = texts.withColumn("__s", F.explode(each))
    return spread.select("__s.strategy", F.col(text).alias("source"), F.replace("__s.template", F.lit("{text}"), F.col(text)).alias("prompt"))


Generate = Callable[[list[str]], list[str]]


def generate(prompts_: DataFrame, make: Generate, keep: tuple[str, ...] = ("strategy", "source")) -> DataFrame:
    """Completions of a model that workers call a batch at a time; blank ones are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in prompts_.schema.fields}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[list(keep)].assign(generated=make(part["prompt"].tolist()))

    made = prompts_.select(*keep, "prompt").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", generated string")
    return made.withColumn("generated", trim_text(F.col("generated"))).where("generated is not null")


def score_windows(windows: DataFrame, loss: Callable[[list[list[int]]], list[float]], ids: str = "ids") -> DataFrame:
    """Windows with ``loss`` of their next tokens, summed, from a model that workers call; and ``tokens`` predicted."""

    @arrow_udf("double")
    def scored(lists: pa.Array) -> pa.Array:
        return pa.array(loss(lists.to_pylist()), pa.float64())

    return windows.withColumn("loss", scored(F.col(ids))).withColumn("tokens", F.size(ids) - 1)
