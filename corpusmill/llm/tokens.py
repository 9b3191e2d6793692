"""Problem 1: token budgets under an existing vocabulary.

A vocabulary of byte strings is matched longest-first inside each pre-token. The matcher is a trie whose nodes carry a
failure link and the number of tokens emitted when that link is taken, so that a text costs one step per byte plus one
per emitted token, however the vocabulary looks. The same machinery sizes documents exactly under byte-pair merges,
where a count per pre-token is looked up in place of the trie.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusmill.operators.paths import infer_domain

#: Folder of the vocabulary files on the driver; only their content travels to the executors.
TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose counts a worker keeps before it starts over; it only saves time.
MEMO_PRETOKENS = 400_000
MEMO_LENGTH = 64

#: The pre-token pattern of the vocabulary, with its Unicode classes written out for the standard library.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


@lru_cache(1)
def _pretokens() -> re.Pattern[str]:
    code = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs = [[x for _, x in g] for _, g in groupby(enumerate(code), lambda p: p[1] - p[0])]
    other = "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)
    letter, number = rf"[^\W\d_{other}]", rf"[\d{other}]"
    rest = rf"(?:(?![{SPACE}])(?:\W|_))"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{rest}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def pretokens(text: str) -> list[str]:
    return (ASCII_PRETOKENS if text.isascii() else _pretokens()).findall(text)


def read_vocabulary(path: str | None = None) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file (base64 and rank on each line), by rank."""
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as lines:
        ranked = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    return [token for _, token in sorted(ranked)]


class LongestMatch:
    """Counts the tokens of longest-match-first splitting in linear time.

    Every single byte is a token even where the vocabulary lacks it, so nothing is left unmatched.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for token in {*vocabulary, *(bytes([b]) for b in range(256))}:
            node = 0
            for byte in token:
                nxt = child[node].get(byte)
                if nxt is None:
                    nxt = child[node][byte] = len(child)
                    child.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        fail, emitted = [-1] * len(child), [0] * len(child)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in child[parent].items():
                    below.append(node)
                    if final[node]:
                        fail[node], emitted[node] = 0, 1
                        continue
                    back, count = fail[parent], emitted[parent]
                    while back >= 0 and byte not in child[back]:
                        count += emitted[back]
                        back = fail[back]
                    if back >= 0:
                        fail[node], emitted[node] = child[back][byte], count
            level = below
        self.child, self.fail, self.emitted = child, fail, emitted

    def __call__(self, text: str) -> int:
        child, fail, emitted = self.child, self.fail, self.emitted
        node = total = 0
        for byte in text.encode("utf-8", "replace"):
            while byte not in child[node]:
                total += emitted[node]
                node = fail[node]
            node = child[node][byte]
        while node:
            total += emitted[node]
            node = fail[node]
        return total


class PretokenCounts(dict):
    """pre-token -> number of tokens; long pre-tokens are counted without being kept."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, pretoken: str) -> int:
        value = self.count(pretoken)
        if len(pretoken) <= MEMO_LENGTH:
            if len(self) >= MEMO_PRETOKENS:
                self.clear()
            self[pretoken] = value
        return value

    def text(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pretokens(text))) if text else 0


def byte_pair_counter(vocabulary: list[bytes]) -> Callable[[str], int]:
    """Exact byte-pair counts of one pre-token."""
    import tiktoken

    coder = tiktoken.Encoding("vocabulary", pat_str=r"(?s:.+)", mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    return lambda pretoken: len(coder.encode_ordinary(pretoken))


_COUNTERS: dict[tuple[str, int], PretokenCounts] = {}


def _counter(kind: str, key: int, vocabulary: list[bytes]) -> PretokenCounts:
    if (kind, key) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[kind, key] = PretokenCounts(LongestMatch(vocabulary) if kind == "longest" else byte_pair_counter(vocabulary))
    return _COUNTERS[kind, key]


def token_count(spark: SparkSession, text: Column, vocabulary: list[bytes] | None = None, kind: str = "longest") -> Column:
    """Tokens of a text column: ``longest`` match through the trie, or ``bpe`` merges.

    Null and empty texts have 0 tokens, text of any length is counted whole. The vocabulary is broadcast; its size is
    that of the file (below 1 MB for the installed ones) and does not depend on the data.
    """
    if kind not in ("longest", "bpe"):
        raise ValueError(f"unknown kind {kind!r}")
    tokens = vocabulary if vocabulary is not None else read_vocabulary()
    key = xxhash.xxh3_64_intdigest(b"\n".join(map(base64.b64encode, tokens)))
    shared = spark.sparkContext.broadcast(tokens)

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counter = _counter(kind, key, shared.value)
        return pa.array([counter.text(x) for x in texts.to_pylist()], pa.int64())

    return count(text)


def clean_lang(lang: Column) -> Column:
    """Two-letter lower-case language; ``und`` where none is known."""
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(F.lower(F.trim(lang)).isin("und", "") | lang.isNull(), "und").otherwise(code)


def clean_source(source: Column) -> Column:
    return F.coalesce(F.lower(F.trim(source)), F.lit("unknown"))


def document_tokens(spark: SparkSession, documents: DataFrame, fineweb: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """One row per record of either table: table_name, row_id, slice, lang, domain, n_tokens.

    Repeated rows stay as they are; a null text has 0 tokens; a null source or dump becomes ``unknown``, a null or odd
    language ``und``, a null path the domain ``other``. Other columns of the tables are ignored.
    """
    docs = documents.select(
        F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), clean_source(F.col("source")).alias("slice"),
        clean_lang(F.col("lang")).alias("lang"), infer_domain(F.col("path")).alias("domain"), "text",
    )
    web = fineweb.select(
        F.lit("fineweb").alias("table_name"), "row_id", clean_source(F.col("dump")).alias("slice"),
        clean_lang(F.col("lang")).alias("lang"), F.lit("web").alias("domain"), "text",
    )
    both = docs.unionByName(web)
    return both.select("table_name", "row_id", "slice", "lang", "domain", token_count(spark, F.col("text"), vocabulary).alias("n_tokens"))


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """Per domain: lines of the latest run that states any, and how many distinct runs do. A run delivered twice counts once."""
    names = ["code", "logic", "other", "tools", "web"]
    long = manifest.select("run_id", "created_at", F.explode(F.array(*[
        F.struct(F.lit(n).alias("domain"), F.col(f"corpus_domain_counts.{n}").alias("lines")) for n in names
    ])).alias("d")).select("run_id", "created_at", "d.*").where("lines is not null")
    return long.groupBy("domain").agg(
        F.max_by("lines", F.struct("created_at", "run_id")).alias("manifest_lines"), F.countDistinct("created_at").alias("manifest_runs")
    )


def token_budget(tokens: DataFrame, manifest: DataFrame) -> DataFrame:
    """Totals per table, slice, language and domain, next to the manifest's lines of the domain (null where it has none)."""
    totals = tokens.groupBy("table_name", "slice", "lang", "domain").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.when(F.col("n_tokens") > 0, 1).otherwise(0)).alias("n_with_text"), F.sum("n_tokens").alias("n_tokens")
    )
    return totals.join(F.broadcast(manifest_lines(manifest)), "domain", "left")  # five rows at most
