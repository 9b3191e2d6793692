import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import tokens

ODD = ["", " ", "\n\n", "a" * 5000, "é😀 ½ _x__  \n\n x", "don't I'll", "\u1680\u2003x\u200b", "x²5٣", "tab\tend  "]


def by_hand(text, vocabulary):
    """Longest match by trying every length."""
    data, n = text.encode(), 0
    longest = max(map(len, vocabulary), default=1)
    while data:
        k = next((k for k in range(min(longest, len(data)), 1, -1) if data[:k] in vocabulary), 1)
        data, n = data[k:], n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_against_trying_all(seed):
    draw = random.Random(seed)
    vocabulary = {"".join(draw.choice("abé ") for _ in range(draw.randint(2, 6))).encode() for _ in range(40)}
    count = tokens.LongestMatch(vocabulary)
    for _ in range(400):
        text = "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 30)))
        assert count(text) == by_hand(text, vocabulary), text
    assert count("") == 0


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)):
        pytest.skip("no vocabulary files here")
    return tokens.read_vocabulary()


def test_pretokens_are_the_vocabularys(vocabulary):
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for text in ODD:
        assert tokens.pretokens(text) == pattern.findall(text), text
        assert "".join(tokens.pretokens(text)) == text


def test_byte_pairs_are_exact(vocabulary):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    counts = tokens.PretokenCounts(tokens.byte_pair_counter(vocabulary))
    for text in [*ODD, "The Ulstiim method sorts tariffs into 25 groups. Größe élève"]:
        assert counts.text(text) == len(exact.encode_ordinary(text))


def test_document_tokens_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "x"), (2, "", "EN", " Web ", "C:\\data\\train\\web\\a", "y"), (2, "ab ab", "eng", "web", "/code/b", "z"), (3, "ab" * 50_000, "und", "WEB", None, "z")],
        "doc_id long, text string, lang string, source string, path string, n_tokens string",
    )
    web = spark.createDataFrame([(1, "abab", None, None, 7)], "row_id long, text string, dump string, lang string, domain int")
    out = tokens.document_tokens(spark, docs, web, [b"ab", b" ab"]).collect()
    got = sorted((r["table_name"], r["row_id"], r["slice"], r["lang"], r["domain"], r["n_tokens"]) for r in out)
    assert got == [
        ("documents", 1, "unknown", "und", "other", 0), ("documents", 2, "web", "en", "code", 2), ("documents", 2, "web", "en", "web", 0),
        ("documents", 3, "web", "und", "other", 50_000), ("fineweb", 1, "unknown", "und", "web", 2),
    ]
    assert tokens.document_tokens(spark, docs.limit(0), web.limit(0), [b"ab"]).count() == 0


def test_budget_beside_the_manifest(spark):
    rows = spark.createDataFrame([("documents", 1, "s", "en", "web", 5), ("documents", 2, "s", "en", "web", 0), ("documents", 3, "s", "en", "logic", 4)], "table_name string, row_id long, slice string, lang string, domain string, n_tokens long")
    kind = "run_id long, created_at timestamp_ntz, corpus_domain_counts struct<code long, logic long, other long, tools long, web long>"
    from datetime import datetime

    runs = spark.createDataFrame([(1, datetime(2031, 1, 1), (1, None, 1, 1, 10)), (2, datetime(2031, 1, 2), (1, None, 1, 1, 20)), (3, datetime(2031, 1, 2), (1, None, 1, 1, 20)), (4, datetime(2031, 1, 3), None)], kind)
    out = {r["domain"]: r for r in tokens.token_budget(rows, runs).collect()}
    assert (out["web"]["n_records"], out["web"]["n_with_text"], out["web"]["n_tokens"], out["web"]["manifest_lines"], out["web"]["manifest_runs"]) == (2, 1, 5, 20, 2)
    assert out["logic"]["manifest_lines"] is None


def test_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError):
        tokens.token_count(spark, F.lit("a"), [b"a"], "guess")
