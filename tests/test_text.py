import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.charcodes import char_ids, with_end
from corpusmill.operators import vocabulary


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


def test_canonical_text_of_schemas(spark):
    def canon(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [r[0] for r in df.select(tx.canonical_text(df)).collect()]

    chat = "messages array<struct<role string, content string>>"
    assert canon([([("user", "Hello"), ("assistant", "Hi")],)], chat) == ["user: Hello\nassistant: Hi"]
    assert canon([("2+2?", "4")], "problem string, solution string") == ["Problem: 2+2?\nSolution: 4"]
    assert canon([("h", ["Step 1", "Step 2"])], "hypothesis string, proofs array<string>") == ["Hypothesis: h\nProof: Step 1 Step 2"]
    assert canon([("a", "longest one")], "short string, long string") == ["longest one"]
    assert canon([("", "x")], "text string, content string") == [""]
    assert canon([("", "x"), (None, "y"), (None, None)], "text string, other string") == ["", "y", ""]
    assert canon([(3,)], "n int") == [""]


@pytest.mark.parametrize(
    ("names", "found"), [(["text"], "text"), (["prompt", "content"], "content"), (["custom"], "custom"), (["question"], "question")]
)
def test_text_column(spark, names, found):
    schema = spark.createDataFrame([], ", ".join(f"{n} string" for n in names)).schema
    assert tx.text_column(schema) == found
    assert tx.text_column(spark.createDataFrame([], "n int").schema) is None


def test_strip_and_trim(spark):
    df = spark.createDataFrame([("\u3000 a b \u2009\n",), ("  ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.trim_text(F.col("t"))).collect()] == ["a b", None, None, None]
    assert df.select(tx.trim_text(F.col("t"), 1)).first()[0] == "a"


def test_thoughts(spark):
    assert one(spark, "Preamble. <think>internal</think> Final answer.", "string", tx.without_thoughts) == "Preamble. Final answer."
    df = spark.createDataFrame([("<think> a </think> b ",), ("<think>a",), ("none",), ("<think>x</think>",), (None,)], "c string")
    thought, answer = tx.thought_and_answer(F.col("c"))
    assert [tuple(r) for r in df.select(thought, answer).collect()] == [("a", "b"), (None, None), (None, None), ("x", ""), (None, None)]


def test_ratio_text(spark):
    df = spark.createDataFrame([(0.75,), (1.5,), (None,)], "r double")
    assert [r[0] for r in df.select(tx.ratio_text(F.col("r"))).collect()] == ["0.750 (25.0% fewer tokens)", "1.500 (50.0% more tokens)", "n/a"]


def test_byte_markers_and_lengths(spark):
    assert one(spark, "<0x0A>a<0xff>", "string", tx.byte_markers) == 2
    assert one(spark, "é😀", "string", tx.utf8_length) == 6


def test_char_ids(spark):
    expected = [min(ord(c) % 27 + 1, 26) for c in "Hi é😀\n"]
    assert one(spark, "Hi é😀\n", "string", char_ids) == expected
    assert one(spark, "", "string", lambda c: with_end(char_ids(c))) == [0]


def step_by_step(text, allowed):
    """The rule piece by piece, with the state that it is stated in."""
    import regex

    out, before = [], None
    for piece in regex.findall(r"[\t-\r\x1c-\x20\x85\p{Z}]+|[\p{L}\p{N}_]+|(?s:.)", text):
        if regex.match(r"[\t-\r\x1c-\x20\x85\p{Z}]", piece):
            now, kind = ("\n", "line") if "\n" in piece else (" ", "blank")
        elif regex.match(r"[\p{L}\p{N}_]", piece) and piece not in allowed:
            now, kind = ("" if before in (None, "blank") else " "), "refused"
        else:
            now, kind = (" " if before == "kept" else "") + piece, "kept"
        out.append(now)
        before = kind
    return "".join(out).strip() or None


def test_normalise_both_ways(spark):
    draw = random.Random(4)
    words = ["alpha", "beta", "x_1", "été", "+", "==", " ", "  ", "\n", " \n ", ".", "(", "9"]
    texts = ["".join(draw.choice(words) for _ in range(draw.randint(0, 25))) for _ in range(150)] + ["alpha + beta == gamma", "", "beta"]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    allowed = spark.createDataFrame([("alpha",), ("été",), ("x_1",)], "word string")
    expected = {i: step_by_step(t, {"alpha", "été", "x_1"}) for i, t in enumerate(texts)} | {len(texts): None}
    for way in (vocabulary.normalise, vocabulary.normalise_by_join):
        assert {r["doc_id"]: r["normalised"] for r in way(docs, allowed).collect()} == expected


def test_allowed_words_and_pruning(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 10), ("d", 5)], "word string, cnt long")
    assert [r["word"] for r in vocabulary.allowed_words(counts, 1, 2).collect()] == ["a", "b"]
    counts = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], "word string, cnt long")
    assert tuple(vocabulary.prune_threshold(counts, 2).first()) == (4, 2)


def test_byte_budget_keeps_the_crossing_document(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(10)], "doc_id long, text string")
    assert vocabulary.within_bytes(docs, 350, ["doc_id"]).count() == 4
    assert vocabulary.within_bytes(docs.limit(0), 350, ["doc_id"]).count() == 0


@pytest.mark.parametrize(("n", "docs", "chars", "sizes"), [(5, 2, 10**6, [2, 2, 1]), (5, 99, 250, [3, 2])])
def test_greedy_batches(spark, n, docs, chars, sizes):
    df = spark.createDataFrame([("s", i, "x" * 100) for i in range(n)], "stream string, doc_id long, text string")
    out = vocabulary.greedy_batches(df, docs, chars, "stream", "doc_id")
    assert [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()] == sizes
