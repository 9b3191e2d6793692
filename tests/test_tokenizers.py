import os
import pickle

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tokenizers as tk


def test_first_id_falls_back():
    class Nothing(tk.CodePoints):
        eos_id, pad_id, unk_id = None, 5, 2

        def encode(self, text):
            return []

    assert tk.first_id(tk.CodePoints(), "a") == ord("a") + 3
    assert tk.first_id(tk.CodePoints(), "", "b") == ord("b") + 3
    assert tk.first_id(Nothing(), "a", "b") == 5


def test_report(spark):
    samples = spark.createDataFrame([("a", "é😀"), ("e", "")], "name string, text string")
    rows = {r["name"]: r for r in tk.compare(samples, tk.Utf8Bytes(), tk.CodePoints()).collect()}
    assert (rows["a"]["base_tokens"], rows["a"]["custom_tokens"], rows["a"]["unk_count"], rows["a"]["roundtrip_exact"]) == (6, 2, 1, False)
    assert rows["e"]["ratio"] is None and rows["e"]["unk_ratio"] == 0.0


def test_cut_and_generate(spark):
    df = spark.createDataFrame([("abc",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(tk.within_tokens(tk.CodePoints(), F.col("text"), 2)).collect()] == ["ab", None, ""]
    made = tk.generate(tk.prompts(df.where("text <> ''"), {"x": "<{text}>{other}"}), lambda ps: [p if "c" in p else " " for p in ps])
    assert [tuple(r) for r in made.collect()] == [("x", "abc", "<abc>{other}")]


def test_scored_windows(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    assert tuple(tk.score_windows(df, lambda lists: [float(sum(x)) for x in lists]).select("loss", "tokens").first()) == (6.0, 2)


def test_piece_model_travels(spark):
    path = "/opt/tokenizers/piece_bpe_32k.model"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    model = tk.PieceTokenizer(path)
    text = "A guide to rivers"
    assert pickle.loads(pickle.dumps(model)).encode(text) == model.encode(text)
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tk.text_of(model, tk.ids_of(model, F.col("text")))).first()[0] == text
