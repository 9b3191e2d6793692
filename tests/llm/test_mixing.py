import pytest

from corpusmill.llm import mixing

CONFIG = "entry_id long, phase string, name string, path string, weight double, max_repeat int, extra string"
RECORDS = "id long, size long, quality double, folder string, name string"


def config(spark, *rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], CONFIG)


def test_shares_are_reached_and_caps_kept(spark):
    records = spark.createDataFrame([(i, 10 + i % 7, 0.05 + (i % 10) / 10, f"/root/{'big' if i % 10 else 'small'}/f.parquet/", "clash") for i in range(4000)], RECORDS)
    plan = config(spark, ("P", "big", "root/big", 0.6, 1), ("P", "Small ", "./root/small/", 0.4, 3), ("P", "none", "root/none", 0.3, 4), ("P", "big", "root/big", 9.0, 9), ("Q", "zero", "root/big", 0.0, 1), (None, "x", "x", 1.0, 1))
    selection, targets = mixing.mix(records, plan, seed=3, buckets=64)
    rows = {r["name"]: r for r in mixing.shares(selection, targets).where("phase = 'P'").collect()}
    assert rows["big"]["actual_share"] == pytest.approx(0.6, abs=0.002) and rows["small"]["actual_share"] == pytest.approx(0.4, abs=0.002)
    assert rows["small"]["most_uses"] == 3 and rows["big"]["most_uses"] == 1 and rows["none"]["actual_share"] == 0
    assert selection.where("phase = 'Q'").count() == 0


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_selection_is_the_prefix_of_the_keys(spark, buckets):
    """Against sorting all keys at once."""
    records = spark.createDataFrame([(i, 1 + (i * 37) % 50, 0.05 + (i % 9) / 10, "/r/a/", "n") for i in range(500)], RECORDS)
    selection, _ = mixing.mix(records, config(spark, ("P", "a", "r/a", 1.0, 2)), total=16_000, seed=5, buckets=buckets)
    got = {r["id"]: r["uses"] for r in selection.collect()}
    from pyspark.sql import functions as F

    unit = (F.xxhash64(F.lit(5), F.lit("P"), F.lit("a"), "id").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = sorted((r["k"], r["id"], r["size"]) for r in records.withColumn("k", -F.log(unit) / F.col("quality")).collect())
    whole = sum(s for _, _, s in keyed)
    epochs, rest, expected, upto = 16_000 // whole, 16_000 % whole, {}, 0
    for _, i, s in keyed:
        expected[i] = epochs + (upto + s / 2 <= rest)
        upto += s
    assert got == {i: n for i, n in expected.items() if n}


def test_quality_weighs_the_sample(spark):
    records = spark.createDataFrame([(i, 1, 1.0 if i % 2 else 0.1, "/r/a/", "n") for i in range(4000)], RECORDS)
    selection, _ = mixing.mix(records, config(spark, ("P", "a", "r/a", 1.0, 1)), total=1000, seed=1)
    good = sum(r["id"] % 2 for r in selection.collect())
    assert good > 800  # keys of the good half are ten times as early


def test_a_total_beyond_the_caps_is_reported_short(spark):
    records = spark.createDataFrame([(1, 10, 1.0, "/r/a/", "n"), (2, 90, 1.0, "/r/b/", "n")], RECORDS)
    selection, targets = mixing.mix(records, config(spark, ("P", "a", "r/a", 0.5, 2), ("P", "b", "r/b", 0.5, 1)), total=100)
    out = {r["name"]: r for r in mixing.shares(selection, targets).collect()}
    assert out["a"]["size_used"] == 20 and out["a"]["target_share"] == 0.5 and out["a"]["actual_share"] < 0.5


def test_deeper_folder_wins(spark):
    records = spark.createDataFrame([(1, 10, 1.0, "/r/a/", "n"), (2, 10, 1.0, "/r/a/deep/x/", "n")], RECORDS)
    selection, _ = mixing.mix(records, config(spark, ("P", "all", "r/a", 1.0, 1), ("P", "deep", "r/a/deep", 1.0, 1)))
    assert {(r["name"], r["id"]) for r in selection.collect()} == {("all", 1), ("deep", 2)}


def test_a_name_with_two_folders(spark):
    records = spark.createDataFrame([(i, 10, 1.0, f"/r/{'abc'[i % 3]}/", "n") for i in range(300)], RECORDS)
    selection, targets = mixing.mix(records, config(spark, ("P", "ab", "r/a", 1.0, 2), ("P", "AB", "r/b", 1.0, 1), ("P", "c", "r/c", 2.0, 1)))
    out = {r["name"]: r for r in mixing.shares(selection, targets).collect()}
    assert out["ab"]["n_records"] == 200 and out["ab"]["target_share"] == 0.5 and out["ab"]["actual_share"] == pytest.approx(0.5, abs=0.01) and out["ab"]["most_uses"] == 1


def test_odd_rows_and_empty_tables(spark):
    records = spark.createDataFrame([(1, 0, 1.0, "/r/a/", "n"), (2, 5, 0.05, None, "n"), (3, 5, 0.05, "/r/a/", None), (3, 5, 0.05, "/r/a/", None), (4, 5, 0.5, "//", "n")], RECORDS)
    plan = config(spark, ("P", "a", "r/a", 1.0, 1), ("P", "b", None, 1.0, 1), ("P", "c", "r/c", None, None))
    selection, targets = mixing.mix(records, plan)
    assert [r["id"] for r in selection.collect()] == [3, 3]
    assert mixing.shares(selection, targets).count() == 2
    for r, c in ((records.limit(0), plan), (records, plan.limit(0))):
        selection, targets = mixing.mix(r, c)
        assert selection.count() == 0 and mixing.shares(selection, targets).where("size_used > 0").count() == 0


def test_document_records(spark):
    docs = spark.createDataFrame([(1, "abc 12", "x/y"), (2, None, None), (3, "", "x")], "doc_id long, text string, path string")
    out = {r["id"]: r for r in mixing.document_records(spark, docs).collect()} if __import__("os").path.exists("/opt/tokenizers") else None
    if out is None:
        pytest.skip("no vocabulary files here")
    assert out[1]["quality"] == 0.5 and out[2]["quality"] == mixing.LEAST_QUALITY and out[2]["size"] == 0 and out[3]["size"] == 0


def test_rows_repeated_under_one_id_stay_with_nested_folders(spark):
    """Each row on its own, whether or not an entry lies under another."""
    records = spark.createDataFrame([(1, 10, 1.0, "/r/a/", "n"), (1, 10, 1.0, "/r/a/", "n"), (2, 10, 1.0, "/r/a/deep/", "n"), (2, 10, 1.0, "/r/a/deep/", "n")], RECORDS)
    for more, expected in (((), [("all", 1), ("all", 1), ("all", 2), ("all", 2)]), ((("P", "deep", "r/a/deep", 1.0, 1), ("P", "also deep", "r/a/deep", 1.0, 1)), [("all", 1), ("all", 1), ("also deep", 2), ("also deep", 2)])):
        placed = mixing.place_records(records, mixing.entries(config(spark, ("P", "all", "r/a", 1.0, 1), *more)))
        assert sorted((r["name"], r["id"]) for r in placed.collect()) == expected


@pytest.mark.parametrize("quality", [0.05, 0.2, 1.0])
def test_no_bucket_holds_much_of_a_source(spark, quality):
    from pyspark.sql import functions as F

    unit = (F.xxhash64(F.lit(0), "id").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    keys = spark.range(200_000).withColumn("bucket", F.floor(F.log(-F.log(unit) / F.lit(quality)) * mixing.BUCKETS))
    most = keys.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert most < 0.001 * 200_000


def test_what_is_chosen_among_bad_records_has_no_order_of_ids(spark):
    records = spark.range(20_000).selectExpr("id", "1L as size", "0.05D as quality", "'/r/a/' as folder", "'n' as name")
    selection, _ = mixing.mix(records, config(spark, ("P", "a", "r/a", 1.0, 1)), total=10_000)
    chosen = [r["id"] for r in selection.collect()]
    assert len(chosen) == 10_000 and abs(sum(chosen) / len(chosen) - 10_000) < 200
