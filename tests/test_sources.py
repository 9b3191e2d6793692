import json
import os

import pytest

from corpusmill.operators import checkpoints, sampling
from corpusmill.sources import scan, sinks
from corpusmill.streaming import streams


def test_walk_order_and_formats(spark, tmp_path):
    for name in ("zdir/b.jsonl", "adir/a.jsonl", "top.parquet", "skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    assert [os.path.relpath(p, tmp_path) for p in scan.walk_files(str(tmp_path))] == ["top.parquet", "adir/a.jsonl", "zdir/b.jsonl"]


def test_jsonl_keeps_objects(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"text": "a"}\nNOT_JSON\n\n"just a string"\n[1,2,3]\n{"text": " b "}\n{"text": "  "}\n')
    assert [r["text"] for r in scan.texts_of_file(spark, str(path)).collect()] == ["a", "b"]


def test_texts_of_mixed_schemas(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, body string").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "a.jsonl").write_text('{"alpha": "1", "content": "c"}\n')
    (tmp_path / "n.jsonl").write_text('{"n": 1}\n')
    out = [(r["file_ord"], r["text"]) for r in scan.texts(spark, str(tmp_path)).orderBy("file_ord").collect()]
    assert [t for _, t in out] == ["c", "x"]
    with pytest.raises(FileNotFoundError):
        scan.texts(spark, str(tmp_path / "none"))


def test_leaves_share_weight(spark, tmp_path):
    for child in ("b", "a"):
        spark.createDataFrame([("t",)], "text string").write.parquet(str(tmp_path / child))
    (tmp_path / "empty").mkdir()
    found = scan.leaves("web", str(tmp_path), "parquet", 0.5)
    assert [(leaf.name, leaf.weight) for leaf in found] == [("web/a", 0.25), ("web/b", 0.25)]
    assert scan.read_leaf(spark, found[0]).first()["text"] == "t"


def test_json_leaves_in_lines_and_over_several_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "array.json").write_text('[\n {"text": "a"},\n {"text": "b"}\n]')
    (tmp_path / "object.json").write_text('\n{\n "text": "c"\n}\n')
    (tmp_path / "sub" / "lines.json").write_text('{"text": "d"}\n{"text": "e"}\nbroken\n')
    (tmp_path / "one.json").write_text('[{"text": "f"}, {"text": "g"}]')
    (tmp_path / "empty.json").write_text("")
    leaf = scan.Leaf("web", str(tmp_path), "json", 1.0)
    assert sorted(r["text"] for r in scan.read_leaf(spark, leaf).collect()) == list("abcdefg")
    (tmp_path / "cut.json").write_text('[\n {"text": "h"},\n {"te')
    with pytest.raises(Exception):
        scan.read_leaf(spark, leaf).collect()


def test_routing_and_shards(tmp_path):
    for name in ("a.parquet", "b.jsonl", "c.json"):
        (tmp_path / name).write_text("")
    assert scan.tuning_files(str(tmp_path))[0] == "parquet"
    assert [os.path.basename(p) for p in scan.tuning_files(str(tmp_path), "json")[1]] == ["c.json"]
    with pytest.raises(FileNotFoundError):
        scan.tuning_files(str(tmp_path / "none"))
    assert scan.pick_shard(["x/2.parquet", "x/1.parquet"], ["y/*", "x/*"], -1) == "x/2.parquet"
    with pytest.raises(IndexError):
        scan.pick_shard(["x/1"], ["x/*"], 1)


def test_samples_and_manifest(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "a", "text": "t"}]))
    assert scan.read_samples(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "a"}]))
    with pytest.raises(ValueError):
        scan.read_samples(spark, str(tmp_path / "bad.json"))
    rows = sinks.write_pillar(spark.range(7), str(tmp_path / "bundle/p"))
    assert rows == 7
    sinks.write_json(str(tmp_path / "bundle/m.json"), sinks.bundle_manifest("x", 7, [{"name": "p", "path": "p", "rows": rows}]), sort=True)
    read = scan.read_manifest(spark, str(tmp_path / "bundle/m.json")).first()
    assert read["name"] == "p" and spark.read.parquet(read["resolved"]).count() == 7


def test_line_and_generated_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "é" * 600, "g", "a\nb")], "strategy string, source string, generated string, text string")
    sinks.write_lines(df, str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]
    sinks.write_generated(df, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).first()["source"] == "é" * 500
    assert df.select(sinks.fill_template("<{text}>", "text")).first()[0] == "<a\nb>"
    sinks.append_metrics(spark.createDataFrame([(1, "p", "loss", 0.5)], "step int, pillar string, metric string, value double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_packing_goes_on_across_micro_batches(spark, tmp_path):
    schema = "stream string, doc_id long, text string"
    docs = [("s", i, "abcde"[: i % 5]) for i in range(20)]
    for n, part in enumerate((docs[:9], docs[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = streams.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        run = streams.pack_stream(source, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query = run.outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120), n
    out = [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("block").collect()]
    text = "".join(t + "\x01" for _, _, t in docs if t)
    assert out == [text[i : i + 5] for i in range(0, len(text) - 4, 5)]


def test_unique_events(spark, tmp_path):
    spark.createDataFrame([(1, "2031-01-01 00:00:00"), (1, "2031-01-01 00:01:00"), (2, "2031-01-01 00:00:00")], "k int, t string").selectExpr("k", "to_timestamp_ntz(t) t").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    assert streams.run_to_table(streams.unique(streams.files(spark, str(tmp_path / "e"), schema), "t", ["k"], "1 hour"), "append").count() == 2


def test_delivery_defers_and_sends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    clock, sent = [0.0], []
    deliver = streams.Delivery(str(tmp_path / "wait"), lambda p: sent.append(os.path.basename(p)) or True, 60, lambda: clock[0])

    def run():
        query = deliver.watch(spark, str(tmp_path / "in"), "*.pt", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    (tmp_path / "in/step_1.pt").write_text("x")
    clock[0] = os.path.getmtime(tmp_path / "in/step_1.pt") + 1
    run()
    assert sent == []
    clock[0] += 1000
    (tmp_path / "in/step_2.pt").write_text("y")
    os.utime(tmp_path / "in/step_2.pt", (clock[0] - 5, clock[0] - 5))
    run()
    assert sent == ["step_1.pt"]


def test_discovered_checkpoints_and_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "step_7.pt", "w") as z:
        z.writestr("a", "b")
    (tmp_path / "step_12.pt").write_bytes(b"PK\x03\x04 cut off")
    (tmp_path / "step_3.pt").write_text("x")
    assert [r["step"] for r in checkpoints.discover(spark, str(tmp_path)).orderBy("step").collect()] == [3, 7, 12]
    whole = checkpoints.whole_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [os.path.basename(r["path"]) for r in whole.select("path").collect()] == ["step_7.pt"]


def test_split_selection(spark):
    assert [r["id"] for r in sampling.take_split(spark.range(9), 2, "tail", ["id"]).collect()] == [7, 8]
    assert sampling.take_split(spark.range(3), 5, "head", ["id"], allow_partial=True).count() == 3
    for df in (spark.range(3), spark.range(0)):
        with pytest.raises(ValueError):
            sampling.take_split(df, 5, "head", ["id"], allow_partial=df.count() == 0)


def test_presets_and_specs():
    from corpusmill.config import Presets, check_specs

    def build(rows=5, shard=-1):
        return [
            {"name": "web", "output_subdir": "web", "output_file": "w.parquet", "source_type": "fineweb_glob", "file_glob": "*/x_*.parquet", "shard_index": shard, "selection": "head", "rows": rows},
            {"name": "code", "output_subdir": "code", "output_file": "c.parquet", "source_type": "hf_dataset", "dataset": "d", "split": "train", "selection": "tail", "rows": str(rows)},
        ]

    presets = Presets()
    presets.add("two", "Two pillars.", build)
    assert presets.descriptions() == {"two": "Two pillars."} and [s["rows"] for s in presets.specs("two", rows=7)] == [7, "7"]
    for broken in ({"rows": 0}, {"rows": "x"}):
        with pytest.raises(ValueError):
            presets.specs("two", **broken)
    with pytest.raises(ValueError, match="two"):
        presets.specs("three")
    for key in ("selection", "file_glob", "source_type"):
        with pytest.raises(ValueError):
            check_specs([{k: v for k, v in build()[0].items() if k != key}])
    with pytest.raises(ValueError):
        check_specs([build()[0] | {"source_type": "other"}])


def test_head_rows_of_a_shard(spark, tmp_path):
    from corpusmill.sources.scan import read_shard

    for name in ("a/x_1", "a/x_2", "b/y_1"):
        spark.range(10).coalesce(1).toPandas().to_parquet(tmp_path / (name.replace("/", "_") + ".parquet"))
    rows, about = read_shard(spark, str(tmp_path), {"name": "web", "rows": 4, "file_glob": "*z_*.parquet", "shard_index": -1}, ["a_x_*.parquet", "*.parquet"])
    assert rows.count() == 4 and about["shard_count"] == 2 and about["shard_index"] == 1 and about["resolved_file"].endswith("a_x_2.parquet")
    assert about["tried_globs"] == ["*z_*.parquet", "a_x_*.parquet"] and about["matched_glob"] == "a_x_*.parquet" and about["actual_rows"] == 4
    with pytest.raises(ValueError):
        read_shard(spark, str(tmp_path), {"rows": 11, "file_glob": "b_*"})
    assert read_shard(spark, str(tmp_path), {"rows": 11, "file_glob": "b_*"}, allow_partial=True)[1]["actual_rows"] == 10
    with pytest.raises(FileNotFoundError):
        read_shard(spark, str(tmp_path), {"rows": 1, "file_glob": "none*"})
    with pytest.raises(IndexError):
        read_shard(spark, str(tmp_path), {"rows": 1, "file_glob": "a_*", "shard_index": 2})


def test_deliveries_wait_until_files_are_settled_and_whole(spark, tmp_path):
    import zipfile

    from corpusmill.streaming.streams import Delivery

    folder, sent = tmp_path / "in", []
    folder.mkdir()
    with zipfile.ZipFile(folder / "good.pt", "w") as z:
        z.writestr("a", "x" * 100)
    (folder / "bad.pt").write_bytes(b"PK broken")
    deliver = Delivery(str(tmp_path / "state"), lambda p: sent.append(p.rpartition("/")[2]) or True, 0, settled=True, archives=True)
    files = spark.read.format("binaryFile").load(str(folder)).select("path", "length", "modificationTime")
    deliver(files, 0)
    assert sent == []  # seen for the first time
    deliver(files.limit(0), 1)
    assert sent == ["good.pt"]
    deliver(files.limit(0), 2)
    assert sent == ["good.pt"] and [r["path"].rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "state/waiting-2")).collect()] == ["bad.pt"]
