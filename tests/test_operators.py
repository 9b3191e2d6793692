import random

import pytest
from pyspark.sql import functions as F

from corpusmill import config
from corpusmill.operators import chat, checkpoints, curriculum, kernels, metrics, packing, paths, rewards, sampling
from corpusmill.operators.prefix import running_total


def test_running_total_matches_a_loop(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab" if draw.random() < 0.9 else "cd"), i, draw.randint(0, 9) if i % 7 else None) for i in range(600)] + [(None, 601, 3)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r["k"]: r["upto"] for r in running_total(df, "v", ["k"], ["g"]).collect()}
    sums, expected = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        expected[k] = sums[g]
    assert got == expected
    assert running_total(df.limit(0), "v", ["k"]).count() == 0


@pytest.mark.parametrize(
    ("path", "domain"),
    [("/data/logic/a", "logic"), ("C:\\data\\tools\\x.json", "tools"), ("/DATA/LOGIC/x", "logic"), ("/datasets/misc/x", "other"), (None, "other"), ("/web/code/x", "code")],
)
def test_domain(spark, path, domain):
    assert spark.createDataFrame([(path,)], "p string").select(paths.infer_domain(F.col("p"))).first()[0] == domain


def test_common_path(spark):
    given = ["./local_data/train/web/x", "C:\\data\\train\\web\\x", "/mnt//local_data/train/web/x", "LOCAL_DATA/TRAIN/WEB/X", "local_data/train/web/x/"]
    df = spark.createDataFrame([(p,) for p in given], "p string")
    assert {r[0] for r in df.select(paths.common_path(F.col("p"))).collect()} == {"/local_data/train/web/x/"}


def simulate(docs, length):
    stream = "".join(d + packing.END_MARK for d in docs if d)
    ends = {i + 1 for i, c in enumerate(stream) if c == packing.END_MARK}
    size = length + 1
    return [(stream[b : b + size], sorted({0, length} | {e - b for e in ends if b < e <= b + length})) for b in range(0, len(stream) - size + 1, size)]


@pytest.mark.parametrize("length", [1, 3, 8])
def test_pack_sequences(spark, length):
    draw = random.Random(length)
    docs = {s: ["".join(draw.choice("abc") for _ in range(draw.randint(0, 20))) for _ in range(30)] for s in "pq"}
    df = spark.createDataFrame([(s, i, t) for s, ts in docs.items() for i, t in enumerate(ts)], "stream string, doc_id long, text string")
    out = packing.pack_sequences(df, length).orderBy("stream", "block").collect()
    for s, ts in docs.items():
        assert [(r["content"], r["cu"]) for r in out if r["stream"] == s] == simulate(ts, length)


def test_segments(spark):
    df = spark.createDataFrame([([0, 2, 5, 8],)], "cu array<int>")
    assert df.select(packing.segment_ids(F.col("cu"), 8)).first()[0] == [0, 0, 1, 1, 1, 2, 2, 2]
    assert spark.createDataFrame([([0, 3, 8],)], "cu array<int>").select(packing.segment_ids(F.col("cu"), 6)).first()[0] == [0, 0, 0, 1, 1, 1]
    changes = df.select(packing.segment_changes(packing.segment_ids(F.col("cu"), 8))).first()[0]
    assert changes == [2, 5]


def test_eval_windows_and_padding(spark):
    df = spark.createDataFrame([(7,), (1,), (0,), (2,)], "n int")
    assert [r[0] for r in df.select(packing.eval_windows(F.col("n"), 3)).collect()] == [[0, 3], [], [], [0]]
    rows = spark.createDataFrame([(1, [0, 4, 8]), (1, [0, 1, 2, 3, 4, 8]), (2, [0, 8])], "b int, cu array<int>")
    padded = {(r["b"], r["n"]): r["padded"] for r in packing.pad_batches(rows, "b", "cu", -1).collect()}
    assert padded == {(1, 3): [0, 4, 8, -1, -1, -1], (1, 6): [0, 1, 2, 3, 4, 8], (2, 2): [0, 8]}


def test_messages_of_schemas(spark):
    def made(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return [[tuple(m) for m in r[0]] for r in df.select(chat.common_roles(chat.to_messages(df))).collect()]

    assert made([([("human", "a"), ("gpt", "b")],)], "conversations array<struct<from string, value string>>") == [[("user", "a"), ("assistant", "b")]]
    assert made([("p", "s"), ("", "s"), (None, None)], "question string, generated_solution string") == [[("user", "p"), ("assistant", "<think>\ns\n</think>")], [], []]
    tools = made([("q", "t", "a")], "query string, tools string, answers string")
    assert [m[0] for m in tools[0]] == ["system", "user", "assistant"]
    assert made([("do", "done")], "instruction string, output string") == [[("user", "do"), ("assistant", "done")]]


def test_label_mask(spark):
    df = spark.createDataFrame([([("user", "ab"), ("assistant", "c")],), ([],)], f"m {chat.MESSAGES}")
    ids, labels = chat.chat_ids(F.col("m"), 100)
    first, empty = df.select(ids.alias("i"), labels.alias("l")).collect()
    trained = [v for v in first["l"] if v != chat.IGNORED]
    assert len(first["i"]) == len(first["l"]) and trained == first["i"][-3:] and trained[1:] == [chat.STOP, chat.LINE]
    assert (empty["i"], empty["l"]) == ([0], [chat.IGNORED])


def test_rewards(spark):
    rows = [("<think>t</think>\nThe answer is 42.", "42"), ("no tags", "42"), ("<think>t</think>", "42"), ("<think>open", "42"), ("<think>t</think> forty two", "FORTY TWO"), (f"<think>{'x' * 1000}</think>hi", "no"), (None, None)]
    df = rewards.rewards(spark.createDataFrame(rows, "c string, t string"), "c", "t")
    got = [(r["r_format"], r["r_accuracy"], r["r_concise"]) for r in df.collect()]
    assert got == [(1.0, 2.0, 0.0), (0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 2.0, 0.0), (1.0, 0.0, -0.5), (0.0, 0.0, 0.0)]


def test_pass_rate_and_clipping(spark):
    df = spark.createDataFrame([("0.5",), ("n/a",), (None,), ("",), ("nan",)], "p string")
    assert [r[0] for r in df.select(rewards.pass_rate(F.col("p"))).collect()] == [0.5, None, None, None, None]
    pair = spark.createDataFrame([(2.0, 1.0), (2.0, -1.0)], "r double, a double")
    assert [r[0] for r in pair.select(rewards.clipped(F.col("r"), F.col("a"))).collect()] == [1.2, -2.0]


def test_curriculum(spark):
    phases = spark.createDataFrame([("Phase_1", 0.1, 2048), ("Phase_2", 0.4, 4096), ("Phase_3", 0.2, 8192), ("Phase_4", 0.3, 8192)], "phase string, pct double, ctx int")
    assert [r["hi"] for r in curriculum.boundaries(phases, 1000).orderBy("place").collect()] == [100, 500, 700, 1000]
    steps = spark.createDataFrame([(0,), (50,), (100,), (699,), (700,), (1000,)], "step long")
    out = {r["step"]: r for r in curriculum.schedule(steps, phases, 1000, 1.0, 0.0).collect()}
    assert [round(out[s]["lr"], 6) for s in (0, 50, 100, 699, 700, 1000)] == [0.0, 0.5, 1.0, 1.0, 1.0, 0.0]
    assert out[1000]["phase"] == "Complete" and out[1000]["ctx"] == 8192 and out[50]["core_lr"] == pytest.approx(0.05)


def test_checkpoints(spark):
    files = spark.createDataFrame([(f"c/step_{n}.pt",) for n in (30, 4, 200)] + [("c/other.bin",)], "path string")
    assert [r["step"] for r in checkpoints.select(files, steps="4,30").collect()] == [4, 30]
    assert [r["step"] for r in checkpoints.select(files, indices="-1,0,9,-1").collect()] == [200, -1]
    assert [r["step"] for r in checkpoints.select(files, n_latest=2).collect()] == [30, 200]
    assert checkpoints.select(files, n_latest=0).count() == 4
    listing = spark.createDataFrame([("a", 5, 0.0), ("b", 0, 0.0), ("c", 7, 95.0), ("d", 9, 0.0)], "path string, size long, mtime double")
    earlier = spark.createDataFrame([("a", 5, 0.0), ("b", 0, 0.0), ("c", 7, 95.0), ("d", 8, 0.0)], "path string, size long, mtime double")
    assert [r["path"] for r in checkpoints.ready(listing, earlier, 100.0, 10.0).collect()] == ["a"]


def test_selection_and_weights():
    assert list(sampling.selection_indices(10, 3, "tail")) == [7, 8, 9]
    with pytest.raises(ValueError):
        sampling.selection_indices(2, 3, "head")
    with pytest.raises(ValueError):
        sampling.normalise_weights({"web": 1.0})
    assert sum(sampling.normalise_weights(dict.fromkeys(paths.DOMAINS, 2.0)).values()) == pytest.approx(1)


def test_rebalance_and_tail(spark):
    specs = spark.createDataFrame([("a", 900, None, None), ("b", 900, 500, None), ("c", 900, None, 700)], "name string, rows long, max_rows_hint long, probed long")
    out = {r["name"]: (r["balanced_rows"], r["limiting"]) for r in sampling.rebalance(specs).collect()}
    assert out == {"a": (500, False), "b": (500, True), "c": (500, False)}
    assert [r["id"] for r in sampling.tail(spark.range(10), 3, ["id"]).collect()] == [7, 8, 9]


def test_mixture_reaches_its_weights(spark):
    streams = spark.createDataFrame([("a", 3.0, 7), ("b", 1.0, 2), ("none", 0.0, 5)], "stream string, weight double, n long")
    out = sampling.draw_streams(spark.range(4000).withColumnRenamed("id", "draw"), streams, 1).collect()
    share = sum(r["stream"] == "a" for r in out) / len(out)
    assert 0.72 < share < 0.78 and {r["stream"] for r in out} == {"a", "b"}
    assert all(r["element"] == r["ordinal"] % (7 if r["stream"] == "a" else 2) for r in out)


def test_metrics(spark):
    report = metrics.ratio_report(spark.createDataFrame([("x", 2, 1, True), ("y", 0, 3, False)], "name string, base_tokens int, custom_tokens int, roundtrip_exact boolean"))
    assert [r["ratio"] for r in report.orderBy("name").collect()] == [0.5, None]
    assert [r["message"] for r in metrics.failures(report, max_average=0.4, roundtrip=True).collect()] == ["average ratio 0.500 exceeded max-average-ratio 0.400", "sample 'y' failed exact roundtrip"]
    assert metrics.failures(report).count() == 0


def test_kernels(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.1, 2.0],)], "v array<float>")
    scale, values = kernels.ternary(F.col("v"))
    assert df.select(values).first()[0] == [1, -1, 0, 1] and df.select(scale).first()[0] == pytest.approx(0.9)
    assert df.select(kernels.int8(F.col("v"))[1]).first()[0] == [32, -64, 6, 127]
    assert [r[0] for r in spark.range(31, 34).select(kernels.duplicated_layer(F.col("id"))).collect()] == [31, 8, 9]


def test_config(tmp_path):
    assert config.parse_domain_map(" logic=0.2, WEB = 1 ,", "weights") == {"logic": 0.2, "web": 1.0}
    with pytest.raises(ValueError):
        config.parse_domain_map("sea=1", "weights")
    profile = {"domain_weights": dict.fromkeys(paths.DOMAINS, 1.0), "input_sentence_size": 13}
    resolved = config.resolve_profile(profile, {"web": 2.0}, {"code": 99})
    assert resolved["quotas"]["code"] == 99 and resolved["domain_weights"]["web"] == pytest.approx(1 / 3)
    assert sum(config.resolve_profile(profile)["quotas"].values()) == 13
    assert config.scaled_size(1000, 13) == 1000 and config.scaled_size(1000, 30, 5000) == 5000 and config.scaled_size(1000, None) == 1000
    assert config.corpus_bytes(2) == 2**29 and config.env_int({"A": "x"}, "A", 4) == 4 and config.env_flag({"A": "Yes"}, "A")
    (tmp_path / "s.json").write_text('{"pillars": [{"name": "n"}]}')
    assert config.read_specs(str(tmp_path / "s.json"), 900) == [{"rows": 900, "selection": "head", "name": "n"}]
    good = {"name": "n", "output_subdir": "o", "output_file": "f", "source_type": "hf_dataset", "selection": "head", "rows": 3, "dataset": "d", "split": "s"}
    config.check_specs([good])
    assert "output_file" not in config.provenance(good)
    for bad in ({**good, "rows": 0}, {k: v for k, v in good.items() if k != "split"}, {**good, "source_type": "x"}):
        with pytest.raises(ValueError):
            config.check_specs([bad])
    (tmp_path / "p.json").write_text('{"small": {"size": 2}}')
    assert config.profiles({"small": {"size": 1, "k": 3}}, str(tmp_path / "p.json")) == {"small": {"size": 2, "k": 3}}


def test_reasoning_is_switched_off_for_a_share_of_chats(spark):
    from corpusmill.operators import chat

    df = spark.range(2_000).selectExpr("id", "array(struct('user' as role, 'q' as content), struct('assistant' as role, '<think>t</think> a' as content)) as messages")
    out = df.select("id", chat.reasoning_switched(F.col("messages"), F.col("id"), 0.3, "on", "off").alias("m"))
    rows = [(r["m"][0]["content"], r["m"][2]["content"]) for r in out.collect()]
    off = rows.count(("off", "a"))
    assert off + rows.count(("on", "<think>t</think> a")) == 2_000 and 500 < off < 700
    assert out.collect() == out.repartition(7).orderBy("id").collect()
    own = spark.sql("select array(struct('system' as role, 's' as content)) as messages")
    assert own.select(chat.reasoning_switched(F.col("messages"), F.lit(1), 1.0, "on", "off")).first()[0][0]["content"] == "s"


@pytest.mark.parametrize("limit", [1, 2, 5, 9, 10, 11, 14, 40])
def test_chat_ids_at_every_limit(spark, limit):
    """Cut anywhere, ids and labels are those of the whole chat, cut."""
    from corpusmill.operators import chat

    df = spark.sql("select array(struct('user' as role, 'abc' as content), struct('assistant' as role, 'de' as content), struct('user' as role, '' as content)) as m")
    whole, cut = (df.select(*chat.chat_ids(F.col("m"), n)).first() for n in (1_000, limit))
    assert len(whole[0]) == (4 + 3 + 4) + (9 + 2 + 4) + (4 + 0 + 4) and list(cut[0]) == list(whole[0])[:limit] and list(cut[1]) == list(whole[1])[:limit]
