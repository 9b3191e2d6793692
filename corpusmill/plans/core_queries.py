"""Queries over the test tables, one or more for each kind of operator, beside the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.charcodes import char_ids, with_end
from corpusmill.operators import chat, checkpoints, curriculum, kernels, metrics, packing, paths, rewards, sampling, tokenizers, vocabulary
from corpusmill.operators.prefix import running_total
from corpusmill.sources import scan
from corpusmill.streaming import streams
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The character classes of corpusmill.functions.text, and Python-like stripping, in SQL.
WS, WORD, PIECE = tx.WS, tx.WORD, tx.PIECE


def _strip(sql: str) -> str:
    return rf"regexp_replace({sql}, '\A{WS}+|{WS}+\z', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Scans, projections and predicates


@query("SELECT doc_id, text AS source_text FROM documents WHERE length(text) > 50")
def a10_source_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", scan.source_text(docs).alias("source_text")).where("source_text is not null")


@query("SELECT count(*) AS n_rows, count(text) AS n_texts FROM fineweb")
def a18_split_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fineweb").agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("n_texts"))


@query("SELECT row_id, 'Problem: ' || problem AS canonical FROM open_math_reasoning WHERE problem IS NOT NULL")
def c4_canonical_problem(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "open_math_reasoning")
    return df.select("row_id", tx.canonical_text(df).alias("canonical")).where("canonical <> '' and problem is not null")


@query("""
SELECT row_id, array_to_string(list_transform(list_filter(messages, lambda m: m IS NOT NULL),
       lambda m: coalesce(m.role, 'None') || ': ' || coalesce(m.content, 'None')), chr(10)) AS canonical
FROM nemotron_post_training WHERE len(messages) > 0""")
def c4_canonical_chat(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nemotron_post_training")
    return df.where(F.size("messages") > 0).select("row_id", tx.canonical_text(df).alias("canonical"))


@query(f"""
SELECT doc_id, substring({_strip('text')}, 1, 2048) AS trimmed, length({_strip('text')}) AS n FROM documents
WHERE text IS NOT NULL AND {_strip('text')} <> ''""")
def c5_trimmed_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", tx.trim_text(F.col("text"), 2048).alias("trimmed"), F.length(tx.strip(F.col("text"))).cast("long").alias("n")).where("trimmed is not null")


@query("""
SELECT row_id, len(list_filter(messages, lambda m: m.content IS NOT NULL)) AS kept, len(messages) AS had
FROM nemotron_post_training WHERE messages IS NOT NULL""")
def c7_messages_with_content(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nemotron_post_training").where("messages is not null")
    return df.select("row_id", F.size(F.filter("messages", lambda m: m["content"].isNotNull())).cast("long").alias("kept"), F.size("messages").cast("long").alias("had"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 50 AND length(text) <= 2048")
def c9_prompt_length(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where("n > 50 and n <= 2048")


@query("SELECT item_id, pillar FROM eval_items WHERE pillar NOT IN ('math', 'web')")
def c10_excluded_samples(spark: SparkSession, folder: str) -> DataFrame:
    names = [n.strip() for flag in ("math, ", "web") for n in flag.split(",") if n.strip()]
    out = spark.createDataFrame([(n,) for n in names], "pillar string")
    return table(spark, folder, "eval_items").select("item_id", "pillar").join(out, "pillar", "left_anti")


_RUNS = "SELECT 'runs/' || profile || '/step_' || CAST(run_id * 100 AS VARCHAR) || CASE WHEN run_id % 5 = 0 THEN '.tmp' ELSE '.pt' END AS path FROM training_manifest"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("runs/"), F.col("profile"), F.lit("/step_"), (F.col("run_id") * 100).cast("string"), F.when(F.col("run_id") % 5 == 0, ".tmp").otherwise(".pt"))
    return table(spark, folder, "training_manifest").select(name.alias("path"))


_STEP = r"coalesce(try_cast(nullif(regexp_extract(path, 'step_(\d+)\.pt\z', 1), '') AS BIGINT), -1)"


@query(f"SELECT path, {_STEP} AS step FROM ({_RUNS})")
def i7_checkpoint_step(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.with_step(_runs(spark, folder))


@query(f"SELECT path, {_STEP} AS step FROM ({_RUNS}) WHERE {_STEP} IN (300, 700, 99900)")
def c11_checkpoints_by_step(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.select(_runs(spark, folder), steps="300, 700,99900")


@query(f"""
WITH o AS (SELECT path, {_STEP} AS step, row_number() OVER (ORDER BY {_STEP}, path) - 1 AS p, count(*) OVER () AS n FROM ({_RUNS}))
SELECT path, step FROM o WHERE p IN (0, 2) OR p = n - 1""")
def c11_checkpoints_by_index(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.select(_runs(spark, folder), indices="0,-1,2,0,99")


@query(f"SELECT path, {_STEP} AS step FROM ({_RUNS}) ORDER BY step DESC, path DESC LIMIT 5")
def g6_latest_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.select(_runs(spark, folder))


@query(f"SELECT arg_max(path, ({_STEP}, path)) AS path, max({_STEP}) AS step FROM ({_RUNS})")
def a21_newest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoints.newest(_runs(spark, folder))


@query(f"SELECT path FROM ({_RUNS}) WHERE path NOT IN (SELECT path FROM ({_RUNS}) WHERE {_STEP} < 800)")
def a22_unseen_files(spark: SparkSession, folder: str) -> DataFrame:
    files = _runs(spark, folder)
    return checkpoints.unseen(files, checkpoints.with_step(files).where("step < 800"))


_DOMAIN = """CASE WHEN contains(lower(replace(path, '\\', '/')), '/logic/') THEN 'logic' WHEN contains(lower(replace(path, '\\', '/')), '/code/') THEN 'code'
 WHEN contains(lower(replace(path, '\\', '/')), '/tools/') THEN 'tools' WHEN contains(lower(replace(path, '\\', '/')), '/web/') THEN 'web' ELSE 'other' END"""


@query(f"SELECT doc_id, path, {_DOMAIN} AS domain FROM documents")
def i6_domain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "path", paths.infer_domain(F.col("path")).alias("domain"))


# Text functions


@query(f"SELECT doc_id, md5(regexp_replace({_strip('text')}, '{WS}+', ' ', 'g')) AS collapsed_md5 FROM documents WHERE text IS NOT NULL")
def i4_collapsed_space(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(tx.collapse_space(F.col("text"))).alias("collapsed_md5"))


@query(f"""
SELECT doc_id, md5({_strip("replace(text, chr(10), ' ')")}) AS flat_md5,
       md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS fidelity_md5
FROM documents WHERE text IS NOT NULL""")
def i14_line_modes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(tx.flatten_lines(F.col("text"))).alias("flat_md5"), F.md5(tx.unix_lines(F.col("text"))).alias("fidelity_md5"))


@query("SELECT doc_id, length(text) AS n_points, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL")
def i27_lengths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_points"), tx.utf8_length(F.col("text")).cast("long").alias("n_bytes"))


@query("SELECT source, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY source")
def e21_corpus_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("source").agg(F.sum(tx.utf8_length(F.col("text")).cast("long")).alias("n_bytes"))


@query(f"""
SELECT row_id, md5({_strip(rf"regexp_replace(generated_solution, '(?s)<think>.*?</think>{WS}*', '', 'g')")}) AS answer_md5
FROM open_math_reasoning WHERE generated_solution IS NOT NULL""")
def i8_without_thoughts(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "open_math_reasoning").where("generated_solution is not null")
    return df.select("row_id", F.md5(tx.without_thoughts(F.col("generated_solution"))).alias("answer_md5"))


@query(f"""
SELECT doc_id, count(*) FILTER (regexp_matches(p, '\\A{WS}')) AS n_space, count(*) FILTER (regexp_matches(p, '\\A{WORD}')) AS n_word, count(*) AS n_pieces
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PIECE}')) AS p FROM documents) GROUP BY doc_id""")
def i2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    split = table(spark, folder, "documents").select("doc_id", tx.pieces(F.col("text")).alias("p")).where(F.size("p") > 0)
    count = lambda c: F.size(F.filter("p", lambda x: x.rlike(rf"\A{c}"))).cast("long")
    return split.select("doc_id", count(WS).alias("n_space"), count(WORD).alias("n_word"), F.size("p").cast("long").alias("n_pieces"))


@query("""
SELECT item_id, CASE WHEN r IS NULL THEN 'n/a' ELSE printf('%.3f', r) || ' (' || printf('%.1f', abs(1 - r) * 100) ||
       CASE WHEN r <= 1 THEN '% fewer tokens)' ELSE '% more tokens)' END END AS label
FROM (SELECT item_id, CASE WHEN length(text) > 0 THEN strlen(text) / length(text)::DOUBLE END AS r FROM eval_items)""")
def i5_ratio_text(spark: SparkSession, folder: str) -> DataFrame:
    ratio = F.when(F.length("text") > 0, F.octet_length("text") / F.length("text").cast("double"))
    return table(spark, folder, "eval_items").select("item_id", tx.ratio_text(ratio).alias("label"))


@query("SELECT doc_id, len(regexp_extract_all(text, '<0x[0-9A-Fa-f]{2}>')) AS markers FROM documents WHERE text IS NOT NULL")
def e8_byte_markers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", tx.byte_markers(F.col("text")).cast("long").alias("markers"))


@query("""
SELECT row_id, CASE WHEN length(coalesce(dump, '')) >= length(coalesce(url, '')) AND length(coalesce(dump, '')) >= length(coalesce(file_path, '')) THEN coalesce(dump, '')
       WHEN length(coalesce(url, '')) >= length(coalesce(file_path, '')) THEN coalesce(url, '') ELSE coalesce(file_path, '') END AS longest FROM fineweb""")
def e17_longest_string(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "fineweb")
    return df.select("row_id", tx.longest_string(df, ["dump", "url", "file_path"]).alias("longest"))


# Vocabulary and budgets

_COUNTS = f"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{WORD}+')) AS word FROM documents) GROUP BY word"
_ALLOWED = f"SELECT word, cnt FROM ({_COUNTS}) WHERE cnt >= 5 ORDER BY cnt DESC, word LIMIT 2000"


@query(_COUNTS)
def e1_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.word_counts(table(spark, folder, "documents"))


@query(_ALLOWED)
def c13_allowed_words(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.allowed_words(e1_word_counts(spark, folder), 5, 2000)


@query(f"""
WITH h AS (SELECT cnt, count(*) AS words FROM ({_COUNTS}) GROUP BY cnt), r AS (SELECT cnt, sum(words) OVER (ORDER BY cnt DESC) AS reach FROM h)
SELECT min(cnt) AS threshold, max(reach)::BIGINT AS words_kept FROM r WHERE reach <= 1000""")
def e2_prune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.prune_threshold(e1_word_counts(spark, folder), 1000)


_NORMALISED = f"""
WITH a AS (SELECT list(word) AS words FROM ({_ALLOWED})),
p AS (SELECT doc_id, text, regexp_extract_all(text, '{PIECE}') AS ps FROM documents),
k AS (SELECT doc_id, text, list_transform(ps, lambda x: CASE WHEN regexp_matches(x, '\\A{WS}') THEN CASE WHEN contains(x, chr(10)) THEN 'n' ELSE 's' END
      WHEN regexp_matches(x, '\\A{WORD}') THEN CASE WHEN list_contains(words, x) THEN 'w' ELSE 'd' END ELSE 'p' END) AS ks, ps FROM p, a),
e AS (SELECT doc_id, text, array_to_string(list_transform(ps, lambda x, i: CASE WHEN ks[i] = 'n' THEN chr(10) WHEN ks[i] = 's' THEN ' '
      WHEN ks[i] = 'd' THEN CASE WHEN i = 1 OR ks[i - 1] = 's' THEN '' ELSE ' ' END
      ELSE CASE WHEN i > 1 AND ks[i - 1] IN ('w', 'p') THEN ' ' || x ELSE x END END), '') AS j FROM k)
SELECT doc_id, text, nullif({_strip('j')}, '') AS normalised FROM e"""


@query(f"SELECT doc_id, md5(normalised) AS normalised_md5, length(normalised) AS n FROM ({_NORMALISED}) WHERE text IS NOT NULL")
def i3_normalised_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    done = vocabulary.normalise(docs, c13_allowed_words(spark, folder))
    return done.select("doc_id", F.md5("normalised").alias("normalised_md5"), F.length("normalised").cast("long").alias("n"))


@query("""
SELECT doc_id, bytes_upto::BIGINT AS bytes_upto FROM (SELECT doc_id, coalesce(strlen(text), 0) AS b, sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) AS bytes_upto FROM documents)
WHERE bytes_upto - b < 300000""")
def f5_byte_budget(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return vocabulary.within_bytes(docs, 300_000, ["doc_id"]).select("doc_id", F.col("bytes_upto").cast("long"))


@query(f"""
WITH t AS (SELECT doc_id, text, {_strip('text')} AS kept, sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id) AS upto FROM documents),
s AS (SELECT min(upto) AS stop FROM t WHERE kept <> '' AND upto >= 300000)
SELECT doc_id, upto::BIGINT AS bytes_upto FROM t, s WHERE kept <> '' AND (stop IS NULL OR upto <= stop)""")
def f6_byte_budget_of_kept(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", tx.trim_text(F.col("text")).alias("kept"))
    return vocabulary.within_bytes_kept(docs, 300_000, ["doc_id"], "text", "kept").select("doc_id", F.col("bytes_upto").cast("long"))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text <> ''),
b AS (SELECT source, doc_id, chars, i, 0::BIGINT AS batch, 1 AS n, chars AS c FROM d WHERE i = 1
 UNION ALL SELECT d.source, d.doc_id, d.chars, d.i, CASE WHEN b.n >= 8 OR b.c >= 9000 THEN b.batch + 1 ELSE b.batch END,
 CASE WHEN b.n >= 8 OR b.c >= 9000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 8 OR b.c >= 9000 THEN d.chars ELSE b.c + d.chars END
 FROM b JOIN d ON d.source = b.source AND d.i = b.i + 1)
SELECT source, doc_id, chars, batch FROM b""")
def f3_greedy_batches(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.greedy_batches(table(spark, folder, "documents"), 8, 9000, "source", "doc_id")


# Sampling


def _quotas(spark: SparkSession) -> DataFrame:
    shares = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(w).alias("weight"), F.lit(i).alias("ord"))
        for i, (d, w) in enumerate(zip(paths.DOMAINS, (0.2, 0.3, 0.1, 0.35, 0.05)))
    ])).alias("s")).select("s.*")
    return sampling.largest_remainder(shares, 333)


_QUOTAS = """
SELECT domain, (f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, ord) <= 333 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM (
 SELECT domain, ord, weight / sum(weight) OVER () * 333 AS x, floor(weight / sum(weight) OVER () * 333) AS f
 FROM (VALUES ('logic', 0.2::DOUBLE, 0), ('code', 0.3::DOUBLE, 1), ('tools', 0.1::DOUBLE, 2), ('web', 0.35::DOUBLE, 3), ('other', 0.05::DOUBLE, 4)) t(domain, weight, ord))"""


@query(_QUOTAS)
def g7_domain_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return _quotas(spark).select("domain", "quota")


@query(f"""
SELECT doc_id, d.domain AS domain, nth FROM (SELECT doc_id, {_DOMAIN} AS domain, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY doc_id) AS nth
 FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> '') d JOIN ({_QUOTAS}) q ON q.domain = d.domain WHERE nth <= quota""")
def f7_within_quota(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(tx.trim_text(F.col("text")).isNotNull()).select("doc_id", paths.infer_domain(F.col("path")).alias("domain"))
    return sampling.within_quota(docs, _quotas(spark), ["doc_id"]).select("doc_id", "domain", F.col("nth").cast("long").alias("nth"))


@query(f"""
SELECT t.domain AS domain, count(d.domain) AS n, (sum(count(d.domain)) OVER ())::BIGINT AS total FROM (VALUES ('logic'), ('code'), ('tools'), ('web'), ('other')) t(domain)
LEFT JOIN (SELECT {_DOMAIN} AS domain FROM documents) d ON d.domain = t.domain GROUP BY t.domain""")
def e3_domain_lines(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.domain_lines(table(spark, folder, "documents").select(paths.infer_domain(F.col("path")).alias("domain")))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 150")
def g1_head(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.head(table(spark, folder, "documents").select("doc_id", "source"), 150, ["doc_id"])


@query("SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 150")
def g2_tail(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.tail(table(spark, folder, "documents").select("doc_id", "source"), 150, ["doc_id"])


@query("""
WITH s AS (SELECT pillar, count(*) AS rows, CASE WHEN pillar = 'code' THEN 50 END AS max_rows_hint FROM eval_items GROUP BY pillar)
SELECT pillar, least(rows, coalesce(max_rows_hint, rows)) AS effective_rows, min(least(rows, coalesce(max_rows_hint, rows))) OVER () AS balanced_rows,
 least(rows, coalesce(max_rows_hint, rows)) = min(least(rows, coalesce(max_rows_hint, rows))) OVER () AS limiting FROM s""")
def e9_rebalanced_pillars(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "eval_items").groupBy("pillar").agg(F.count(F.lit(1)).alias("rows"))
    specs = specs.withColumn("max_rows_hint", F.when(F.col("pillar") == "code", F.lit(50).cast("long"))).withColumn("probed", F.lit(None).cast("long"))
    return sampling.rebalance(specs).select("pillar", "effective_rows", "balanced_rows", "limiting")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 AS rank, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1) % 4 AS shard FROM documents")
def g9_shuffled_shards(spark: SparkSession, folder: str) -> DataFrame:
    ranked = sampling.shuffled_rank(table(spark, folder, "documents").select("doc_id"), "doc_id", 42)
    return ranked.select("doc_id", F.col("rank").cast("long").alias("rank"), F.pmod("rank", F.lit(4)).cast("long").alias("shard"))


_STREAMS = "SELECT lower(trim(source)) AS stream, count(*) AS n, sum(length(text))::DOUBLE AS weight FROM documents WHERE text <> '' GROUP BY 1"
_BOUNDS = f"SELECT stream, n, (sum(weight) OVER (ORDER BY stream)) / (sum(weight) OVER ()) AS hi, coalesce(lag(cum) OVER (ORDER BY stream), 0) AS lo FROM (SELECT *, (sum(weight) OVER (ORDER BY stream)) / (sum(weight) OVER ()) AS cum FROM ({_STREAMS}))"


@query(f"""
WITH u AS (SELECT row_id AS draw, ('0x' || substring(md5(row_id::VARCHAR || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM fineweb),
p AS (SELECT draw, b.stream, b.n, row_number() OVER (PARTITION BY b.stream ORDER BY draw) - 1 AS ordinal FROM u JOIN ({_BOUNDS}) b ON u.u >= b.lo AND u.u < b.hi)
SELECT draw, stream, ordinal, ordinal % n AS element, ordinal // n AS epoch FROM p""")
def h3_weighted_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text <> ''").groupBy(F.lower(F.trim("source")).alias("stream"))
    streams = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("double").alias("weight"))
    draws = table(spark, folder, "fineweb").select(F.col("row_id").alias("draw"))
    return sampling.draw_streams(draws, streams, 7).select("draw", "stream", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "element", "epoch")])


@query("SELECT item_id, e AS epoch FROM eval_items, (VALUES (0), (1), (2)) t(e)")
def a24_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.repeat_epochs(table(spark, folder, "eval_items").select("item_id"), 3)


@query("SELECT text FROM documents WHERE text <> '' UNION ALL SELECT text FROM fineweb WHERE text <> ''")
def h1_union_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("text").unionByName(table(spark, folder, "fineweb").select("text")).where("text <> ''")


# Packing

_LENGTH = 512
_PACKED = f"""
WITH d AS (SELECT coalesce(lang, '?') AS stream, doc_id, text || chr(1) AS t, length(text) + 1 AS n FROM documents WHERE text <> ''),
f AS (SELECT stream, string_agg(t, '' ORDER BY doc_id) AS s, sum(n)::BIGINT AS total FROM d GROUP BY stream),
b AS (SELECT stream, k AS block, substring(s, k * {_LENGTH + 1} + 1, {_LENGTH + 1}) AS content FROM f, LATERAL (SELECT unnest(range(0, total // {_LENGTH + 1})) AS k)),
e AS (SELECT stream, (sum(n) OVER (PARTITION BY stream ORDER BY doc_id))::BIGINT AS e FROM d),
c AS (SELECT stream, (e - 1) // {_LENGTH + 1} AS block, e - (e - 1) // {_LENGTH + 1} * {_LENGTH + 1} AS off FROM e)
SELECT b.stream AS stream, b.block AS block, md5(content) AS content_md5,
 array_to_string(list_sort(list_distinct(list_concat([0, {_LENGTH}], coalesce((SELECT list(off) FROM c WHERE c.stream = b.stream AND c.block = b.block AND off <= {_LENGTH}), [])))), ',') AS cu
FROM b"""


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("?")).alias("stream"), "doc_id", "text")
    return packing.pack_sequences(docs, _LENGTH)


@query(_PACKED)
def f1_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select("stream", "block", F.md5("content").alias("content_md5"), F.array_join(F.col("cu").cast("array<string>"), ",").alias("cu"))


@query(f"""
SELECT stream, block, x_sum, y_sum, len(cs) - 1 AS segments FROM (SELECT stream, block, string_split(cu, ',') AS cs,
 list_sum(list_transform(regexp_extract_all(substring(content, 1, {_LENGTH}), '(?s).'), lambda c: least(unicode(c) % 27 + 1, 26)))::BIGINT AS x_sum,
 list_sum(list_transform(regexp_extract_all(substring(content, 2, {_LENGTH}), '(?s).'), lambda c: least(unicode(c) % 27 + 1, 26)))::BIGINT AS y_sum
FROM ({_PACKED.replace('md5(content) AS content_md5', 'content')}))""")
def f8_inputs_and_targets(spark: SparkSession, folder: str) -> DataFrame:
    ids = _packed(spark, folder).withColumn("ids", char_ids(F.col("content")))
    x, y = packing.inputs_and_targets(F.col("ids"), _LENGTH)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return ids.select("stream", "block", total(x).alias("x_sum"), total(y).alias("y_sum"), (F.size("cu") - 1).cast("long").alias("segments"))


@query(f"""
SELECT stream, block, (SELECT sum(p) FROM (SELECT unnest(list_transform(range(0, {_LENGTH}), lambda i: len(list_filter(cs, lambda c: c <= i)) - 1)) AS p))::BIGINT AS segment_sum
FROM (SELECT stream, block, list_transform(string_split(cu, ','), lambda c: c::BIGINT) AS cs FROM ({_PACKED}))""")
def f9_segment_ids(spark: SparkSession, folder: str) -> DataFrame:
    segments = packing.segment_ids(F.col("cu"), _LENGTH)
    return _packed(spark, folder).select("stream", "block", F.aggregate(segments, F.lit(0).cast("long"), lambda s, v: s + v).alias("segment_sum"))


@query("""
SELECT doc_id, w AS begin, least(513, n - w) AS tokens FROM (SELECT doc_id, length(text) + 1 AS n FROM documents WHERE text <> ''), LATERAL (SELECT unnest(range(0, n - 1, 512)) AS w)""")
def f4_eval_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text <> ''").select("doc_id", (F.length("text") + 1).alias("n"))
    cut = docs.select("doc_id", "n", F.explode(packing.eval_windows(F.col("n"), 512)).alias("begin"))
    return cut.select("doc_id", F.col("begin").cast("long"), F.least(F.lit(513), F.col("n") - F.col("begin")).cast("long").alias("tokens"))


@query("""
WITH b AS (SELECT doc_id, (row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) - 1) // 8 AS nth, coalesce(lang, '?') AS stream, length(text) AS n FROM documents WHERE text <> '')
SELECT doc_id, stream, nth, n, max(n) OVER (PARTITION BY stream, nth) - n AS padding FROM b""")
def e15_padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text <> ''").select("doc_id", F.coalesce("lang", F.lit("?")).alias("stream"), char_ids(F.col("text")).alias("ids"))
    ranked = running_total(docs.withColumn("one", F.lit(1)), "one", ["doc_id"], ["stream"], "rank")
    numbered = ranked.withColumn("nth", F.floor((F.col("rank") - 1) / 8)).withColumn("batch", F.concat_ws(":", "stream", "nth"))
    padded = packing.pad_batches(numbered, "batch", "ids", -1)
    return padded.select("doc_id", "stream", "nth", F.col("n").cast("long"), F.size(F.filter("padded", lambda v: v == -1)).cast("long").alias("padding"))


@query(f"""
SELECT stream, block, n_segs, longest - n_segs AS padding, cu || repeat(',-1', (longest - n_segs)::BIGINT) AS cu_padded FROM (
 SELECT stream, block, cu, len(string_split(cu, ',')) AS n_segs, max(len(string_split(cu, ','))) OVER (PARTITION BY stream, block // 8) AS longest FROM ({_PACKED}))""")
def i24_collated_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Eight blocks of a stream to a batch."""
    packed = _packed(spark, folder).withColumn("batch", F.concat_ws(":", "stream", F.floor(F.col("block") / 8)))
    done = packing.collate_bounds(packed, "batch")
    padding = F.size(F.filter("cu_padded", lambda v: v == -1))
    return done.select("stream", "block", F.col("n_segs").cast("long"), padding.cast("long").alias("padding"), F.array_join(F.col("cu_padded").cast("array<string>"), ",").alias("cu_padded"))


# Chats

_CHAT = """
SELECT row_id, CASE WHEN len(messages) > 0 AND coalesce(messages[1].role, '') <> 'system' THEN list_prepend({'role': 'system', 'content': 'You think step by step.'}, ms) ELSE ms END AS ms FROM (
 SELECT row_id, messages, list_transform(coalesce(messages, []), lambda m: {'role': CASE m.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.role, '') END, 'content': coalesce(m.content, '')}) AS ms
 FROM nemotron_post_training)"""


def _chats(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nemotron_post_training")
    return df.select("row_id", chat.with_system(chat.common_roles(chat.to_messages(df)), "You think step by step.").alias("messages"))


@query(f"""
SELECT row_id, md5(array_to_string(list_transform(ms, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS rendered_md5, len(ms) AS n_messages FROM ({_CHAT})""")
def i20_rendered_chats(spark: SparkSession, folder: str) -> DataFrame:
    return _chats(spark, folder).select("row_id", F.md5(chat.render(F.col("messages"))).alias("rendered_md5"), F.size("messages").cast("long").alias("n_messages"))


def _switched(off: str, prompt: str, content: str) -> str:
    return f"""
SELECT row_id, {off} AS off, md5(array_to_string(list_transform(ms, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS rendered_md5 FROM (
 SELECT row_id, CASE WHEN len(messages) > 0 AND coalesce(messages[1].role, '') <> 'system' THEN list_prepend({{'role': 'system', 'content': '{prompt}'}}, ms) ELSE ms END AS ms FROM (
 SELECT row_id, messages, list_transform(coalesce(messages, []), lambda m: {{'role': CASE m.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.role, '') END, 'content': {content}}}) AS ms
 FROM nemotron_post_training))"""


_STRIPPED = _strip(rf"regexp_replace(coalesce(m.content, ''), '(?s)<think>.*?</think>{WS}*', '', 'g')")
_WITHOUT = f"CASE WHEN m.role IN ('gpt', 'assistant') THEN {_STRIPPED} ELSE coalesce(m.content, '') END"


@query(_switched("0.0", "You think step by step.", "coalesce(m.content, '')") + " UNION ALL " + _switched("1.0", "You answer at once.", _WITHOUT))
def i8_reasoning_switched(spark: SparkSession, folder: str) -> DataFrame:
    """Never and always off; shares between are drawn by hash, as the tests show."""
    df = table(spark, folder, "nemotron_post_training")
    own = df.select("row_id", chat.common_roles(chat.to_messages(df)).alias("messages"))
    switched = [chat.reasoning_switched(F.col("messages"), F.col("row_id"), off, "You think step by step.", "You answer at once.") for off in (0.0, 1.0)]
    each = F.array(*[F.struct(F.lit(off).alias("off"), m.alias("messages")) for off, m in zip((0.0, 1.0), switched)])
    return own.select("row_id", F.explode(each).alias("e")).select("row_id", "e.off", F.md5(chat.render(F.col("e.messages"))).alias("rendered_md5"))


@query(f"""
SELECT row_id, CASE WHEN len(ms) = 0 THEN 1 ELSE least(4096, list_sum(list_transform(ms, lambda m: length(m.role) + length(m.content) + 4))) END::BIGINT AS n_ids,
 coalesce(list_sum(list_transform(list_filter(ms, lambda m: m.role = 'assistant'), lambda m: length(m.content) + 2)), 0)::BIGINT AS n_trained FROM ({_CHAT})""")
def i21_label_masks(spark: SparkSession, folder: str) -> DataFrame:
    ids, labels = chat.chat_ids(F.col("messages"), 4096)
    return _chats(spark, folder).select("row_id", F.size(ids).cast("long").alias("n_ids"), F.size(F.filter(labels, lambda v: v != chat.IGNORED)).cast("long").alias("n_trained"))


@query("""
SELECT row_id, 2 AS n_messages, md5('<think>' || chr(10) || generated_solution || chr(10) || '</think>') AS last_md5 FROM open_math_reasoning WHERE problem <> '' AND generated_solution <> ''
UNION ALL SELECT row_id, 0, NULL FROM open_math_reasoning WHERE coalesce(problem, '') = '' OR coalesce(generated_solution, '') = ''""")
def i19_math_messages(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "open_math_reasoning")
    made = df.select("row_id", chat.to_messages(df).alias("m"))
    return made.select("row_id", F.size("m").alias("n_messages"), F.md5(F.try_element_at("m", F.lit(-1))["content"]).alias("last_md5"))


@query("""
SELECT row_id, CASE WHEN query <> '' AND tools <> '' THEN 3 ELSE 0 END AS n_messages,
 CASE WHEN query <> '' AND tools <> '' THEN md5('You have access to the following tools:' || chr(10) || tools || '|' || query || '|' || coalesce(answers, 'None')) END AS all_md5 FROM apigen_fc""")
def i19_tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "apigen_fc")
    made = df.select("row_id", chat.to_messages(df).alias("m"))
    return made.select("row_id", F.size("m").alias("n_messages"), F.when(F.size("m") > 0, F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|"))).alias("all_md5"))


# Metrics and reports

_WINDOWS = """SELECT doc_id, lower(trim(source)) AS pillar, least(512, n - 1 - w) AS tokens, (least(512, n - 1 - w) * (1 + doc_id % 7))::DOUBLE AS loss
 FROM (SELECT doc_id, source, length(text) + 1 AS n FROM documents WHERE text <> ''), LATERAL (SELECT unnest(range(0, n - 1, 512)) AS w)"""


@query(f"""
SELECT pillar, sum(tokens)::BIGINT AS tokens, count(DISTINCT doc_id) AS documents, count(*) AS windows, round(sum(loss) / greatest(sum(tokens), 1), 6) AS loss,
 round(exp(least(sum(loss) / greatest(sum(tokens), 1), 20)), 6) AS perplexity FROM ({_WINDOWS}) GROUP BY ROLLUP (pillar)""")
def e4_pillar_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The loss is a stand-in of a model's: 1 to 7 for each token."""
    docs = table(spark, folder, "documents").where("text <> ''").select("doc_id", F.lower(F.trim("source")).alias("pillar"), (F.length("text") + 1).alias("n"))
    cut = docs.select("doc_id", "pillar", "n", F.explode(packing.eval_windows(F.col("n"), 512)).alias("w")).withColumn("tokens", F.least(F.lit(512), F.col("n") - 1 - F.col("w")))
    windows = cut.select(F.col("doc_id").alias("document"), "pillar", F.col("tokens").cast("long").alias("tokens"), (F.col("tokens") * (1 + F.col("doc_id") % 7)).cast("double").alias("loss"))
    return metrics.pillar_metrics(windows).select("pillar", "tokens", "documents", "windows", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


_REPORT = "SELECT item_id::VARCHAR AS name, CASE WHEN length(text) > 0 THEN strlen(text)::DOUBLE / length(text) END AS ratio, item_id % 9 <> 0 AS exact FROM eval_items"


@query(f"SELECT round(avg(ratio), 6) AS average_ratio, count(ratio) AS counted FROM ({_REPORT})")
def e6_average_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder).agg(F.round(F.avg("ratio"), 6).alias("average_ratio"), F.count("ratio").alias("counted"))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("name"), F.length("text").alias("base_tokens"), F.octet_length("text").alias("custom_tokens"), (F.col("item_id") % 9 != 0).alias("roundtrip_exact"), (F.col("item_id") % 7 != 0).alias("roundtrip_normalized"), (F.col("item_id") % 10 / 10).alias("unk_ratio"), (F.col("item_id") % 4).alias("byte_markers"))
    return metrics.ratio_report(items)


@query(f"""
SELECT 'average' AS gate, 'average ratio ' || printf('%.3f', a) || ' exceeded max-average-ratio 1.001' AS message FROM (SELECT avg(ratio) AS a FROM ({_REPORT})) WHERE a > 1.001
UNION ALL SELECT 'sample', 'sample ''' || name || ''' ratio ' || printf('%.3f', ratio) || ' exceeded max-sample-ratio 1.020' FROM ({_REPORT}) WHERE ratio > 1.02
UNION ALL SELECT 'roundtrip', 'sample ''' || name || ''' failed exact roundtrip' FROM ({_REPORT}) WHERE NOT exact
UNION ALL SELECT 'normalized', 'sample ''' || item_id || ''' failed normalized roundtrip' FROM eval_items WHERE item_id % 7 = 0
UNION ALL SELECT 'unknown', 'sample ''' || item_id || ''' custom unk ratio ' || printf('%.3f', item_id % 10 / 10) || ' exceeded max-unk-ratio 0.850' FROM eval_items WHERE item_id % 10 = 9
UNION ALL SELECT 'markers', 'sample ''' || item_id || ''' byte marker count ' || (item_id % 4) || ' exceeded max-byte-markers 2' FROM eval_items WHERE item_id % 4 = 3""")
def e23_regression_gates(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.failures(_report(spark, folder), max_average=1.001, max_sample=1.02, roundtrip=True, normalized_roundtrip=True, max_unknown=0.85, max_markers=2)


# Rewards

_OPEN, _CLOSE = "instr(s, '<think>')", "instr(substring(s, instr(s, '<think>') + 7), '</think>')"
_REWARDS = f"""
WITH b AS (SELECT row_id, problem_id, coalesce(generated_solution, '') AS s, expected_answer AS truth FROM open_math_reasoning),
t AS (SELECT *, CASE WHEN {_OPEN} > 0 AND {_CLOSE} > 0 THEN {_strip(f"substring(substring(s, {_OPEN} + 7), 1, {_CLOSE} - 1)")} END AS thought,
 CASE WHEN {_OPEN} > 0 AND {_CLOSE} > 0 THEN {_strip(f"substring(substring(s, {_OPEN} + 7), {_CLOSE} + 8)")} END AS answer FROM b)
SELECT row_id, problem_id, CASE WHEN thought IS NULL THEN 0.0 WHEN answer <> '' THEN 1.0 ELSE 0.5 END AS r_format,
 CASE WHEN answer <> '' AND contains(lower(answer), lower(truth)) THEN 2.0 ELSE 0.0 END AS r_accuracy,
 CASE WHEN answer <> '' AND thought <> '' AND length(thought) / greatest(1, length(answer))::DOUBLE > 10 THEN -0.5 ELSE 0.0 END AS r_concise, length(s) * -0.0001 AS r_length FROM t"""


def _rewarded(spark: SparkSession, folder: str) -> DataFrame:
    return rewards.rewards(table(spark, folder, "open_math_reasoning"), "generated_solution", "expected_answer")


@query(f"""
SELECT row_id, r_format::DOUBLE AS r_format, r_accuracy::DOUBLE AS r_accuracy, r_concise::DOUBLE AS r_concise, round((r_format + r_accuracy + r_concise + r_length)::DOUBLE, 6) AS reward FROM ({_REWARDS})""")
def i13_rewards(spark: SparkSession, folder: str) -> DataFrame:
    return _rewarded(spark, folder).select("row_id", "r_format", "r_accuracy", "r_concise", F.round("reward", 6).alias("reward"))


@query(f"""
SELECT row_id, CASE WHEN n > 1 THEN round((r - m) / (d + 1e-8), 4) END AS advantage, n AS group_size FROM (SELECT row_id, r, avg(r) OVER w AS m, stddev_samp(r) OVER w AS d, count(*) OVER w AS n
 FROM (SELECT row_id, problem_id, r_format::DOUBLE + r_accuracy + r_concise AS r FROM ({_REWARDS})) WINDOW w AS (PARTITION BY problem_id))""")
def e10_advantages(spark: SparkSession, folder: str) -> DataFrame:
    scored = _rewarded(spark, folder).withColumn("score", F.col("r_format") + F.col("r_accuracy") + F.col("r_concise"))
    return rewards.advantages(scored, "problem_id", "score").select("row_id", F.round("advantage", 4).alias("advantage"), "group_size")


@query(f"SELECT problem_id, round(avg(CASE WHEN r_accuracy > 0 THEN 1 ELSE 0 END), 6) AS pass_rate, count(*) AS n FROM ({_REWARDS}) GROUP BY problem_id")
def e11_pass_rate(spark: SparkSession, folder: str) -> DataFrame:
    rate = F.round(F.avg((F.col("r_accuracy") > 0).cast("int")), 6)
    return _rewarded(spark, folder).groupBy("problem_id").agg(rate.alias("pass_rate"), F.count(F.lit(1)).alias("n"))


_RATE = "CASE WHEN isnan(try_cast(pass_rate_72b_tir AS DOUBLE)) THEN NULL ELSE try_cast(pass_rate_72b_tir AS DOUBLE) END"


@query(f"SELECT row_id, {_RATE} AS rate FROM open_math_reasoning WHERE {_RATE} BETWEEN 0.1 AND 0.9")
def c12_difficulty_band(spark: SparkSession, folder: str) -> DataFrame:
    return rewards.in_band(table(spark, folder, "open_math_reasoning"), rewards.pass_rate(F.col("pass_rate_72b_tir"))).select("row_id", "rate")


@query(f"""
WITH p AS (SELECT row_id, {_RATE} AS rate, (row_number() OVER (ORDER BY row_id) - 1) // 64 AS round FROM open_math_reasoning WHERE {_RATE} BETWEEN 0.1 AND 0.9)
SELECT row_id, round, row_number() OVER (PARTITION BY round ORDER BY rate DESC, row_id) AS place FROM p""")
def g5_easiest_first(spark: SparkSession, folder: str) -> DataFrame:
    ranked = running_total(c12_difficulty_band(spark, folder).withColumn("one", F.lit(1)), "one", ["row_id"], out="nth").withColumn("nth", F.col("nth") - 1)
    return rewards.easiest_first(ranked, "rate", "row_id", 64).select("row_id", F.col("round").cast("long"), F.col("place").cast("long"))


# Curriculum

_PHASES = "SELECT phase, ctx, row_number() OVER (ORDER BY phase) - 1 AS place, (sum(floor(1000 * pct + 1e-9)) OVER (ORDER BY phase))::BIGINT AS hi FROM curriculum"


@query(f"SELECT phase, coalesce(lag(hi) OVER (ORDER BY phase), 0) AS lo, hi FROM ({_PHASES})")
def f14_phase_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum.boundaries(table(spark, folder, "curriculum"), 1000).select("phase", F.col("lo").cast("long"), F.col("hi").cast("long"))


_SCHEDULE = f"""
WITH p AS (SELECT phase, ctx, place, hi, coalesce(lag(hi) OVER (ORDER BY phase), 0) AS lo FROM ({_PHASES})),
s AS (SELECT event_id AS step FROM events)
SELECT step, coalesce(phase, 'Complete') AS phase, coalesce(ctx, (SELECT arg_max(ctx, place) FROM p)) AS ctx,
 CASE WHEN place IS NULL THEN 3e-5 WHEN place = 0 THEN 3e-5 + (step - lo) / (hi - lo)::DOUBLE * (3e-4 - 3e-5) WHEN place <= 2 THEN 3e-4
 ELSE 3e-5 + (3e-4 - 3e-5) * 0.5 * (1 + cos(pi() * (step - lo) / (hi - lo)::DOUBLE)) END AS lr FROM s LEFT JOIN p ON step >= lo AND step < hi"""


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """A step for each event, of which the first 1000 were planned."""
    steps = table(spark, folder, "events").select(F.col("event_id").alias("step"))
    return curriculum.schedule(steps, table(spark, folder, "curriculum"), 1000, 3e-4, 3e-5)


@query(f"SELECT step, phase, ctx, round(lr * 1e6, 6) AS lr_micro, round(lr * 1e5, 6) AS core_lr_micro FROM ({_SCHEDULE})")
def i31_learning_rates(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select("step", "phase", "ctx", F.round(F.col("lr") * 1e6, 6).alias("lr_micro"), F.round(F.col("core_lr") * 1e6, 6).alias("core_lr_micro"))


@query(f"SELECT step, (sum(16 * ctx) OVER (ORDER BY step))::BIGINT AS tokens_upto FROM ({_SCHEDULE})")
def e14_running_tokens(spark: SparkSession, folder: str) -> DataFrame:
    steps = _steps(spark, folder).withColumn("tokens", curriculum.tokens_per_step(F.col("ctx"), 2, 8))
    return running_total(steps, "tokens", ["step"], out="tokens_upto").select("step", F.col("tokens_upto").cast("long"))


@query(f"SELECT step, CASE phase WHEN 'Phase_1' THEN 'logic,web' ELSE 'code,logic,web' END AS sources FROM ({_SCHEDULE})")
def d6_phase_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixes = {"Phase_1": ["logic", "web"], "Phase_2": ["code", "logic", "web"]}
    return _steps(spark, folder).select("step", F.array_join(curriculum.phase_mix(F.col("phase"), mixes), ",").alias("sources"))


# Numeric kernels


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, greatest(list_avg(list_transform(v, lambda x: abs(x))), 1e-5) AS scale FROM e)
SELECT vec_id, round(scale, 6) AS scale, list_sum(list_transform(v, lambda x: CASE WHEN abs(x / scale) >= 0.5 THEN sign(x) ELSE 0 END))::BIGINT AS total,
 len(list_filter(v, lambda x: abs(x / scale) >= 0.5)) AS nonzero FROM s""")
def l1_ternary(spark: SparkSession, folder: str) -> DataFrame:
    scale, q = kernels.ternary(F.col("embedding"))
    e = table(spark, folder, "embeddings").select("vec_id", scale.alias("scale"), q.alias("q"))
    return e.select("vec_id", F.round("scale", 6).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("q", lambda x: x != 0)).cast("long").alias("nonzero"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, 127.0::DOUBLE / greatest(list_max(list_transform(v, lambda x: abs(x))), 1e-5) AS scale FROM e)
SELECT vec_id, round(scale, 6) AS scale, list_sum(list_transform(v, lambda x: greatest(-128, least(127, round_even(x * scale, 0)))))::BIGINT AS total FROM s""")
def l2_int8(spark: SparkSession, folder: str) -> DataFrame:
    scale, q = kernels.int8(F.col("embedding"))
    e = table(spark, folder, "embeddings").select("vec_id", scale.alias("scale"), q.alias("q"))
    return e.select("vec_id", F.round("scale", 6).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""
SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x) / r)), 6) AS normed_sum FROM (SELECT vec_id, v, sqrt(list_avg(list_transform(v, lambda x: x * x)) + 1e-6) AS r
 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))""")
def l3_rms_norm(spark: SparkSession, folder: str) -> DataFrame:
    normed = F.transform(kernels.rms_norm(F.col("embedding")), F.abs)
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(normed, F.lit(0.0), lambda a, x: a + x), 6).alias("normed_sum"))


@query("SELECT source, min(doc_id) AS first, row_number() OVER (ORDER BY min(doc_id)) - 1 AS place FROM documents GROUP BY source")
def e18_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.first_seen(table(spark, folder, "documents"), "source", "doc_id")


@query("SELECT doc_id, length(text) + 1 AS n_ids, 0 AS last_id FROM documents WHERE text <> ''")
def i25_ids_with_end(spark: SparkSession, folder: str) -> DataFrame:
    ids = with_end(char_ids(F.col("text")))
    return table(spark, folder, "documents").where("text <> ''").select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.element_at(ids, -1).alias("last_id"))


@query("SELECT row_id, count(*) OVER (PARTITION BY id) AS deliveries, row_number() OVER (PARTITION BY id ORDER BY row_id) = 1 AS first_delivery FROM fineweb")
def h6_first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries are counted first and joined back: an id that fills the table does not fill a task."""
    web = table(spark, folder, "fineweb").select("row_id", "id")
    seen = web.groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"), F.min("row_id").alias("first"))
    return web.join(seen, web["id"].eqNullSafe(seen["id"])).select("row_id", "deliveries", (F.col("row_id") == F.col("first")).alias("first_delivery"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def smoke_pricing_groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"))





# Streaming


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def j_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    events = streams.files(spark, folder, schema, "events.parquet")
    counted = streams.windowed(events, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), late="3650 days")
    out = streams.run_to_table(counted, "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def j_ingested_domains(spark: SparkSession, folder: str) -> DataFrame:
    docs = streams.files(spark, folder, table(spark, folder, "documents").schema, "documents.parquet")
    lines = docs.where("text <> ''").select(paths.infer_domain(F.col("path")).alias("domain"))
    return streams.run_to_table(lines.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "complete")


# Tokenizers

_TEMPLATES = {"qa": "Passage:\n{text}\nQuestions:", "short": "In short {braces}: {text}"}


@query("""
SELECT item_id::VARCHAR AS name, length(text) AS base_tokens, strlen(text) AS custom_tokens, CASE WHEN length(text) > 0 THEN round(strlen(text)::DOUBLE / length(text), 6) END AS ratio,
 true AS roundtrip_exact, 0 AS unk_count, 0.0 AS unk_ratio, substring(text, 1, 160) AS preview FROM eval_items""")
def e7_tokenizer_report(spark: SparkSession, folder: str) -> DataFrame:
    """Code points against bytes, two tokenizers that SQL has as well."""
    samples = table(spark, folder, "eval_items").select(F.col("item_id").cast("string").alias("name"), "text")
    report = tokenizers.compare(samples, tokenizers.CodePoints(), tokenizers.Utf8Bytes())
    return report.select("name", F.col("base_tokens").cast("long"), F.col("custom_tokens").cast("long"), F.round("ratio", 6).alias("ratio"), "roundtrip_exact", F.col("unk_count").cast("long"), "unk_ratio", "preview")


@query("SELECT doc_id, length(text) AS had, least(length(text), 500) AS kept FROM documents WHERE text IS NOT NULL")
def i15_token_budget_of_prompts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    cut = tokenizers.within_tokens(tokenizers.CodePoints(), F.col("text"), 500)
    return docs.select("doc_id", F.length("text").cast("long").alias("had"), F.length(cut).cast("long").alias("kept"))


@query("""
SELECT strategy, md5(replace(template, '{text}', text)) AS prompt_md5 FROM documents, (VALUES ('qa', 'Passage:' || chr(10) || '{text}' || chr(10) || 'Questions:'), ('short', 'In short {braces}: {text}')) t(strategy, template)
WHERE length(text) > 50""")
def d7_prompts(spark: SparkSession, folder: str) -> DataFrame:
    made = tokenizers.prompts(a10_source_texts(spark, folder), _TEMPLATES, "source_text")
    return made.select("strategy", F.md5("prompt").alias("prompt_md5"))


@query("SELECT 'echo' AS strategy, count(*) AS n, sum(length(text) + 7)::BIGINT AS chars FROM documents WHERE length(text) > 50")
def k8_generated(spark: SparkSession, folder: str) -> DataFrame:
    """The model is a stand-in that repeats its prompt."""
    made = tokenizers.generate(tokenizers.prompts(a10_source_texts(spark, folder), {"echo": "Say: <{text}>"}, "source_text"), list)
    return made.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("generated")).cast("long").alias("chars"))


# Small rules


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS round, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS micro_batch FROM documents")
def f10_fixed_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.lit(1).alias("one"))
    ranked = running_total(docs, "one", ["doc_id"], out="nth").withColumn("at", F.col("nth") - 1)
    return ranked.select("doc_id", F.floor(F.col("at") / 64).cast("long").alias("round"), F.floor(F.col("at") / 8).cast("long").alias("micro_batch"))


@query(f"SELECT row_id, greatest(n_trained, 1) AS valid FROM (SELECT row_id, coalesce(list_sum(list_transform(list_filter(ms, lambda m: m.role = 'assistant'), lambda m: length(m.content) + 2)), 0)::BIGINT AS n_trained FROM ({_CHAT}))")
def e16_valid_labels(spark: SparkSession, folder: str) -> DataFrame:
    _, labels = chat.chat_ids(F.col("messages"), 1 << 30)
    return _chats(spark, folder).select("row_id", kernels.valid_labels(labels).cast("long").alias("valid"))


@query("SELECT vec_id, CASE WHEN vec_id < 32 THEN vec_id ELSE vec_id - 24 END AS source_layer FROM embeddings")
def d13_grown_layers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", kernels.duplicated_layer(F.col("vec_id")).alias("source_layer"))


@query("SELECT event_id, round(least(exp(r) * a, greatest(least(exp(r), 1.2), 0.8) * a), 6) AS objective FROM (SELECT event_id, (event_id % 11 - 5) / 10.0::DOUBLE AS r, value::DOUBLE AS a FROM events)")
def i35_clipped_objective(spark: SparkSession, folder: str) -> DataFrame:
    """Log ratios are a stand-in of a model's; advantages are the events' values."""
    events = table(spark, folder, "events").select("event_id", F.exp((F.col("event_id") % 11 - 5) / F.lit(10.0)).alias("ratio"), F.col("value").cast("double").alias("a"))
    return events.select("event_id", F.round(rewards.clipped(F.col("ratio"), F.col("a")), 6).alias("objective"))


@query("SELECT stream, block, len(list_filter(string_split(cu, ','), lambda c: c::BIGINT > 0)) - 1 AS changes FROM (" + _PACKED + ")")
def f12_segment_changes(spark: SparkSession, folder: str) -> DataFrame:
    changes = packing.segment_changes(packing.segment_ids(F.col("cu"), _LENGTH))
    return _packed(spark, folder).select("stream", "block", F.size(changes).cast("long").alias("changes"))


@query("SELECT path, step FROM (SELECT path, " + _STEP + " AS step FROM (" + _RUNS + ")) WHERE step IN (SELECT run_id * 100 FROM training_manifest WHERE vocab_size = 64000)")
def d2_wanted_steps(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "training_manifest").where("vocab_size = 64000").select((F.col("run_id") * 100).alias("step")).distinct()
    return checkpoints.with_step(_runs(spark, folder)).join(wanted, "step", "left_semi").select("path", "step")


@query(f"SELECT round(avg(r_format)::DOUBLE, 6) AS mean_format, count(*) AS n FROM ({_REWARDS})")
def e12_mean_format_reward(spark: SparkSession, folder: str) -> DataFrame:
    return _rewarded(spark, folder).agg(F.round(F.avg("r_format"), 6).alias("mean_format"), F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT row_id, md5(CASE WHEN {_OPEN} > 0 AND {_CLOSE} > 0 THEN {_strip(f"substring(substring(s, {_OPEN} + 7), 1, {_CLOSE} - 1)")} END) AS thought_md5,
 md5(CASE WHEN {_OPEN} > 0 AND {_CLOSE} > 0 THEN {_strip(f"substring(substring(s, {_OPEN} + 7), {_CLOSE} + 8)")} END) AS answer_md5
FROM (SELECT row_id, generated_solution AS s FROM open_math_reasoning)""")
def i9_thought_and_answer(spark: SparkSession, folder: str) -> DataFrame:
    thought, answer = tx.thought_and_answer(F.col("generated_solution"))
    return table(spark, folder, "open_math_reasoning").select("row_id", F.md5(thought).alias("thought_md5"), F.md5(answer).alias("answer_md5"))


@query("""
SELECT row_id, array_to_string(list_transform(coalesce(messages, []), lambda m: CASE m.role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.role, '') END), ',') AS roles
FROM nemotron_post_training""")
def i18_roles(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "nemotron_post_training")
    roles = F.transform(chat.common_roles(chat.to_messages(df)), lambda m: m["role"])
    return df.select("row_id", F.array_join(roles, ",").alias("roles"))


@query(f"""
SELECT row_id, batch, n, max(n) OVER (PARTITION BY batch) - n AS padding FROM (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 4 AS batch,
 CASE WHEN len(ms) = 0 THEN 1 ELSE least(2048, list_sum(list_transform(ms, lambda m: length(m.role) + length(m.content) + 4))) END::BIGINT AS n FROM ({_CHAT}))""")
def i23_padded_chats(spark: SparkSession, folder: str) -> DataFrame:
    ids, labels = chat.chat_ids(F.col("messages"), 2048)
    made = _chats(spark, folder).select("row_id", ids.alias("ids"), labels.alias("labels"), F.lit(1).alias("one"))
    numbered = running_total(made, "one", ["row_id"], out="nth").withColumn("batch", F.floor((F.col("nth") - 1) / 4).cast("long"))
    padded = packing.pad_batches(numbered, "batch", "labels", chat.IGNORED, "padded")
    return padded.select("row_id", "batch", F.col("n").cast("long"), (F.size("padded") - F.col("n")).cast("long").alias("padding"))


@query("SELECT domain, weight / sum(weight) OVER () AS share FROM (VALUES ('logic', 2.0::DOUBLE), ('code', 3.0::DOUBLE), ('tools', 1.0::DOUBLE), ('web', 3.5::DOUBLE), ('other', 0.5::DOUBLE)) t(domain, weight)")
def e20_normalised_weights(spark: SparkSession, folder: str) -> DataFrame:
    shares = sampling.normalise_weights({"logic": 2.0, "code": 3.0, "tools": 1.0, "web": 3.5, "other": 0.5})
    return spark.createDataFrame(list(shares.items()), "domain string, share double")


@query("""
SELECT stream, block, array_to_string(list_distinct(list_append(list_filter(list_transform(string_split(cu, ','), lambda c: c::BIGINT), lambda c: c <= 300), 300)).list_sort(), ',') AS kept FROM ("""
 + _PACKED + ")")
def c21_bounds_of_shorter_blocks(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.array_sort(F.array_distinct(F.array_append(F.filter("cu", lambda c: c <= 300), F.lit(300))))
    return _packed(spark, folder).select("stream", "block", F.array_join(kept.cast("array<string>"), ",").alias("kept"))


@query("SELECT (SELECT count(*) FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 400) WHERE text <> '') AS capped_rows, (SELECT count(*) FROM (SELECT text FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 400)) AS capped_texts")
def g8_row_caps(spark: SparkSession, folder: str) -> DataFrame:
    """A cap on rows read against one on texts kept: the two places where a cap can stand."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    before = sampling.head(docs, 400, ["doc_id"]).where("text <> ''").agg(F.count(F.lit(1)).alias("capped_rows"))
    after = sampling.head(docs.where("text <> ''"), 400, ["doc_id"]).agg(F.count(F.lit(1)).alias("capped_texts"))
    return before.join(after)  # a row each


@query("SELECT run_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created FROM training_manifest")
def i39_iso_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "training_manifest").select("run_id", F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("created"))


@query("SELECT row_id, len(json_extract(tools, '$[*].name')) AS n_tools, json_extract_string(tools, '$[0].name') AS first_tool FROM apigen_fc WHERE json_valid(tools)")
def i40_parsed_tools(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("tools", "array<struct<name string>>")
    df = table(spark, folder, "apigen_fc").select("row_id", parsed.alias("t")).where("t is not null")
    return df.select("row_id", F.size("t").cast("long").alias("n_tools"), F.get("t", F.lit(0))["name"].alias("first_tool"))


@query(f"""
SELECT ordinal, row_id, epoch FROM (SELECT r.row_id, e.epoch, r.nth + e.epoch * n AS ordinal FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS nth, count(*) OVER () AS n
 FROM open_math_reasoning WHERE {_RATE} BETWEEN 0.1 AND 0.9) r, (VALUES (0), (1)) e(epoch))""")
def f11_rounds_of_a_restarted_source(spark: SparkSession, folder: str) -> DataFrame:
    ranked = running_total(c12_difficulty_band(spark, folder).withColumn("one", F.lit(1)), "one", ["row_id"], out="nth")
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    twice = sampling.repeat_epochs(ranked, 2).join(F.broadcast(total))  # one row
    return twice.select((F.col("nth") - 1 + F.col("epoch") * F.col("n")).cast("long").alias("ordinal"), "row_id", "epoch")


@query("SELECT language, count(*) AS n, round(exp(least(avg(language_score) * 30, 20)), 4) AS perplexity FROM (SELECT coalesce(lang, 'und') AS language, language_score FROM fineweb) GROUP BY language")
def i32_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty times the mean language score stands in for a loss."""
    by = table(spark, folder, "fineweb").groupBy(F.coalesce("lang", F.lit("und")).alias("language"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(metrics.perplexity(F.avg("language_score") * 30), 4).alias("perplexity"))


@query("SELECT user_id, max(ts) AS latest, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id")
def e19_latest_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.max("ts").alias("latest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n")
    )
