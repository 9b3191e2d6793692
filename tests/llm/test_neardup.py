import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql.functions import udf

from corpusmill.llm import neardup
from corpusmill.llm.textnorm import WORD, fold, mix64, words

HOW = neardup.HALF_OF_THREE_WORDS
SCHEMA = "scope string, id long, text string, fp string"


def brute(rows, how=HOW):
    sets = []
    for scope, i, text, _ in rows:
        w = words(text)
        if len(w) >= max(how.least_words, how.words):
            sets.append((scope, i, {tuple(w[k : k + how.words]) for k in range(len(w) - how.words + 1)}))
    pairs = set()
    for (s, i, a), (t, j, b) in combinations(sets, 2):
        if s == t and len(a & b) / len(a | b) >= how.threshold:
            pairs.add((s, min(i, j), max(i, j)))
    return pairs


def corpus(seed, n=160):
    """Texts of a small vocabulary, half of them edited from another: swapped, dropped and inserted words, moved sentences."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        if out and draw.random() < 0.6:
            w = draw.choice(out).split()
            for _ in range(draw.randint(0, 6)):
                k = draw.randrange(len(w))
                w[k : k + draw.randint(0, 1)] = [f"n{draw.randrange(10**6)}"] * draw.randint(0, 2)
            cut = draw.randrange(len(w))
            out.append(" ".join(w[cut:] + w[:cut] if draw.random() < 0.3 else w) or "x")
        else:
            out.append(" ".join(f"w{draw.randrange(400)}" for _ in range(draw.randint(15, 120))))
    return out


@pytest.mark.parametrize(("seed", "paired", "searched"), [(1, 2_000, 10_000), (2, 16, 10_000), (3, 2, 10_000), (4, 1, 10_000), (5, 2, 3), (6, 1, 1)])
def test_pairs_against_all_comparisons(spark, monkeypatch, seed, paired, searched):
    """With all buckets paired, with large ones searched where they meet, and with large or all ones searched by rare elements across tasks."""
    monkeypatch.setattr(neardup, "LARGEST_BUCKET", paired)
    monkeypatch.setattr(neardup, "LARGEST_SEARCHED_BUCKET", searched)
    texts = corpus(seed)
    rows = [("a" if i % 9 else "b", i, t, "clash") for i, t in enumerate(texts)]
    rows += [("a", 1000 + k, texts[1], "clash") for k in range(4)]  # copies
    rows += [("a", 2000, None, ""), ("a", 2001, "", ""), ("a", 2002, "too few words", ""), ("a", 2003, "\u00ad".join(texts[2]).upper(), ""), (None, 2004, texts[2], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [(r["scope"], r["id_a"], r["id_b"]) for r in neardup.record_pairs(neardup.near_duplicates(df, HOW)).collect()]
    expected = brute([(s or "", i, t, x) for s, i, t, x in rows])
    assert len(found) == len(set(found))
    assert set(found) <= expected and len(expected - set(found)) <= 0.01 * len(expected)


def test_groups_against_union_find(spark):
    rows = [("a", i, t, "") for i, t in enumerate(corpus(5, 120))] + [("a", 500, corpus(5, 120)[0], "")]
    near = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), HOW)
    out = {r["id"]: r for r in neardup.groups(near).collect()}
    head = {i: i for i in out}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for _, a, b in {(r["scope"], r["id_a"], r["id_b"]) for r in neardup.record_pairs(near).collect()}:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    assert {i: r["group_id"] for i, r in out.items()} == {i: root(i) for i in out}
    assert out[500]["class_id"] == 0 and out[500]["n_links"] == out[0]["n_links"]


def test_signatures_agree_as_weighted_similarity():
    """Half of the elements shared, with weights: the share of equal coordinates estimates the weighted similarity."""
    draw = np.random.default_rng(1)
    k, trials, equal = 128, 60, 0
    shared_w, own_w = 0.3, 1.0
    for _ in range(trials):
        h = draw.integers(0, 2**53, 90, dtype=np.uint64)
        a, b = np.r_[h[:60]], np.r_[h[:30], h[60:]]
        w = np.r_[np.full(30, shared_w), np.full(30, own_w)]
        s = neardup.dart_signatures(np.repeat([0, 1], 60), np.r_[a, b], np.r_[w, w], 2, k)
        equal += (s[0] == s[1]).mean()
    expected = 30 * shared_w / (30 * shared_w + 60 * own_w)
    assert equal / trials == pytest.approx(expected, abs=0.02)


def test_signatures_do_not_depend_on_the_batch():
    draw = np.random.default_rng(2)
    sets = [draw.integers(0, 2**53, n, dtype=np.uint64) for n in (1, 2, 30, 500)]
    alone = [neardup.dart_signatures(np.zeros(len(s), int), s, np.ones(len(s)), 1, 64)[0] for s in sets]
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    together = neardup.dart_signatures(doc, np.concatenate(sets), np.ones(len(doc)), 6, 64)
    assert all((together[i] == alone[i]).all() for i in range(4)) and not together[4:].any()


@pytest.mark.parametrize("weight", [1.0, 0.3])
def test_signatures_against_darts_one_by_one(weight):
    """Names of the winners of sets of many sizes, of so many darts of each element that none that is left can be earlier."""
    draw, k = np.random.default_rng(3), 32
    sets = [draw.integers(0, 2**53, n, dtype=np.uint64) for n in (1, 3, 40, 700, 0, 9_000, 5)]
    doc, element = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    found = neardup.dart_signatures(doc, element, np.full(len(doc), weight), len(sets), k)
    for i, s in enumerate(sets):
        winner, rank = np.full(k, np.iinfo(np.uint64).max), np.zeros(len(s), np.float32)
        for turn in range(1, 20 + int(1_500 / weight / len(s)) if len(s) else 0):
            with np.errstate(over="ignore"):
                x = mix64(s + np.uint64(turn) * neardup.GOLDEN)
                name = x * neardup.GOLDEN >> np.uint64(32)
            rank = rank - np.log(((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32))
            hit = (x & np.uint64(0xFFFF)).astype(float) / 2**16 < weight
            np.minimum.at(winner, (name[hit] % np.uint64(k)).astype(np.int64), (rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | name)[hit])
        assert (found[i] == (winner if len(s) else 0)).all()


def test_darts_of_a_signature(monkeypatch):
    """A text takes k (log k + 2.5) darts at most on average: those that are incomplete go on where they stopped."""
    thrown, draw, k, n = [], np.random.default_rng(4), HOW.coordinates, 400
    monkeypatch.setattr(neardup, "mix64", lambda x: thrown.append(x.size) or mix64(x))
    neardup.dart_signatures(np.repeat(np.arange(n), 100), draw.integers(0, 2**53, 100 * n, dtype=np.uint64), np.ones(100 * n), n, k)
    assert sum(thrown) < n * k * (np.log(k) + 2.5)


def test_texts_are_read_twice(spark):
    """Once for members and bands, once for the sets."""
    read = spark.sparkContext.accumulator(0)

    @udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [("a", i, t, "") for i, t in enumerate(corpus(8, 50))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", counted("text"))
    assert neardup.record_pairs(neardup.near_duplicates(df, HOW)).count() > 0
    assert read.value == 2 * len(rows)


def test_entries_that_share_a_key():
    draw = np.random.default_rng(5)
    key, who = draw.integers(0, 3_000, 4_000).astype(np.uint32), draw.integers(2**64 - 3, 2**64 - 1, 4_000, dtype=np.uint64)
    often = Counter(key.tolist())
    expected = sorted({(a, b) for a, b in zip(key.tolist(), who.tolist()) if often[a] > 1})
    for of in (slice(None), slice(0, 0), slice(0, 1)):
        found = list(zip(*(x.tolist() for x in neardup._grouped(key[of], who[of]))))
        assert found == (expected if of == slice(None) else [])


def test_words_of_ascii_and_other_texts():
    ascii_ = "".join(map(chr, range(128)))
    texts = [ascii_, "a_b  C\x1cd\x00e9_", "\u2014 Caf\u00e9 \ufb01ne_\u00b2\u00ad3\u2019s", "\u00df\u0130 \u4e2d\u6587 x_y", "\u2026", " ", ""]
    texts += ["".join(map(chr, np.random.default_rng(i).integers(0, 0x250, 300))) for i in range(50)]
    assert [words(t) for t in texts] == [WORD.findall(fold(t)) for t in texts]


def test_boilerplate_alone_is_still_found(spark):
    """A third of the texts are near copies of one text, so that all of its runs are frequent."""
    base = [f"b{i}" for i in range(60)]
    near = [("a", i, " ".join(base[:30] + [f"x{i}"] + base[30:]), "") for i in range(30)]
    rest = [("a", 100 + i, " ".join(f"r{i}x{k}" for k in range(60)), "") for i in range(60)]
    out = neardup.record_pairs(neardup.near_duplicates(spark.createDataFrame(near + rest, SCHEMA), HOW)).count()
    assert out >= 0.99 * 30 * 29 / 2


@pytest.mark.parametrize("largest", [10_000, 50])
def test_near_copies_of_common_text_against_all_comparisons(spark, monkeypatch, largest):
    """A third of the texts are copies of a template with 3 to 5 edits each: similarities about 0.5 to 0.7, all that is shared is common."""
    monkeypatch.setattr(neardup, "LARGEST_SEARCHED_BUCKET", largest)
    draw = random.Random(7)
    rows = []
    for i in range(120):
        w = [f"t{k}" for k in range(100)]
        for k in draw.sample(range(0, 100, 4), 3 + i % 3):
            w[k] = f"e{i}x{k}"
        rows.append(("a", i, " ".join(w), ""))
    rows += [("a", 1000 + i, " ".join([f"t{k}" for k in range(30)] + [f"r{i}x{k}" for k in range(60)]), "") for i in range(240)]
    found = {(r["scope"], r["id_a"], r["id_b"]) for r in neardup.record_pairs(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), HOW)).collect()}
    expected = brute(rows)
    assert len(expected) > 4_000
    assert found <= expected and len(expected - found) <= 0.002 * len(expected)


def test_empty_and_long(spark):
    df = spark.createDataFrame([("a", 1, "w " * 200_000, ""), ("a", 2, "w " * 200_000, ""), ("a", 3, " ".join(map(str, range(30_000))), "")], SCHEMA)
    near = neardup.near_duplicates(df, HOW)
    assert [tuple(r) for r in neardup.record_pairs(near).collect()] == [("a", 1, 2)]
    none = neardup.near_duplicates(df.limit(0), HOW)
    assert neardup.record_pairs(none).count() == 0 and neardup.groups(none).count() == 0


def test_chat_text(spark):
    rows = [([("system", "s"), ("user", "a"), ("assistant", None), (None, "b"), None],), ([],), (None,)]
    df = spark.createDataFrame(rows, "messages array<struct<role string, content string>>")
    assert [r[0] for r in df.select(neardup.chat_text()).collect()] == ["a\nb", "", None]


def test_recall_of_the_bands():
    assert HOW.recall(0.5) > 0.998 and neardup.Similarity().recall(0.8) > 0.99


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_links_by_a_shared_footer_on_any_partitioning(spark, parts):
    """60 texts share a footer of 62 words (similarity 0.545) among 1 500 others: the 1 770 links do not depend on partitions."""
    footer = " ".join(f"f{k}" for k in range(62))
    rows = [("a", i, f"{footer} " + " ".join(f"o{i}x{k}" for k in range(25)), "") for i in range(60)]
    rows += [("a", 100 + i, " ".join(f"r{i}x{k}" for k in range(80)), "") for i in range(1_500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "id")
    found = neardup.record_pairs(neardup.near_duplicates(df, HOW)).collect()
    assert len(found) == 1_770 and all(r["id_b"] < 60 for r in found)


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8, 1.0])
def test_candidates_by_the_similarity_that_decides(spark, common):
    """Pairs of similarity 0.51, whose shared words are to a part those of many other texts: at least 0.99 are found."""
    rows, n = [], 200
    shared = 70
    often = int(common * shared)
    for i in range(n):
        body = [f"c{k}" for k in range(often)] + [f"p{i}x{k}" for k in range(shared - often)]
        rows += [("a", 2 * i + side, " ".join(body + [f"o{i}s{side}x{k}" for k in range(31)]), "") for side in (0, 1)]
    found = {(r["id_a"], r["id_b"]) for r in neardup.record_pairs(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), HOW)).collect()}
    expected = {(a, b) for _, a, b in brute(rows)}
    assert found <= expected and len(found) >= 0.99 * len(expected) and len(expected) >= n
