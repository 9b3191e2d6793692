import random

from corpusmill.llm import leakage
from corpusmill.llm.textnorm import words


def brute(docs, items, least):
    grams = {i: {tuple(w[k : k + least]) for k in range(len(w) - least + 1)} for i, t in items if (w := words(t)) is not None}
    out = set()
    for d, t in docs:
        w = words(t)
        mine = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        out |= {(d, i) for i, g in grams.items() if g & mine}
    return out


def test_against_all_comparisons(spark):
    draw = random.Random(3)
    items = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.randint(3, 40)))) for i in range(40)] + [(100, None), (101, ""), (102, "w1 w1 w1 w1 w1 w1 w1")]
    items.append((103, items[5][1] + " and " + items[6][1]))  # a passage that items share
    docs = []
    for d in range(200):
        w = [f"w{draw.randrange(60)}" for _ in range(draw.randint(0, 60))]
        if d % 3 == 0:
            source = words(draw.choice(items)[1])
            if source:
                k = draw.randrange(len(source))
                w[3:3] = source[k : k + draw.randint(2, 12)]
        docs.append((d, " ".join(w).replace("w1", "W\u00ad1")))
    docs += [(500, None), (501, ""), (502, "w1 " * 50_000), (503, docs[3][1])]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, item_id int")
    ev = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for passes in (2_000_000, 50):
        got = [(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, ev, 5, passes).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 5)
    assert leakage.leaks(df.limit(0), ev, 5).count() == 0 and leakage.leaks(df, ev.limit(0), 5).count() == 0


def test_tiles_of_a_reordered_passage():
    index = leakage.SeedIndex(3)
    index.add(1, "a b c d e f g h")
    index.close()
    [(item, tiles, n)] = list(index.tiles("x e f g h y a b c d z b c"))
    assert item == 1 and n == 8 and sorted(t[0] for t in tiles) == [4, 4]


def test_greedy_tiles_do_not_overlap():
    tiles = leakage.greedy_tiles([(6, 0, 0), (5, 4, 0), (4, 4, 10)], 20, 20, 3)
    marks = [i for length, i, _ in tiles for i in range(i, i + length)]
    assert tiles[0] == (6, 0, 0) and len(marks) == len(set(marks))


def test_longest_run_wins_ties_by_place():
    assert leakage.greedy_tiles([(3, 5, 0), (3, 0, 0)], 8, 8, 3) == [(3, 0, 0)]


def test_coverage_threshold_counts_passages_in_any_order(spark):
    """An item of 60 words: one document holds both halves, swapped, another a quarter."""
    item = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(item[30:] + ["x"] + item[:30])), (2, " ".join(item[:15])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string")
    assert {(r["doc_id"], r["covered"]) for r in leakage.leaks(docs, items).collect()} == {(1, 60), (2, 15)}
    assert [r["doc_id"] for r in leakage.leaks(docs, items, least_coverage=0.5).collect()] == [1]
