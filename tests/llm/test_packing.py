import random
from itertools import product

import numpy as np
import pytest

from corpusmill.llm import packing


def fewest(sizes, capacity):
    """Windows of the best packing, by trying."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bound_and_packing_enclose_the_best(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 12, 30])
    sizes = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 9))), reverse=True)
    array = np.array(sizes)
    window = packing.best_fit_decreasing(array, capacity)
    best = fewest(sizes, capacity)
    assert packing.lower_bound(array, capacity) <= best <= window.max() + 1
    assert (np.bincount(window, weights=array) <= capacity).all()


def test_rounding_functions_see_what_the_sum_does_not():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert packing.lower_bound(np.array([], int), 10) == 0


SCHEMA = "id long, size long, phase string"


def packed(spark, rows, phases):
    docs = spark.createDataFrame(rows, SCHEMA)
    return packing.windows(docs, spark.createDataFrame(phases, "phase string, pct double, ctx int"))


def test_every_token_is_placed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    draw = random.Random(1)
    rows = [(i, draw.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000]) if i % 3 else draw.randint(1, 60), "clash") for i in range(600)]
    out = packed(spark, rows, [("A", 0.5, 100), ("B", 0.5, 64), ("B", 0.1, 32), (None, 0.1, 9), ("C", 0.1, 0)])
    got = out.collect()
    for phase, ctx in (("A", 100), ("B", 64)):
        mine = [r for r in got if r["phase"] == phase]
        total = {}
        for r in mine:
            total[r["id"]] = total.get(r["id"], 0) + r["size"]
        assert total == {i: s for i, s, _ in rows}
        assert {r["part"] for r in mine if dict((i, s) for i, s, _ in rows)[r["id"]] <= ctx} == {0}
        fill = {}
        for r in mine:
            if r["window_id"] is not None:
                fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["size"]
        assert all(r["fill"] == fill[r["window_id"]] <= ctx for r in mine if r["window_id"] is not None)
        assert all(r["window_id"] is None and r["size"] == 0 for r in mine if r["window_id"] is None)
    report = {r["phase"]: r for r in packing.fill_report(out).collect()}
    assert set(report) == {"A", "B"} and all(0 <= r["gap"] <= 0.02 * r["windows"] for r in report.values())


def test_exchange_mends_what_partitions_waste(spark, monkeypatch):
    """Items of two sizes that fit together, in partitions too small to hold the right numbers of both."""
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 8)
    rows = [(i, 70 if i % 2 else 30, "") for i in range(160)]
    first = packing.windows(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("A", 1.0, 100)], "phase string, pct double, ctx int"))
    assert packing.fill_report(first).first()["gap"] <= 2


def test_empty_tables(spark):
    assert packed(spark, [(1, 5, "")][:0] or [(1, 0, "")], [("A", 1.0, 10)]).collect()[0]["window_id"] is None
    docs = spark.createDataFrame([(1, 5, "")], SCHEMA)
    phases = spark.createDataFrame([("A", 1.0, 10)], "phase string, pct double, ctx int")
    assert packing.windows(docs.limit(0), phases).count() == 0
    assert packing.windows(docs, phases.limit(0)).count() == 0


def test_repeated_rows_and_ties(spark):
    got = packed(spark, [(1, 5, "")] * 4, [("A", 1.0, 10)]).collect()
    assert len(got) == 4 and len({r["window_id"] for r in got}) == 2


def test_small_cases_are_best_or_one_more():
    for sizes in product([3, 4, 7], repeat=4):
        window = packing.best_fit_decreasing(np.array(sizes), 10)
        assert window.max() + 1 - fewest(sorted(sizes, reverse=True), 10) <= 1
