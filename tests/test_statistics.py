"""Medians by selection, and comparisons that refuse what can't be compared."""

import random

import pandas as pd
import pytest

from loomspan.operators import evaluation as E

SCORED = "mode string, item_id long, m double"


@pytest.mark.parametrize("few", [1, 7, 10**6])
def test_medians_close_in_on_their_values(spark, few):
    rng = random.Random(few)
    groups = {
        "wide": [rng.gauss(0, 1) * 10 ** rng.randrange(-8, 9) for _ in range(2001)],
        "even": [rng.random() for _ in range(1500)],
        "same": [2.5] * 900,
        "two": [1.0] * 500 + [9.0] * 500,
        "tail": [0.0] * 700 + [float(i) for i in range(699)],
        "one": [4.0],
        None: [float(rng.randrange(5)) for _ in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("nothing", None)]
    rng.shuffle(rows)
    got = {r.k: (r.n, r.middle, r.upper_middle) for r in E.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", few).collect()}
    assert got == {g: (len(vs), float(pd.Series(vs).median()), sorted(vs)[len(vs) // 2]) for g, vs in groups.items()}


def test_medians_of_nothing_have_no_row(spark):
    assert E.medians(spark.createDataFrame([], "k string, v double"), "k", "v").collect() == []


def test_comparisons_need_the_same_items_and_some(spark):
    scored = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.1), ("b", 1, 0.6), ("b", 3, 0.1), ("c", 1, 0.5)], SCORED)
    for pair in (("a", "b"), ("a", "c"), ("a", "missing")):
        with pytest.raises(ValueError, match="same items"):
            E.paired(scored, *pair, "m", 100, 1)
    with pytest.raises(ValueError, match="nothing to compare"):
        E.paired(scored, "x", "y", "m", 100, 1)


def test_a_comparison_of_a_mode_that_always_wins(spark):
    rows = [(mode, i, 0.5 + (mode == "b") * 0.1 + i / 100) for i in range(30) for mode in "ab"]
    (row,) = E.comparisons(spark.createDataFrame(rows, SCORED), [("a", "b")], "m", 500, 3).collect()
    assert (row.difference, row.ci_low, row.ci_high, row.wins, row.losses, row.ties, row.significant) == (0.1, 0.1, 0.1, 30, 0, 0, True)
    assert row.p == pytest.approx(1 / 501, abs=1e-6)
    again = E.paired(spark.createDataFrame(rows, SCORED), "b", "a", "m", 500, 3).first()
    assert (again.difference, again.wins, again.losses) == (-0.1, 0, 30)


def test_the_draws_are_the_same_each_time_and_have_no_single_task(spark):
    rng = random.Random(2)
    scored = spark.createDataFrame([(mode, i, rng.random()) for i in range(40) for mode in "ab"], SCORED)
    first, second = (E.paired(scored, "a", "b", "m", 400, 20260910) for _ in range(2))
    assert first.first() == second.first()
    assert "Window" not in first._jdf.queryExecution().toString()
