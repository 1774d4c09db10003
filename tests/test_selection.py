"""Exact quantiles by narrowing equal numpy's on hot groups, ties, nulls and odd ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paygrid.operators import pay, rolegap
from paygrid.operators.selection import FINE, box_stats, describe, medians

FRACTIONS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def _values(kind, rng):
    return {
        "distinct": [rng.random() * 1e6 for _ in range(30000)],
        "one range": [100000 + i / (4 * FINE) for i in range(20000)],       # all in one coarse range
        "steep": [2.0 ** rng.uniform(-30, 60) for _ in range(3000)],
        "signs": [rng.choice([-1, 1]) * rng.random() * 50 for _ in range(2001)] + [0.0] * 7,
        "ties": [rng.choice([5.0, 5.0, 7.0]) for _ in range(1000)],
        "one": [42.5],
        "two": [1.0, 2.0],
    }[kind]


@pytest.mark.parametrize("kind", ["distinct", "one range", "steep", "signs", "ties", "one", "two"])
def test_quantiles_equal_numpy(spark, kind):
    values = _values(kind, random.Random(kind))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = describe(df, [], "v", FRACTIONS).collect()[0]
    for name, f in FRACTIONS.items():
        assert row[name] == pytest.approx(np.quantile(values, f), rel=1e-12, abs=1e-12), name
    assert (row["n"], row["lo"], row["hi"]) == (len(values), min(values), max(values))
    assert row["mean"] == pytest.approx(np.mean(values))


def test_groups_with_nulls(spark):
    rows = [("a", 1, 3.0), ("a", 1, 1.0), ("a", None, 9.0), (None, None, 4.0), (None, None, 6.0), ("b", 2, None), ("a", 1, None)]
    got = {(r["g"], r["h"]): (r["n_rows"], r["n"], r["median"])
           for r in medians(spark.createDataFrame(rows, "g string, h int, v double"), ["g", "h"], "v").collect()}
    assert got == {("a", 1): (3, 2, 2.0), ("a", None): (1, 1, 9.0), (None, None): (2, 2, 5.0), ("b", 2): (1, 0, None)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert [r.asDict() for r in describe(empty, [], "v", {"m": 0.5}).collect()] == [
        {"n_rows": 0, "n": 0, "lo": None, "hi": None, "mean": None, "m": None}]
    assert medians(empty, ["g"], "v").collect() == []
    assert box_stats(empty, "g", "v").collect() == []


def test_hot_group_beside_many_small_ones(spark):
    rng = np.random.default_rng(5)
    hot, small = rng.normal(1e5, 3e4, 40000), rng.integers(1, 9, 900)
    rows = [("hot", float(v)) for v in hot] + [(f"s{i % 300}", float(v)) for i, v in enumerate(small)]
    got = {r["g"]: r for r in medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert len(got) == 301 and got["hot"]["median"] == pytest.approx(np.median(hot), rel=1e-12)
    for i in range(300):
        assert got[f"s{i}"]["median"] == np.median(small[i::300])


def test_box_whiskers_are_data(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 100]] + [("a", None), (None, 3.0)]
    r, = box_stats(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert (r["n"], r["q1"], r["median"], r["q3"]) == (6, 2.25, 3.5, 4.75)
    assert (r["whisker_lo"], r["whisker_hi"], r["n_outliers"]) == (1.0, 5.0, 1)


def test_no_buffer_of_values_in_the_plan(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = medians(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


def test_curve_needs_two_values(spark):
    rows = [(1.0, 2.0, v) for v in (5.0, 5.0)]
    assert pay.kde_curve(spark.createDataFrame(rows, "salary_min double, salary_max double, mid_usd double")).collect() == []


def test_summary_of_one_posting(spark):
    cols = "job_id string, k long, company string, title string, salary_min double, salary_max double, description_md string, department string, scope_score int, mid double"
    rows = [(str(i), i, "c", f"t{i}", 10.0 * i, 10.0 * i + 10, "x", "d", 5, 10.0 * i + 5) for i in range(1, 8)]
    r = spark.createDataFrame(rows + [("x", 9, "other", "t", 1.0, 3.0, "x", "d", 5, 2.0)], cols)
    got, = rolegap.posting_summary(r, "4").collect()
    assert (got["n_comparables"], got["comp_median"], got["gap"], got["direction"]) == (6, 45.0, 0.0, "below")
    assert got["percentile"] == pytest.approx(400 / 7)
    alone, = rolegap.posting_summary(r, "x").collect()
    assert (alone["percentile"], alone["n_comparables"], alone["comp_median"]) == (100.0, 0, None)
    assert rolegap.posting_summary(r, "none").collect() == []
