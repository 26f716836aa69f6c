"""Findings of round 3."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from profseg.functions import scalars
from profseg.operators import clean, detect, features, refine, stats


def near_ties(k: int, seed: int) -> pd.DataFrame:
    """Profiles whose values differ in their last places."""
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(t, i, float(base * (1 + rng.integers(0, 3) * 2.3e-16))) for t in range(k) for base in [rng.uniform(1, 10)] for i in range(int(rng.integers(4, 30)))], columns=["target", "i", "g"])


@pytest.mark.parametrize("q", [0.6, 0.9])
def test_quantiles_between_near_ties_equal_sql(spark, duck, q):
    rows = near_ties(400, 1)
    want = duck.sql(f"select r.target, r.i from rows r join (select target, quantile_cont(g, {q}) as f from rows group by 1) f on f.target = r.target where g >= f order by all").fetchall()
    df = spark.createDataFrame(rows)
    got = sorted((r.target, r.i) for r in refine.confident(df, "g", q).collect())
    assert got == want
    # added peaks: no points near them
    none = spark.createDataFrame([], "target long, i long")
    assert sorted((r.target, r.i) for r in refine.augment(none, df.withColumn("peak", F.lit(True)), q, 3).collect()) == want
    floors = dict(duck.sql(f"select target, quantile_cont(g, {q}) from rows group by 1").fetchall())
    sorted_g = df.groupBy("target").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    assert {r.target: r.f for r in sorted_g.select("target", refine.linear_quantile(F.col("gs"), F.lit(q)).alias("f")).collect()} == floors


def test_weights_of_the_moving_cubic_are_rounded_once():
    for size in (5, 11, 81):
        places = [Fraction(i - size // 2) for i in range(size)]
        s2, s4 = (sum(p**k for p in places) for k in (2, 4))
        cubic = [p**3 - s4 / s2 * p for p in places]
        square = [p * p - s2 / size for p in places]
        exact = lambda a, i: Fraction(1, size) + places[a] * places[i] / s2 + square[a] * square[i] / sum(v * v for v in square) + cubic[a] * cubic[i] / sum(v * v for v in cubic)
        got = clean.moving_polynomial(size)
        assert all(got[a, i] == float(exact(a, i)) for a in (0, 1, size // 2, size - 1) for i in range(size))


def test_smoothing_puts_no_weights_into_the_plan(spark):
    df = spark.createDataFrame([("a", float(i), float(i % 7)) for i in range(100)], "target string, depth double, x double")
    plan = clean.smoothed(df, "x", 81)._jdf.queryExecution().analyzed().treeString()
    assert len(plan) < 200_000


def test_logarithms_of_zero_count_where_asked_for(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 0, 1.0, math.e - 1), ("a", 0, 1.0, None), ("a", 0, 1.0, -0.5)], "target string, segment_id int, SCPT_RES double, ratio double")
    assert features.engineered(df, ratio="ratio").first().log_ratio_mean == 1.0
    assert features.engineered(df, ratio="ratio", zeros=True).first().log_ratio_mean == 0.5
    assert df.select(scalars.log1p_from_zero(F.col("ratio")).alias("v")).filter("v = 0").count() == 1


def test_profiles_through_the_recursion_together_are_as_each_by_itself():
    rng = np.random.default_rng(5)
    signals = [np.concatenate([rng.normal(level, 0.1, rng.integers(1, 40)) for level in rng.uniform(1, 4, 3)]) for _ in range(60)] + [np.zeros(0), np.ones(1), np.ones(50)]
    hazards = [np.full(len(x), 0.03) if i % 3 else np.linspace(0.0, 0.2, len(x)) for i, x in enumerate(signals)]
    least = [int(v) for v in rng.integers(0, 7, len(signals))]
    factors = [(rng.uniform(0.2, 3, len(x)),) if i % 2 else () for i, x in enumerate(signals)]
    means = [float(np.median(x)) if len(x) else 0.0 for x in signals]
    for together in (1, 200, detect.TOGETHER):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(detect, "TOGETHER", together)
            found = detect.detect_all(signals, means, hazards, least, factors, (1.0, 1.0, 0.1))
        for x, m, h, r, f, got in zip(signals, means, hazards, least, factors, found, strict=True):
            want = detect.detect(x, detect.ScalarModel(len(x), m), h, r, f)
            assert got.boundaries.tolist() == want.boundaries.tolist() and got.run.tolist() == want.run.tolist()
            assert np.allclose(got.p_change, want.p_change, rtol=1e-9, atol=1e-300) and math.isclose(got.log_evidence, want.log_evidence, rel_tol=1e-12, abs_tol=1e-12)


def test_profiles_are_whole_whatever_the_batches():
    table = pa.table({"target": ["a"] * 5 + ["b"] + ["c"] * 4, "depth": [float(i) for i in range(10)]})
    for size in (1, 3, 10):
        found = [t for some in detect.profile_batches(iter(table.to_batches(size))) for t in some]
        assert [t.column("depth").to_pylist() for t in found] == [[0.0, 1.0, 2.0, 3.0, 4.0], [5.0], [6.0, 7.0, 8.0, 9.0]]


def test_correlations_rank_no_column_in_one_task(spark):
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"y": rng.integers(0, 40, 500).astype(float), "a": rng.integers(0, 9, 500).astype(float), "b": rng.normal(0, 1, 500), "c": 1.0})
    df = spark.createDataFrame(rows)
    ranks = {r.y: r.rank for r in stats.spread_ranks(df.withColumn("k", F.lit(1)), "y", ["k"], "rank").collect()}
    assert ranks == dict(zip(rows["y"], rows["y"].rank(), strict=True))
    found = stats.score_correlations(df, "y", ["a", "b", "c"])
    assert {r.column: round(r.rho, 9) for r in found.collect()} == {c: round(rows[c].rank().corr(rows["y"].rank()), 9) for c in "ab"}
    assert "collect_set" not in found._jdf.queryExecution().analyzed().treeString()
