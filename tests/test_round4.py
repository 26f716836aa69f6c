"""Findings of round 4."""

from profseg.operators import refine


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_points_are_never_broadcast(spark):
    samples = spark.createDataFrame([("a", i, float(i % 5), i % 5 == 4) for i in range(60)], "target string, i long, g double, peak boolean")
    points = spark.createDataFrame([("a", 12), ("a", 31)], "target string, i long")
    variants = [{"name": n, "radius": r} for n, r in (("small", 1), ("large", 3))]
    moved = refine.snap_variants(points, samples, variants)
    assert "BroadcastExchange" not in plan_of(moved)
    assert {(r.variant, tuple(r.indexes)) for r in moved.collect()} == {("small", (13, 32)), ("large", (9, 29))}
    assert "BroadcastExchange" not in plan_of(refine.two_radii(points, samples, 1, 3, 1.5))
