"""Label smoothing over near targets without their edges."""

import numpy as np
import pytest

from profseg.operators import intervals, model, smoothing


def field(seed: int, n: int, line: bool):
    rng = np.random.default_rng(seed)
    segs, p, places = [], [], []
    for t in range(n):
        cuts = np.sort(rng.uniform(0, 10, int(rng.integers(2, 6)))).round(1)
        for s in range(len(cuts) - 1):
            segs.append((t, s, float(cuts[s]), float(cuts[s + 1])))
            p.append((t, s, rng.dirichlet([1, 1, 1]).tolist()))
        if t % 7:
            places.append((t, float(rng.uniform(0, 9)), 0.0 if line else float(rng.uniform(0, 4))))
        if t % 11 == 1:
            places.append((t, float(rng.uniform(20, 22)), 1.0))  # a second place
    return segs, p, [*places, (n + 5, 1.0, 1.0), (3, None, 1.0)]


@pytest.mark.parametrize(("line", "radius", "task_nodes"), [(True, 0.7, 10**6), (False, 1.0, 10**6), (False, 1.0, 30)])
def test_near_targets_without_edges_equal_the_graph(spark, monkeypatch, line, radius, task_nodes):
    made = []
    monkeypatch.setattr(smoothing, "segment_graph", lambda *a: made.append(a) or intervals.segment_graph(*a))
    segs, p, places = field(4, 60, line)
    segs = spark.createDataFrame(segs, "target long, segment_id int, top double, bottom double")
    p = spark.createDataFrame(p, "target long, segment_id int, p array<double>")
    places = spark.createDataFrame(places, "target long, x double, y double")
    table = lambda df: sorted((r.target, r.segment_id, r.cluster_id) for r in df.collect())
    want = table(model.smooth_segments(p, intervals.segment_graph(segs, places, radius, 0.5), 1.5))
    assert table(model.smooth_near(p, segs, places, radius, 0.5, 1.5, task_nodes=task_nodes)) == want
    assert want != table(model.smooth_segments(p, intervals.segment_graph(segs, places, radius, 0.5), 0.0))
    assert bool(made) == (task_nodes < 10**6)
    assert model.smooth_near(p.limit(0), segs, places, radius, 0.5, 1.5).collect() == []


def test_sweeps_that_end_too_early_are_told(spark):
    """A row whose labels turn one sweep at a time against the row order."""
    p = spark.createDataFrame([(t, 0, [0.45, 0.55]) for t in range(5)] + [(5, 0, [1.0, 0.0])], "target int, segment_id int, p array<double>")
    segs = spark.createDataFrame([(t, 0, 0.0, 1.0 + t) for t in range(6)], "target int, segment_id int, top double, bottom double")
    places = spark.createDataFrame([(t, float(t), 0.0) for t in range(6)], "target int, x double, y double")
    with pytest.warns(UserWarning, match="last of 1 sweeps"):
        model.smooth_near(p, segs, places, 1.0, 5.0, 10.0, sweeps=1).collect()
