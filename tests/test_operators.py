"""Edge cases of DataFrame operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from profseg.operators import clean, evaluate, features, intervals, model, stats
from profseg.plans import runs
from profseg.plans.config import Clustering
from profseg.sources import tables
from profseg.streaming import online


def iterative_merge(edges, least):
    segs = list(zip(edges, edges[1:]))
    while len(segs) > 1:
        thin = [i for i, (a, b) in enumerate(segs) if b - a < least]
        if not thin:
            break
        i = thin[0]
        if i == 0:
            segs[1] = (segs[0][0], segs[1][1])
        else:
            segs[i - 1] = (segs[i - 1][0], segs[i][1])
        segs.pop(i)
    return [segs[0][0], *[b for _, b in segs]] if segs else list(edges)


def test_thin_merge_equals_iteration(spark):
    rng = random.Random(5)
    cases = [sorted({round(rng.uniform(0, 6), 1) for _ in range(rng.randint(2, 9))}) for _ in range(200)]
    cases = [c for c in cases if len(c) > 1]
    df = spark.createDataFrame([(c,) for c in cases], "e array<double>")
    got = df.select("e", intervals.merge_thin(F.col("e"), 0.75).alias("m")).collect()
    assert [r.m for r in got] == [iterative_merge(r.e, 0.75) for r in got]


def brute_costs(pred, true):
    pairs, out = {(i, j): abs(p - t) for i, p in enumerate(pred) for j, t in enumerate(true)}, []
    while pairs:
        i, j = min(pairs, key=lambda k: (pairs[k], k))
        out.append(pairs[i, j])
        pairs = {k: v for k, v in pairs.items() if k[0] != i and k[1] != j}
    return out


def test_matching_equals_brute_force(spark):
    rng = random.Random(6)
    cases = [([rng.randint(0, 8) * 0.5 for _ in range(rng.randint(0, 4))], [rng.randint(0, 8) * 0.5 for _ in range(rng.randint(0, 4))]) for _ in range(100)]
    cases = [(sorted(p), sorted(t)) for p, t in cases]
    df = spark.createDataFrame(cases, "p array<double>, t array<double>")
    got = df.select("p", "t", evaluate.matched_costs(F.col("p"), F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [brute_costs(r.p, r.t) for r in got]


def test_scores_of_one_side(spark):
    pred = spark.createDataFrame([("a", 1.0)], "target string, boundary double")
    true = spark.createDataFrame([("b", 1.0)], "target string, boundary double")
    got = {r.target: (r.n_pred, r.n_true, r.f1_1_0) for r in evaluate.boundary_scores(pred, true).collect()}
    assert got == {"a": (1, 0, 0.0), "b": (0, 1, 0.0)}


def segmented(spark):
    rows = [(0, 0, 2, 0, 1, 10), (0, 0, 2, 1, 2, 20), (0, 0, 2, 2, 3, 30), (1, 2, 5, 2, 4, 40), (1, 2, 5, 3.5, 5, 50), (1, 2, 5, 5, 6, 60)]
    return spark.createDataFrame([("T1", int(s), float(a), float(b), float(d), float(x), float(y)) for s, a, b, d, x, y in rows], "target string, segment_id int, seg_top double, seg_bottom double, depth double, SCPT_RES double, SCPT_FRES double")


def test_shape_columns(spark):
    names = ["SCPT_RES", "SCPT_FRES"]
    s = features.shapes(segmented(spark), names, 32).withColumn("d", features.derivative(F.col("shape"), 32))
    wide = features.widen(s, {"shape": "r", "d": "d"}, names, 32)
    assert len(wide.columns) == 2 + 2 * 2 * 32 and {"SCPT_RES_r00", "SCPT_FRES_r31", "SCPT_RES_d31"} <= set(wide.columns)
    row = wide.orderBy("segment_id").first()
    assert row.SCPT_RES_r00 == 1.0 and row.SCPT_RES_r31 == 3.0
    p = features.paa(segmented(spark), names, 8)
    assert {len(r.paa) for r in p.collect()} == {8}


def test_shape_edge_cases(spark):
    rows = [("T1", 0, 0.0, 1.0, 0.5, 10.0, None), ("T1", 1, 1.0, 4.0, 2.5, 1.0, None), ("T1", 1, 1.0, 4.0, 2.5, 3.0, None), ("T1", 1, 1.0, 4.0, 3.0, 4.0, None)]
    df = spark.createDataFrame(rows, "target string, segment_id int, seg_top double, seg_bottom double, depth double, a double, b double")
    got = {(r.segment_id, r.sensor): r for r in features.shapes(df, ["a", "b"], 5).withColumn("d", features.derivative(F.col("shape"), 5)).collect()}
    assert got[0, "a"].shape == [10.0] * 5 and got[0, "a"].d == [0.0] * 5
    assert got[1, "a"].shape[0] == 2.0 and got[0, "b"].shape is None


def test_boundary_of_strata_belongs_below(spark):
    strata = spark.createDataFrame([("T", 0.0, 2.0, "A", 0), ("T", 2.0, 5.0, "B", 1), ("T", 6.0, 9.0, "C", 2)], "target string, top double, bottom double, unit string, file_pos long")
    rows = spark.createDataFrame([("T", d) for d in (0.0, 2.0, 5.0, 5.5, 6.0, 10.0, -1.0)], "target string, depth double")
    got = {r.depth: r.unit for r in intervals.asof_unit(rows, strata).collect()}
    assert got == {0.0: "A", 2.0: "B", 5.0: "B", 5.5: None, 6.0: "C", 10.0: None, -1.0: None}


def test_half_even_grid(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.5, 3.0), ("a", 2.5, 5.0)], "target string, depth double, x double")
    assert {(r.depth, r.x) for r in clean.collapse(df, 1.0, ["x"]).collect()} == {(0.0, 1.0), (2.0, 4.0)}


def test_constant_series(spark):
    df = spark.createDataFrame([("a", float(i), 2.0) for i in range(4)] + [("b", 0.0, None)], "target string, depth double, x double")
    got = {r.target: r for r in stats.series_stats(df, "x").collect()}
    assert (got["a"].skew, got["a"].kurtosis, got["a"].std_pop) == (0.0, -3.0, 0.0)
    assert got["b"].n == 1 and got["b"].n_finite == 0 and got["b"].mean is None


def test_fill_all_missing(spark):
    df = spark.createDataFrame([("a", 0.0, None), ("a", 1.0, None), ("b", 0.0, None), ("b", 1.0, 4.0)], "target string, depth double, x double")
    assert sorted((r.target, r.x) for r in clean.fill_by_index(df, "x").collect()) == [("a", 0.0), ("a", 0.0), ("b", 4.0), ("b", 4.0)]


def test_mixture_on_blobs(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, x array<double>")
    best, scores = model.select_by_bic(df, 2, 4, "diag", seed=1)
    assert len(best.weights) == 3 and min(scores, key=scores.get) == 3
    labels = [r.cluster_id for r in model.predict(df, best).orderBy("id").collect()]
    assert all(len(set(labels[i : i + 60])) == 1 for i in (0, 60, 120))


def test_tables(spark, tmp_path):
    path = tmp_path / "strata.csv"
    path.write_text("﻿PointID , Target,Top,Bottom,UNIT\np1,T1,0,1, A \np2,T1,1,2,B\np3,T2,x,2,C\n")
    df = tables.read_csv(spark, str(path))
    got = tables.strata(df)
    assert [(r.target, r.unit) for r in got.collect()] == [("T1", "A")]
    marks = spark.createDataFrame([("a", "1.5"), ("a", "1.5"), ("b", "x")], "TARGET string, Boundary_Depth string")
    assert [(r.target, r.boundary) for r in tables.boundaries(marks).collect()] == [("a", 1.5)]
    with pytest.raises(ValueError, match="boundary table"):
        tables.boundaries(marks.drop("TARGET"))


def test_registry_and_suite(tmp_path):
    reg = runs.Registry(tmp_path, "model_id")
    reg.save({"model_id": "m1", "parameters": {"n_clusters": 4}})
    with pytest.raises(ValueError, match="exists"):
        reg.save({"model_id": "m1"})
    (tmp_path / "best").mkdir()
    (tmp_path / "best" / "m1.json").write_text(json.dumps({"model_id": "m1", "best": True}))
    assert reg.load("m1")["best"]
    with pytest.raises(ValueError, match="folder"):
        reg.save({"model_id": "m2"}, "../x")
    results, errors = runs.run_suite([{"model_id": "a1"}, {"model_id": "a2"}], lambda e: {"nmi": 1.0} if e["model_id"] == "a1" else 1 / 0, "a")
    assert [r["model_id"] for r in results] == ["a1"] and errors[0]["error"].startswith("ZeroDivisionError")
    c = Clustering.of({"model_id": "m", "parameters": {"n_clusters": 20, "cluster_selection": "fixed", "covariance_type": "diag"}}, {"columns": [{"name": "qc"}], "representation": {"type": "paa", "bins": 8}})
    assert (c.clusters, c.representation, c.length, c.sensors) == ((20, 20), "paa", 8, ("qc",))


def test_run_table(spark, tmp_path):
    table = str(tmp_path / "runs")
    for source, nmi in (("ground_truth", 0.9), ("bocpd_estimate", 0.5), ("bocpd_estimate", None)):
        runs.record(spark, table, "m", {"input": "f"}, {"nmi": nmi}, source)
    df = spark.read.parquet(table)
    assert runs.best(df).first().nmi == 0.9
    row = runs.by_source(df).filter("metric = 'nmi'").first()
    assert row.delta == pytest.approx(0.4)


def test_online_detection(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(v, 0.1, 60) for v in (0.0, 3.0)])
    folder = tmp_path / "in"
    spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(x)], "target string, depth double, value double").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("target string, depth double, value double").parquet(str(folder))
    q = online.detect_online(stream, "value").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from found").collect()
    assert len(got) == 120
    assert any(r.changed and 58 <= r.depth <= 66 for r in got)


def test_nearest_equals_brute_force(spark):
    from profseg.operators import hazards

    rng = random.Random(10)
    points = [(i, float(rng.randrange(40)), float(rng.randrange(40))) for i in range(80)] + [(80, 1000.0, 1000.0), (81, None, 2.0)]
    df = spark.createDataFrame(points, "target long, x double, y double")
    got = {}
    for r in hazards.nearest(df, 3).collect():
        got.setdefault(r.target, set()).add(r.other)
    for i, x, y in points[:-1]:
        others = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in points[:-1] if j != i)
        assert got[i] == {j for _, j in others[:3]}
    assert hazards.nearest(df.limit(0), 3).count() == 0
    assert hazards.nearest(df.limit(1), 3).count() == 0
