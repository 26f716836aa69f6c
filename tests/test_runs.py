"""Whole runs, their sinks and sources, and kernels against plain forms."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profseg.operators import clean, detect, evaluate, hazards, intervals, linkage, model, refine, stats
from profseg.plans import charts, config, pipelines, queries, runs, search
from profseg.plans import testbed as tb
from profseg.sources import tables

DATA = "/root/testdata/sf0.001"


def student(x, df, mean, scale2):
    """log density of a Student-t variable."""
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * scale2) - (df + 1) / 2 * math.log(1 + (x - mean) ** 2 / (df * scale2))


def test_density_is_student_t():
    rng = np.random.default_rng(3)
    x = rng.normal(2, 0.5, 20)
    mu0, k0, a0, b0 = 1.5, 0.7, 1.3, 0.2
    m = detect.ScalarModel(len(x), mu0, k0, a0, b0)
    for t in range(len(x)):
        for r, got in enumerate(m.log_density(x[t])):
            seen = x[t - r : t]
            k, a = k0 + r, a0 + r / 2
            mu = (k0 * mu0 + seen.sum()) / k
            b = b0 + 0.5 * ((seen - seen.mean()) ** 2).sum() + k0 * r * (seen.mean() - mu0) ** 2 / (2 * k) if r else b0
            assert got == pytest.approx(student(x[t], 2 * a, mu, b * (k + 1) / (a * k)), abs=1e-9)
        m.learn(x[t])


def test_dropped_runs_change_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(v, 0.1, 120) for v in (1.0, 2.0, 1.4)])
    make = lambda: detect.ScalarModel(len(x), 1.5)
    for least in (0, 10):
        whole = detect.detect(x, make(), np.full(len(x), 0.01), least)
        cut = detect.detect(x, make(), np.full(len(x), 0.01), least, least_share=1e-12)
        assert whole.boundaries.tolist() == cut.boundaries.tolist()
        assert np.abs(whole.p_change - cut.p_change).max() < 1e-8


def test_posteriors_are_distributions(spark):
    rows = spark.createDataFrame([("a", i * 0.02, float(i > 10)) for i in range(20)], "target string, depth double, x double")
    sums = charts.posterior_map(rows, ["x"]).groupBy("depth").agg(F.sum(F.pow(F.lit(10.0), -F.col("heat"))).alias("s"), F.max("heat").alias("most")).collect()
    assert len(sums) == 20 and all(abs(r.s - 1) < 1e-3 and r.most <= 6 + 1e-9 for r in sums)


def test_nearest_in_crowds(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.normal(500, 3, (30, 2)), [[1e5, -1e5], [7, 7]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(999, None, 1.0)], "target int, x double, y double")
    got = {}
    for r in hazards.nearest(df, 3).collect():
        got.setdefault(r.target, set()).add(r.other)
    for i in range(len(at)):
        d = sorted((float(np.hypot(*(at[i] - at[j]))), j) for j in range(len(at)) if j != i)
        assert got[i] == {j for _, j in d[:3]}
    assert hazards.nearest(df.limit(1), 2).count() == 0 and hazards.nearest(df.limit(0), 2).count() == 0


def test_variants_are_snaps(spark):
    samples = queries._samples(spark, DATA)
    points = tb.every(tb.events(spark, DATA).select("target", "depth"), 10)
    variants = [{"name": "a", "radius": 2}, {"name": "b", "radius": 4, "nearest": True, "strength": 1.5, "drop": 0.2, "separation": 6}]
    both = refine.snap_variants(points, samples, variants)
    rows = lambda df: sorted((r.target, r.indexes) for r in df.collect())
    assert rows(both.filter("variant = 'a'")) == rows(refine.snap(points, samples, 2))
    assert rows(both.filter("variant = 'b'")) == rows(refine.snap(points, samples, 4, 1.5, 0.2, True, 6))


def test_grids_have_their_sizes():
    assert {k: len(a.combinations()) for k, a in search.GRIDS.items()} == {"quick": 30, "standard": 240, "extended": 960}
    assert len(search.ABLATION) == 9 and len({search.refinement_name(v) for v in search.REFINEMENTS}) == 12


def test_grid_equals_single_runs(spark):
    """A combination of the grid finds what a run under the same settings finds."""
    rows = tb.events(spark, DATA).select("target", "depth", "value").filter("target <= 4")
    tops = queries._tops(spark, DATA).filter("target <= 4")
    axes = search.Axes([(1.0, 0.5)], [("tv", 0.3)], [False], [0.5], ["const"], [False])
    got = search.grid_search(rows, "value", tops, axes, 10.0, 24.0, beta=500.0).first()
    prior = hazards.adaptive_kappa(rows, "value", 24.0, 24.0, 24.0, 720.0)
    spec = rows.join(prior, "target").withColumns({"h": hazards.constant(F.col("kappa")), "least_run": F.lit(round(12 / 10))})
    points = detect.change_points(spec, ["value"], beta=500.0, smooth="tv", min_separation=1).filter("boundary_index is not null")
    assert got["rank"] == 1 and got.soft == 1.0
    samples = queries._samples(spark, DATA)
    moved = refine.snap(points.select(F.col("target").cast("long").alias("target"), F.col("boundary_index").cast("int").alias("i")), samples, round(12 / 10), separation=1)
    found = moved.select("target", F.explode("indexes").alias("i")).join(samples, ["target", "i"]).select("target", F.col("depth").alias("boundary"))
    want = evaluate.pooled_scores(evaluate.boundary_scores(found, tops, (24.0,)), (24.0,)).first()
    assert got.f1_24_0 == pytest.approx(want.pooled_f1, abs=1e-4)


def test_agglomerate_many_rows(spark):
    """Mutually nearest pairs over blocks give the labels of the method in memory."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (4000, 3)), rng.normal(3, 0.5, (950, 3))])
    x = rng.permutation(np.concatenate([x, x[:50]]))  # some are alike
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "id int, x array<double>").repartition(4)
    got = {r.id: r.cluster_id for r in model.agglomerate(df, ["id"], 12).collect()}
    assert [got[i] for i in range(len(x))] == model.ward(x, 12).tolist()


def test_agglomerate_groups_ties_and_edges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 16)
    groups = {"a": rng.normal(0, 1, (150, 2)), "b": rng.normal(0, 1, (90, 2)) * 5, "one": np.zeros((1, 2)), "same": np.ones((30, 2)), "few": rng.normal(0, 1, (5, 2))}
    rows = [(g, i, v.tolist()) for g, part in groups.items() for i, v in enumerate(part)]
    df = spark.createDataFrame([*rows, ("a", 999, None)], "g string, i int, x array<double>")
    want = {(g, i): c for g, part in groups.items() for i, c in enumerate(linkage.ward(part, 4) if g != "same" else [0] * 30)}
    assert {(r.g, r.i): r.cluster_id for r in model.agglomerate(df, ["g", "i"], 4, "g", task_rows=100).collect()} == want
    grid = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(49)], "i int, x array<double>")  # many ties
    assert len({r.cluster_id for r in model.agglomerate(grid, ["i"], 5, task_rows=25).collect()}) == 5
    assert model.agglomerate(grid.limit(0), ["i"], 5).collect() == []


def test_dendrogram_heights(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 32)
    x = np.random.default_rng(9).normal(0, 1, (200, 4))
    points = spark.createDataFrame([(0, i, 1, x[i].tolist()) for i in range(len(x))], "g int, id long, size long, x array<double>")
    got = sorted(r.height for r in linkage.dendrogram(points, 60).collect())
    assert np.allclose(got, sorted(m[0] for m in linkage.merges_of(x))) and len(got) == 199


@pytest.mark.parametrize(("n", "links", "task_nodes"), [(40, 90, 20_000), (40, 60, 9), (9, 14, 1)])
def test_smoothing_in_row_order_whatever_the_blocks(spark, n, links, task_nodes):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([1, 1, 1], n)
    pairs = sorted({tuple(sorted(map(int, rng.choice(n - 1, 2, replace=False)))) for _ in range(links)})
    weights = rng.uniform(0.5, 1.5, len(pairs))
    table = spark.createDataFrame([(i, 0, p[i].tolist()) for i in range(n)], "target int, segment_id int, p array<double>")
    rows = [(a, 0, b, 0, float(w)) for (a, b), w in zip(pairs, weights, strict=True)]
    graph = spark.createDataFrame([*rows, (0, 0, 99, 0, 5.0)], "a int, a_segment int, b int, b_segment int, weight double")
    unary = -np.log(np.clip(p, 1e-10, 1))
    got = {r.target: r.cluster_id for r in model.smooth_segments(table, graph, 0.8, task_nodes=task_nodes).collect()}
    want = model.smooth_labels(unary, [(r[0], r[2], r[4]) for r in rows], 0.8).tolist()
    assert [got[i] for i in range(n)] == want and want != unary.argmin(axis=1).tolist()


def test_smoothing_stops_as_in_memory_and_says_so(spark):
    """A path whose labels turn one sweep at a time against the row order."""
    n = 6
    unary = np.array([[0.9, 0.0]] * (n - 1) + [[0.0, 9.0]])
    p = np.exp(-unary).tolist()
    table = spark.createDataFrame([(i, 0, p[i]) for i in range(n)], "target int, segment_id int, p array<double>")
    graph = spark.createDataFrame([(i, 0, i + 1, 0, 1.0 + i) for i in range(n - 1)], "a int, a_segment int, b int, b_segment int, weight double")
    links = [(i, i + 1, 1.0 + i) for i in range(n - 1)]
    with pytest.warns(UserWarning, match="last of 2 sweeps"):
        got = {r.target: r.cluster_id for r in model.smooth_segments(table, graph, 1.0, sweeps=2, task_nodes=3).collect()}
    assert [got[i] for i in range(n)] == model.smooth_labels(unary, links, 1.0, 2).tolist() != model.smooth_labels(unary, links, 1.0).tolist()
    assert model.smooth_segments(table.limit(0), graph, 1.0).collect() == []


def strata_of(spark):
    rows = [(t, a, b, u, i) for t in range(1, 7) for i, (a, b, u) in enumerate([(0.0, 1.0, "A"), (1.0, 2.0, "B"), (2.0, 3.0, "A"), (3.0, 4.5, "C")])]
    return spark.createDataFrame(rows, "target int, top double, bottom double, unit string, file_pos int")


def test_clustering_writes_its_tables(spark, tmp_path):
    rows = [(t, i * 0.5, t + i * 1.0, 10.0 * i + t, 5.0 - i) for t in range(1, 7) for i in range(10)]
    df = spark.createDataFrame(rows, "target int, depth double, SCPT_RES double, SCPT_FRES double, SCPT_PWP2 double")
    strata = strata_of(spark)
    cfg = config.Clustering.of({"model_id": "smoke", "model_type": "gmm", "parameters": {"n_clusters": 3, "covariance_type": "diag", "random_state": 1}}, {"columns": [{"name": c} for c in ("SCPT_RES", "SCPT_FRES")], "segment_stats": ["mean", "std"], "extra_derived": ["Rf"]})
    done = pipelines.run_clustering(df, strata, pipelines.boundaries_of(cfg, strata), cfg)
    assert done.columns == ["SCPT_RES_mean", "SCPT_RES_std", "SCPT_FRES_mean", "SCPT_FRES_std", "thickness", "Rf_mean", "Rf_std", "Rf_median"]
    root = f"file://{tmp_path}"
    name = pipelines.save_clustering(done, cfg, root, source="smoke.csv")
    folder = tmp_path / "runs" / "smoke" / name
    assert {"segments", "segment_features", "clustered_segments", "clustered_measurements", "summary"} <= {x.name for x in folder.iterdir()}
    assert spark.read.parquet(f"{root}/runs/smoke/{name}/clustered_measurements").count() == len(rows)
    summary = json.loads(spark.read.text(f"{root}/runs/smoke/{name}/summary").first().value)
    assert summary["n_segments"] == 24 and summary["n_clusters"] <= 3 and set(summary["metrics"]) >= {"accuracy", "ari", "nmi"}
    table = spark.read.parquet(f"{root}/run_table")
    assert runs.latest(table).first().run == name and runs.best(table).first().run == name
    frames = charts.interval_frames(strata, done.clustered_segments).collect()
    assert {r.side for r in frames} == {"reference", "predicted"} and frames == sorted(frames, key=lambda r: (r.target, r.side, r.top))
    text = charts.markdown("Run", {"metrics": done.metrics, "report": done.report})
    assert text.startswith("# Run") and "| accuracy |" in text


def test_boundary_sources(spark):
    strata = strata_of(spark)
    given = spark.createDataFrame([(1, 0.7)], "target int, boundary double")
    of = lambda source, **k: sorted(tuple(r) for r in pipelines.boundaries_of(config.Clustering(source=source), strata, **k).filter("target = 1").collect())
    assert of("ground_truth") == [(1, 1.0), (1, 2.0), (1, 3.0)]
    assert of("bocpd_estimate", estimate=given) == of("perfect_recall", recall=given) == [(1, 0.7)]
    with pytest.raises(ValueError, match="needs a table"):
        of("perfect_recall")
    with pytest.raises(ValueError, match="unknown boundary_source"):
        of("other")


def test_labels_must_be_unique(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "target int, segment_id int, x double")
    labels = spark.createDataFrame([(1, 0, 3)], "target int, segment_id int, cluster_id int")
    assert sorted((r.segment_id, r.cluster_id) for r in intervals.with_labels(rows, labels).collect()) == [(0, 3), (1, None)]
    with pytest.raises(Exception, match="repeat"):
        intervals.with_labels(rows, labels.unionByName(labels)).count()


def test_datasets(spark, tmp_path):
    (tmp_path / "boundaries").mkdir()
    for name in ("x_CPT_clean.csv", "boundaries/b.csv", "boundaries/a.csv", "boundaries/c.txt"):
        (tmp_path / name).write_text("Target\n1\n")
    data = tables.Dataset(f"file://{tmp_path}", "x_")
    assert data.path("cpt").endswith("x_CPT_clean.csv") and data.missing(spark) == ["strata", "locations"]
    with pytest.raises(FileNotFoundError, match="Strata"):
        data.check(spark)
    assert data.boundary_files(spark) == ["a.csv", "b.csv"] and tables.Dataset(f"file://{tmp_path}/none").boundary_files(spark) == []
    with pytest.raises(ValueError, match="unknown dataset profile"):
        tables.Dataset("x", profile="other").path("cpt")
    rows = spark.createDataFrame([("a", 1.0)], "target string, depth double")
    with pytest.raises(ValueError, match="no targets"):
        tables.pick_targets(rows, include=["b"], need_some=True)
    tables.write_all({"one": rows.withColumn("list", F.array(F.lit(1)))}, f"file://{tmp_path}/out", "csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/one").first().list == "[1]"


def test_feature_set_labels():
    assert config.summary_of({"segment_stats": ["mean"], "columns": [1, 2]})["representation_config_label"] == "stats: mean"
    assert config.summary_of({"representation": {"type": "paa", "bins": 8}})["comparison_representation_label"] == "paa (bins=8)"
    assert config.summary_of({"representation": {"type": "resample", "length": 32}})["representation_size_label"] == "32"
    assert config.summary_of({"representation": {"type": "fft", "bands_cycles_per_m": [[1, 2]]}})["comparison_representation_label"] == "fft (0.25-8.0 cyc/m)"


def test_joined_names_and_counts(spark):
    a = spark.createDataFrame([(1, 2, 0.5)], "target int, n_pred int, f1 double")
    b = spark.createDataFrame([(1, 3, 7.0), (2, 4, 8.0)], "target int, n_pred int, snr double")
    assert stats.with_diagnostics(a, b).first().asDict() == {"target": 1, "n_pred": 2, "f1": 0.5, "n_pred_diag": 3, "snr": 7.0}
    change = stats.change_counts(spark.createDataFrame([(1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (0.0, 1.0)], "a double, b double"), "a", "b").first()
    assert tuple(change) == (2, 1, 1)
    d = runs.delta(spark.createDataFrame([("x", 1.0)], "k string, v double"), spark.createDataFrame([("x", 3.0), ("y", 1.0)], "k string, v double"), "k", ["v"])
    assert sorted((r.k, r.v_delta) for r in d.collect()) == [("x", 2.0), ("y", None)]
    mean = stats.bootstrap_mean(spark.createDataFrame([(float(i % 2),) for i in range(400)], "v double"), "v", 500).first()
    assert mean["mean"] == 0.5 and 0.43 < mean.low < 0.48 and 0.52 < mean.high < 0.57


def test_windowed_means(spark, tmp_path):
    from profseg.streaming import online

    rows = [("a", f"2024-01-0{1 + i // 4} 0{i}:00:00", float(i)) for i in range(8)] + [("a", "2024-01-01 05:00:00", None)]
    df = spark.createDataFrame(rows, "target string, at string, value double").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    query = online.windowed_means(stream, "at", "value").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r["mean"], r.n) for r in spark.table("means").orderBy("start").collect()] == [(1.5, 4), (5.5, 4)]


def test_order_of_rows_over_several_files_and_splits(spark, tmp_path):
    """The first point of a target is that of the first file by name, however files are packed and split into tasks."""
    head = "PointID,Target,Top,Bottom,UNIT\n"
    (tmp_path / "a.csv").write_text(head + "first,T1,0,1,A\n" + "".join(f"p{i},T{i},{i},{i + 1},A\n" for i in range(2, 40)))
    (tmp_path / "b.csv").write_text(head + "second,T1,0,2,B\n" + "".join(f"q{i},T{i},{i},{i + 1},{'B' * 50}\n" for i in range(2, 4000)))
    rows = tables.read_csv(spark, str(tmp_path))
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r.target: (r.point_id, r.unit[0]) for r in tables.strata(rows).collect()}
            order = [(r.file_pos.file.rsplit("/", 1)[1], r.point_id) for r in tables.strata(rows).orderBy("file_pos").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {f"T{i}": ("first" if i == 1 else f"p{i}" if i < 40 else f"q{i}", "A" if i < 40 else "B") for i in range(1, 4000)}
        assert order == [("a.csv", "first"), *[("a.csv", f"p{i}") for i in range(2, 40)], *[("b.csv", f"q{i}") for i in range(40, 4000)]]
    places = tables.locations(tables.read_csv(spark, str(tmp_path)).select("Target", F.col("Bottom").alias("X"), F.lit("1").alias("Y"), F.lit("").alias("Z")))
    assert {r.target: r.x for r in places.filter("target in ('T1', 'T50')").collect()} == {"T1": 1.0, "T50": 51.0}
    segs = spark.createDataFrame([("T1", 0, 0.0, 2.0)], "target string, segment_id int, top double, bottom double")
    ties = tables.strata(spark.createDataFrame([("p", "T1", "0", "1", "X"), ("p", "T1", "1", "2", "Y")], "PointID string, Target string, Top string, Bottom string, UNIT string").coalesce(1))
    assert intervals.dominant_unit(segs, ties).first().unit == "X"


def test_presets_are_the_standard_runs():
    c, b = config.CANDIDATE, config.BASELINE
    assert (c.mean_from_signal, c.base, c.contrast, c.smooth, c.neighbours) == (False, "const", None, "savgol", 0)
    assert (c.adaptive_thickness, c.adaptive_base, c.adaptive_least, c.adaptive_most, c.adaptive_smooth) == (True, 1.0, 0.75, 30.0, 0)
    assert (c.least_thickness, c.refine_radius, c.refine_smooth, c.refine_ratio, c.auto_drop, c.drop_quantile) == (0.75, 0.3, 0, None, True, None)
    assert (b.mean_from_signal, b.expected_thickness, b.adaptive_thickness, b.least_thickness, b.refine_radius, b.contrast, b.smooth) == (False, None, False, 0.0, 0.0, False, None)
    for name, e in search.ABLATION.items():
        assert not e.mean_from_signal and e.contrast is False and not e.adaptive_thickness and e.smooth is None and e.drop_quantile is None
        assert e.base == ("depth" if "depth" in name else "const") and e.expected_thickness == (0.6 if "k30" in name else None)
        assert e.least_thickness == (0.5 if "minthick" in name else 0.0) and e.refine_smooth == 5
        assert e.refine_radius == (0.3 if "r03" in name else 0.7 if "refine" in name else 0.0)
    assert [len(e.features) for e in search.MULTIVARIATE.values()] == [2, 2, 3] and all(e.contrast is False for e in search.MULTIVARIATE.values())


def test_smoothing_equals_the_plain_form_on_profiles_of_any_length(spark):
    rng = np.random.default_rng(12)
    x = {n: rng.normal(0, 1, n) for n in (1, 2, 3, 4, 5, 6, 11, 12, 40)}
    df = spark.createDataFrame([(n, float(i), float(v)) for n, values in x.items() for i, v in enumerate(values)], "target int, depth double, x double")
    for window in (0, 3, 5, 10, 11, 41):
        got = {}
        for row in clean.smoothed(df, "x", window, "y").orderBy("target", "depth").collect():
            got.setdefault(row.target, []).append(row.y)
        for n, values in x.items():
            size = detect.odd_window(window + 1 - window % 2, n) if window >= 3 else 0
            assert np.allclose(got[n], detect.savitzky_golay(values, size, min(3, size - 1)) if size else values, atol=1e-9)


def test_least_run_holds_between_extracted_points(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([np.full(9, 0.0), np.full(3, 6.0), np.full(3, -6.0), np.full(20, 3.0)]) + rng.normal(0, 0.05, 35)
    df = spark.createDataFrame([("a", i * 0.1, float(v), 6) for i, v in enumerate(x)], "target string, depth double, x double, least_run int")
    at = [r.boundary_index for r in detect.change_points(df, ["x"]).collect()]
    assert at and (np.diff(at) >= 6).all()


def test_sweep_has_all_its_rows_and_experiments_on_vectors(spark):
    rng = np.random.default_rng(14)
    rows = [(t, i * 0.02, float(level + rng.normal(0, 0.1)), float(-level + rng.normal(0, 0.1))) for t in ("a", "b") for i in range(120) for level in [(0.0, 2.0, -1.0)[i // 40]]]
    df = spark.createDataFrame(rows, "target string, depth double, Ic double, other double")
    truth = spark.createDataFrame([(t, b) for t in ("a", "b") for b in (0.8, 1.6)], "target string, boundary double")
    table = {r.variant: r for r in search.refine_sweep(df, truth, search.ABLATION["uni_Ic_k30_minthick05"], 0.02).collect()}
    assert len(table) == 1 + 12 + 5 + 11 + 4 + 4
    assert {"base_no_refine", "r0.7_nearest_peak_sr1.5", "r0.3_argmax_conf_q0.30", "r0.7_argmax_sw81", "r0.3_argmax_sw0", "hybrid_r03_r07_ratio2.0", "aug_topg0.95_r0.3_argmax"} <= set(table)
    assert table["r0.3_argmax_sw5"].f1_0_5 == table["r0.3_argmax"].f1_0_5 == table["r0.3_argmax_conf_q0.00"].f1_0_5 == 1.0
    mv = {"mv": search.replace(search.MULTIVARIATE["mv_logQtn_logFr_depth_minthick"], features=("Ic", "other"))}
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "target string, x double, y double")
    points, scores = search.ablation(df, truth, mv, 0.02, places)
    assert {r.method: r.f1_0_5 for r in scores.collect()} == {"mv": 1.0, "mv__spatial": 1.0}
    assert {r.target for r in points.collect()} == {"a", "b"}
    auto = pipelines.detect_profiles(df, search.replace(config.CANDIDATE, least_thickness=0.5), 0.02).collect()
    assert sorted((r.target, round(r.boundary, 1)) for r in auto) == [("a", 0.8), ("a", 1.6), ("b", 0.8), ("b", 1.6)]


def test_bootstrap_interval(spark):
    """Nearly the interval of the normal approximation, the same however often it is taken, also of constants and of nothing."""
    rng = np.random.default_rng(16)
    x = rng.normal(5, 2, 600)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").coalesce(2)
    a, b = (stats.bootstrap_mean(df, "v", 2000).first() for _ in range(2))
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert a == b and abs(a["mean"] - x.mean()) < 1e-9
    assert abs(a.low - (x.mean() - half)) < 0.03 and abs(a.high - (x.mean() + half)) < 0.03
    same = stats.bootstrap_mean(df.select(F.lit(3.0).alias("v")), "v", 50).first()
    assert (same["mean"], same.low, same.high) == (3.0, 3.0, 3.0)
    assert stats.bootstrap_mean(df.limit(0), "v", 50).first().low is None


def test_density_by_cells_is_the_whole_sum(spark):
    rng = np.random.default_rng(17)
    places = [(f"t{i}", float(rng.uniform(0, 10)), float(rng.uniform(0, 10))) for i in range(6)]
    points = [(t, float(b)) for t, _, _ in places for b in rng.uniform(-30, 60, 9)]
    grid = [(t, float(d)) for t, _, _ in places for d in rng.uniform(-30, 60, 25)]
    make = spark.createDataFrame
    out = hazards.neighbour_density(make(places, "target string, x double, y double"), make(points, "target string, boundary double"), make(grid, "target string, depth double"), 3, 0.7)
    for row in out.collect():
        here = next(p for p in places if p[0] == row.target)
        near = sorted((math.hypot(here[1] - x, here[2] - y), t) for t, x, y in places if t != here[0])[:3]
        total = sum(1 / (d + 1) for d, _ in near)
        want = sum(1 / (d + 1) / total * math.exp(-0.5 * ((row.depth - b) / 0.7) ** 2) / (math.sqrt(2 * math.pi) * 0.7) for d, t in near for u, b in points if u == t)
        assert abs(row.density - want) < 1e-12


def test_best_run_of_all_and_of_each_folder(spark):
    rows = [("m1", "r1", 0.4, "a/x"), ("m1", "r3", 0.9, "a/x"), ("m2", "r2", 0.9, "b/y"), ("m3", "r2", None, "b/y"), ("m4", "r4", -0.2, "c")]
    df = spark.createDataFrame(rows, "model_id string, run string, nmi double, input string")
    assert [tuple(r) for r in runs.best_of_all(df).collect()] == [(None, "m2", "r2", 0.9)]
    got = {tuple(r) for r in runs.best_of_all(df, F.substring_index("input", "/", 1)).collect()}
    assert got == {("a", "m1", "r3", 0.9), ("b", "m2", "r2", 0.9), ("c", "m4", "r4", -0.2)}
