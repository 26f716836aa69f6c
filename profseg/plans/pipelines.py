"""Whole runs: change points of profiles under a Detection, clusters of segments under a Clustering, and their tables."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, detect, evaluate, hazards, intervals, model, refine, spectral, stats
from ..operators import features as feat
from ..sources import tables
from . import runs
from .config import Clustering, Detection


def _samples(thickness: float, step: float) -> int:
    return max(1, round(thickness / step))


def _rows(df: DataFrame, x: str) -> DataFrame:
    return df.select(F.col("target").cast("string").alias("target"), F.col("depth").cast("double").alias("depth"), F.col(x).cast("double").alias("x"))


def _noise(rows: DataFrame, step: float) -> DataFrame:
    """(target, iqr, local_noise and the columns of contrast_parameters())."""
    iqr = rows.groupBy("target").agg((F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"))
    both = hazards.local_noise(rows, "x", max(2, round(0.15 / step))).join(iqr, "target")
    return both.select("*", *[c.alias(n) for n, c in hazards.contrast_parameters(F.col("iqr"), F.col("local_noise")).items()])


def _prior(rows: DataFrame, cfg: Detection) -> DataFrame:
    return hazards.adaptive_kappa(rows, "x", cfg.least_thickness, cfg.adaptive_base, cfg.adaptive_least, cfg.adaptive_most, smooth=cfg.adaptive_smooth)


def detect_profiles(df: DataFrame, cfg: Detection, step: float = 0.02, places: DataFrame | None = None, with_probability: bool = False, around: DataFrame | None = None) -> DataFrame:
    """(target, i, boundary) of profiles (target, depth, the feature or features), and p_change if asked for (without refinement).
    `step` turns windows into samples; hazards use each profile's own. With neighbours, the density of the points (target,
    boundary) in `around` is a factor; without these, of the points that a first pass finds. Vectors aren't refined."""
    sensors = list(cfg.features) or [cfg.feature]
    if len(sensors) > 1 and (cfg.contrast is not False or cfg.adaptive_thickness):
        raise ValueError("contrast and adaptive thickness are those of one feature")
    rows = df.select(F.col("target").cast("string").alias("target"), F.col("depth").cast("double").alias("depth"), *[F.col(c).cast("double").alias("x" if len(sensors) == 1 else f"x{i}") for i, c in enumerate(sensors)])
    rows = clean.spread(rows, "target")  # once: windows, statistics and joins by target stay in these partitions
    signals = ["x"] if len(sensors) == 1 else [f"x{i}" for i in range(len(sensors))]
    spec = rows.join(clean.step_of(rows), "target")
    if cfg.adaptive_thickness:
        spec = spec.join(_prior(rows, cfg).select("target", "kappa", "thickness"), "target")
    if cfg.base == "depth":
        first = F.col("thickness") if cfg.adaptive_thickness else 1.0
        spec = spec.withColumn("h", hazards.depth_aware(F.col("depth"), F.col("step"), first))
    elif cfg.adaptive_thickness:
        spec = spec.withColumn("h", hazards.constant(F.col("kappa")))
    elif cfg.expected_thickness:
        spec = spec.withColumn("h", hazards.constant(cfg.expected_thickness / F.col("step")))
    spec = spec.drop("kappa", "thickness")
    if cfg.least_thickness:
        spec = spec.withColumn("least_run", hazards.least_run(cfg.least_thickness, F.col("step")))
    if cfg.contrast is not False:
        strength = F.lit(cfg.contrast_strength)
        spec = hazards.lr_contrast(spec, "x", _samples(cfg.contrast_window, step))
        if cfg.contrast is None:
            spec = spec.join(_noise(rows, step).select("target", F.col("contrast_strength").alias("strength")), "target")
            strength = F.col("strength")
        spec = hazards.with_rate_factor(spec, "contrast", strength, "factor")

    def found(rows: DataFrame) -> DataFrame:
        out = detect.change_points(rows, signals, cfg.mean_from_signal, cfg.kappa, cfg.alpha, cfg.beta, smooth=cfg.smooth, least_share=cfg.least_share)
        return out.filter("boundary_index is not null").select("target", F.col("boundary_index").alias("i"), F.col("boundary_depth").alias("boundary"), "p_change")

    points = around.select(F.col("target").cast("string").alias("target"), "boundary") if around is not None else found(spec)
    if cfg.neighbours and places is not None:
        near = places.withColumn("target", F.col("target").cast("string"))
        density = hazards.neighbour_density(near, points, rows.join(near, "target", "left_semi"), cfg.neighbours, cfg.bandwidth)
        spec = spec.join(density, ["target", "depth"], "left").fillna(0.0, ["density"])
        spec = hazards.with_rate_factor(spec, "density", cfg.neighbour_strength, "around")
        spec = spec.withColumn("factor", F.col("around") * F.col("factor") if "factor" in spec.columns else F.col("around")).drop("around", "density")
        points = found(spec)
    if not cfg.refine_radius or len(sensors) > 1:
        return points if with_probability else points.drop("p_change")
    samples = refine.with_gradient(rows.join(clean.step_of(rows), "target"), "x", F.col("step"), cfg.refine_smooth)
    apart = cfg.least_separation or cfg.least_thickness
    separation = _samples(apart, step) if apart else 0
    drop = cfg.drop_quantile
    if cfg.auto_drop:
        points = points.join(_noise(rows, step).select("target", F.col("drop_quantile").alias("_drop")), "target")
        drop = F.col("_drop")
    moved = refine.snap(points, samples, _samples(cfg.refine_radius, step), cfg.refine_ratio, drop, cfg.refine_nearest, separation)
    return moved.select("target", F.explode("indexes").alias("i")).join(samples.select("target", "i", F.col("depth").alias("boundary")), ["target", "i"])


def diagnostics(df: DataFrame, cfg: Detection, step: float = 0.02, places: DataFrame | None = None, density: DataFrame | None = None, point: str | None = None) -> DataFrame:
    """A row a profile: profile_statistics() of the feature, the adaptive prior, the signal-to-noise ratio and what follows from
    it, the smoothing, and mean and largest density of the points around, if given (target, depth, density)."""
    x = cfg.feature
    own = df.withColumn("target", F.col("target").cast("string"))
    located = places.withColumn("target", F.col("target").cast("string")) if places is not None else None
    rows = _rows(df, x)
    out = stats.profile_statistics(own, [x], located, point)
    prior = _prior(rows, cfg).select("target", F.col("thickness").alias("adaptive_thickness_m"), F.col("kappa").alias("adaptive_kappa_samples"), F.col("n_strong").alias("n_strong_peaks"))
    noise = _noise(rows, step).select("target", F.col("snr").alias("auto_snr"), F.col("local_noise").alias("auto_local_noise"), F.col("drop_quantile").alias("auto_drop_quantile"), "contrast_strength")
    out = out.join(prior, "target").join(noise, "target")
    rough = F.col(f"profile_{x}_roughness")
    share = hazards.clip((rough - detect.SMOOTH_FROM) / (detect.SMOOTH_FULL - detect.SMOOTH_FROM), 0.0, 1.0)
    low, high = detect.WEIGHTS
    smoothed = F.lit(cfg.smooth is not None) & F.coalesce(rough >= detect.SMOOTH_FROM, F.lit(False))
    out = out.withColumns({"smooth_applied": smoothed.cast("int"), "smooth_lambda": F.when(smoothed, low + share * (high - low)).otherwise(0.0)})
    if density is not None:
        around = density.groupBy(F.col("target").cast("string").alias("target")).agg(F.avg("density").alias("spatial_density_mean"), F.max("density").alias("spatial_density_max"))
        out = out.join(around, "target", "left")
    return out


#: Statistics of diagnostics() whose correlation with a score is of interest, {x} being the feature.
CANDIDATES = ("profile_{x}_iqr", "profile_{x}_roughness", "profile_{x}_abs_grad_mean", "profile_{x}_abs_grad_q75", "profile_{x}_std", "profile_{x}_range", "profile_{x}_cv", "profile_depth_span_m", "profile_n_samples", "adaptive_thickness_m", "adaptive_kappa_samples", "n_strong_peaks", "auto_snr", "auto_local_noise", "auto_drop_quantile", "contrast_strength", "smooth_applied", "smooth_lambda")


def detection_tables(df: DataFrame, points: DataFrame, truth: DataFrame, cfg: Detection, step: float = 0.02, places: DataFrame | None = None, tolerances: tuple[float, ...] = evaluate.TOLERANCES, main: float = 1.0) -> dict[str, DataFrame]:
    """The tables of a detection run: boundaries, evaluation by profile, summary, diagnostics, and both joined with findings."""
    text = lambda d: d.withColumn("target", F.col("target").cast("string"))
    scores = evaluate.boundary_scores(text(points), text(truth), tolerances)
    known = diagnostics(df, cfg, step, places)
    t, x = evaluate.name_of(main), cfg.feature
    joined = stats.with_diagnostics(scores, known)
    c = F.col
    found = stats.diagnosis(c("n_pred"), c("n_true"), c(f"precision_{t}"), c(f"recall_{t}"), c(f"f1_{t}"), c(f"profile_{x}_iqr"), c(f"profile_{x}_roughness"), c("auto_snr"), c("adaptive_thickness_m"), c("profile_depth_span_m"))
    return {"boundaries": text(points).select("target", "boundary"), "evaluation": scores, "summary": evaluate.pooled_scores(scores, tolerances), "diagnostics": known, "analysis": joined.withColumn("findings", found)}


def boundaries_of(cfg: Clustering, strata: DataFrame, estimate: DataFrame | None = None, recall: DataFrame | None = None) -> DataFrame:
    """(target, boundary) by the run's source: tops of the reference but the first, exported change points, or the table of
    perfect recall."""
    cfg.check()
    if cfg.source == "ground_truth":
        return clean.internal_tops(strata).select("target", F.explode("boundaries").alias("boundary"))
    given = estimate if cfg.source == "bocpd_estimate" else recall
    if given is None:
        raise ValueError(f"boundary source {cfg.source} needs a table of boundaries")
    return given.select("target", "boundary")


def segment_features(rows: DataFrame, cfg: Clustering, df: DataFrame | None = None, segs: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Features of assigned samples by the representation, and the names of the matrix's columns in order. Only stft reads the
    whole profiles (df) and the segments."""
    sensors, kind = list(cfg.sensors), cfg.check().representation
    keys = list(feat.KEYS)
    own = rows.groupBy(*keys).agg(*feat.meta())
    values: list[str] = []
    if kind == "summary":
        out = feat.summary(rows, sensors, cfg.stats)
    elif kind == "hybrid":
        out = feat.hybrid(rows, sensors, cfg.length, *cfg.columns)
    elif kind in ("resample", "paa"):
        if kind == "paa":
            long, arrays = feat.paa(rows, sensors, cfg.length), {"paa": "paa", "paa_d": "paa_d"}
        else:
            long, arrays = feat.shapes(rows, sensors, cfg.length).withColumn("d", feat.derivative(F.col("shape"), cfg.length)), {"shape": "r", "d": "d"}
        if not cfg.derivatives:
            arrays = dict(list(arrays.items())[:1])
        out = own.join(feat.widen(long, arrays, sensors, cfg.length), keys)
    elif kind == "fft":
        s = cfg.spectral
        low, high, step = s.get("min_frequency_cycles_per_m", spectral.LOW), s.get("max_frequency_cycles_per_m", spectral.HIGH), s.get("depth_step_m", spectral.STEP)
        spectra = spectral.segment_spectra(rows.withColumn("segment_id", F.col("segment_id").cast("int")), sensors, step)
        bands = spectral.band_features(spectra, low, high, tuple(tuple(b) for b in s.get("bands_cycles_per_m", spectral.BANDS)))
        values = [c for c in bands.columns if c not in (*keys, "sensor")]
        out = own.join(feat.pivot_sensors(bands, values, sensors, prefix="fft_"), keys, "left")
    else:
        if df is None or segs is None:
            raise ValueError("stft needs the profiles and the segments")
        s = cfg.spectral
        grid = [s.get("min_frequency_cycles_per_m", 0.25), s.get("max_frequency_cycles_per_m", 5.0), s.get("frequency_step_cycles_per_m", 0.25)]
        spectra = spectral.spectrograms(df, sensors, s.get("depth_step_m", 0.05), s.get("window_m", 1.0), s.get("overlap_m", 0.5), *grid)
        places = spectral.frequency_grid(*grid).tolist()
        values = [feat.frequency_name(f) for f in places]
        out = own.join(feat.wide_power(spectral.segment_power(spectra, segs), sensors, places), keys, "left")
    names = feat.matrix_columns(kind, sensors, cfg.length, cfg.derivatives, cfg.stats, cfg.thickness, cfg.derived, *cfg.columns[2:], values)
    if kind != "hybrid" and cfg.derived:
        out = out.join(feat.engineered(rows, *cfg.columns).select(*keys, *[c for name in cfg.derived for c in feat.EXTRA.get(name, ())]), keys)
    if missing := [c for c in names if c not in out.columns]:
        raise ValueError(f"features lack columns of the matrix for {kind}: {', '.join(missing[:20])}")
    return out, names


@dataclass
class ClusteringRun:
    """The tables of a clustering run, and what is known of it."""

    segments: DataFrame
    features: DataFrame
    clustered_segments: DataFrame
    clustered_measurements: DataFrame
    metrics: DataFrame
    report: DataFrame
    columns: list[str]
    n_clusters: int
    bic: float | None


def run_clustering(df: DataFrame, strata: DataFrame, boundaries: DataFrame, cfg: Clustering, places: DataFrame | None = None) -> ClusteringRun:
    """Segments between the boundaries, their features, clusters, the clusters' names by the samples' units, and scores
    weighted by samples. df: target, depth, sensors; strata: target, top, bottom, unit, file_pos; boundaries: target,
    boundary."""
    keys = list(feat.KEYS)
    cuts = intervals.edges(df, boundaries).withColumn("edges", intervals.merge_thin(F.col("edges"), cfg.least_thickness))
    segs = tables.settled(intervals.segments(cuts))
    if segs.isEmpty():
        raise ValueError(f"no segments from boundary source {cfg.source}")
    rows = tables.settled(intervals.assign(df, segs))
    built, names = segment_features(rows, cfg, df, segs)
    table = tables.settled(built)
    scaled, kept = model.robust_scale(table, names)
    matrix = model.as_matrix(scaled, keys, kept)
    x = tables.settled(model.pca(matrix, cfg.components) if cfg.components else matrix)
    bic = None
    if cfg.smoothing is not None and cfg.algorithm != "gmm":
        raise ValueError("smoothing needs the probabilities of a mixture")
    if cfg.algorithm == "agglomerative":
        labels = model.agglomerate(x, keys, cfg.clusters[1])
    elif cfg.algorithm == "kmeans":
        centres = min((model.kmeans(x, k, cfg.seed) for k in range(cfg.clusters[0], cfg.clusters[1] + 1)), key=lambda f: f[1])[0]
        labels = model.predict(x, centres)
    else:
        fit = model.mixture(x, cfg.clusters[1], cfg.covariance, cfg.seed, cfg.ridge) if cfg.selection == "fixed" else model.select_by_bic(x, *cfg.clusters, cfg.covariance, cfg.seed, cfg.ridge)[0]
        bic = float(fit.bic)
        labels = model.predict(x, fit, probabilities=cfg.smoothing is not None)
        if cfg.smoothing is not None and places is not None:
            labels = model.smooth_near(labels.drop("cluster_id"), segs, places, cfg.radius, cfg.sigma, cfg.smoothing)
    labels = tables.settled(labels.select(*keys, "cluster_id"))
    measured = intervals.with_labels(intervals.asof_unit(rows, strata).withColumnRenamed("unit", "reference_unit"), labels)
    named = evaluate.name_clusters(measured.withColumnRenamed("reference_unit", "unit"))
    measured = measured.join(named, "cluster_id", "left").select(*df.columns, "segment_id", "seg_top", "seg_bottom", "cluster_id", "reference_unit", "predicted_unit")
    measured = tables.settled(measured)
    clustered = intervals.with_labels(intervals.dominant_unit(segs, strata), labels).join(named, "cluster_id", "left")
    clustered = clustered.select(*keys, "top", "bottom", "thickness", "cluster_id", F.col("unit").alias("reference_unit"), "predicted_unit")
    scored = measured.withColumnRenamed("reference_unit", "unit")
    report = evaluate.class_report(scored.filter("unit is not null and predicted_unit is not null")).drop("hit")
    n = labels.agg(F.count_distinct("cluster_id").alias("n")).first().n
    return ClusteringRun(segs, intervals.with_labels(table, labels), clustered, measured, evaluate.cluster_metrics(scored), report, names, n, bic)


def cluster_segments(df: DataFrame, strata: DataFrame, boundaries: DataFrame, cfg: Clustering, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments with cluster_id, unit and predicted_unit, and one row of metrics, weighted by samples: run_clustering() in short."""
    done = run_clustering(df, strata, boundaries, cfg, places)
    return done.clustered_segments.withColumnRenamed("reference_unit", "unit"), done.metrics


#: The names of a run's tables.
RUN_TABLES = {"segments": "segments", "segment_features": "features", "clustered_segments": "clustered_segments", "clustered_measurements": "clustered_measurements", "report": "report", "metrics": "metrics"}


def save_clustering(done: ClusteringRun, cfg: Clustering, root: str, kind: str = "parquet", source: str = "", started: float | None = None) -> str:
    """Write a run's tables under root/runs/model/run, its summary and settings as one JSON row beside them, and a row of the run
    table root/run_table, from which runs.best() and runs.latest() tell. The name of the run."""
    spark = done.segments.sparkSession
    metrics = done.metrics.first().asDict()
    began = started or time.time()
    name = runs.record(spark, f"{root}/run_table", cfg.model_id, asdict(cfg) | {"input": source}, metrics, cfg.source, began)
    folder = f"{root}/runs/{cfg.model_id}/{name}"
    for table, attribute in RUN_TABLES.items():
        tables.write(getattr(done, attribute), f"{folder}/{table}", kind)
    names = {str(r.cluster_id): r.predicted_unit for r in done.clustered_segments.select("cluster_id", "predicted_unit").distinct().collect()}
    summary = {"model_id": cfg.model_id, "run": name, "boundary_source": cfg.source, "n_segments": done.segments.count(), "n_measurements": done.clustered_measurements.count(), "n_clusters": done.n_clusters, "bic": done.bic, "feature_matrix_columns_count": len(done.columns), "evaluation_level": "measurement", "cluster_map": names, "metrics": metrics, "config": asdict(cfg)}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return name
