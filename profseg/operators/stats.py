"""Descriptive statistics and diagnostics of profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import settled
from .clean import by_depth, fill_by_index, gradient_uniform, step_of
from .refine import linear_quantile

QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def series_stats(df: DataFrame, sensor: str, keys: list[str] | None = None) -> DataFrame:
    """Counts, moments and quantiles of a sensor by profile, and its roughness. Constant series have skew 0, kurtosis -3.
    One pass: the values of a profile are sorted once for all quantiles."""
    keys = keys or ["target"]
    x = F.col(sensor)
    centred = df.select(*keys, "depth", sensor).withColumn("_d", x - F.lag(x).over(Window.partitionBy(*keys).orderBy("depth")))
    out = centred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(x).alias("n_finite"),
        (F.count("*") - F.count(x)).alias("n_nonfinite"),
        (F.count(x) / F.count("*")).alias("finite_frac"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("var_pop"),
        F.stddev_pop(x).alias("std_pop"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.when(F.count(x) > 0, F.coalesce(F.skewness(x), F.lit(0.0))).alias("skew"),
        F.when(F.count(x) > 0, F.coalesce(F.kurtosis(x), F.lit(-3.0))).alias("kurtosis"),
        F.stddev_pop("_d").alias("roughness"),
        F.array_sort(F.collect_list(x.cast("double"))).alias("_x"),
    )
    out = out.withColumns({name: linear_quantile(F.col("_x"), F.lit(q)) for name, q in QUANTILES.items()})
    out = out.withColumn("mad", linear_quantile(F.array_sort(F.transform("_x", lambda v: F.abs(v - F.col("median")))), F.lit(0.5)))
    return out.drop("_x").withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q75") - F.col("q25"), "cv": F.try_divide("std_pop", F.abs("mean"))})


def gradient_stats(df: DataFrame, sensor: str) -> DataFrame:
    """Per profile: mean, deviation and upper quantiles of |gradient| on the profile's step, and the deviation of neighbours'
    differences (roughness), with missing samples interpolated by place. NULL for fewer than two samples or without values."""
    filled = fill_by_index(df.select("target", "depth", sensor), sensor).join(step_of(df), "target")
    some = F.count(F.when(F.col(sensor).isNotNull(), 1))
    there = df.groupBy("target").agg((some > 0).alias("_some"))
    rows = filled.withColumns({"_g": F.abs(gradient_uniform(sensor, F.col("step"))), "_d": F.col(sensor) - F.lag(sensor).over(by_depth())})
    out = rows.groupBy("target").agg(F.avg("_g").alias("abs_grad_mean"), F.stddev_pop("_g").alias("abs_grad_std"), F.percentile("_g", F.lit(0.75)).alias("abs_grad_q75"), F.percentile("_g", F.lit(0.95)).alias("abs_grad_q95"), F.stddev_pop("_d").alias("roughness"))
    names = [c for c in out.columns if c != "target"]
    return out.join(there, "target").select("target", *[F.when(F.col("_some"), F.col(c)).alias(c) for c in names])


#: Names of series_stats() in a profile's row.
SERIES = {"n": "n", "n_finite": "n_finite", "n_nonfinite": "n_nonfinite", "finite_frac": "finite_frac", "mean": "mean", "var_pop": "var", "std_pop": "std", "min": "min", "q05": "q05", "q25": "q25", "median": "median", "q75": "q75", "q95": "q95", "max": "max", "range": "range", "iqr": "iqr", "mad": "mad", "cv": "cv", "skew": "skew", "kurtosis": "kurtosis_excess"}


def profile_statistics(df: DataFrame, sensors: list[str], places: DataFrame | None = None, point: str | None = None) -> DataFrame:
    """A row a profile: samples, points, extent and sampling, coordinates, and the statistics of every sensor in order of
    name. df: target, depth, sensors and, if given, the column `point`; places: target, x, y, z, bathymetry, as far as
    there."""
    own = profile_stats(df).join(step_of(df), "target")
    names = {"n": "n_samples", "depth_min": "depth_min_m", "depth_max": "depth_max_m", "depth_span": "depth_span_m", "step": "step_m", "step_mean": "step_mean_m", "step_std": "step_std_m", "step_min": "step_min_m", "step_max": "step_max_m"}
    out = own.select("target", *[F.col(a).alias(f"profile_{b}") for a, b in names.items()])
    if point:
        out = out.join(df.groupBy("target").agg(F.count_distinct(point).alias("profile_n_point_ids")), "target")
    if places is not None:
        there = [c for c in ("x", "y", "z", "bathymetry") if c in places.columns]
        out = out.join(places.select("target", *[F.col(c).cast("double").alias(f"profile_{c}") for c in there]), "target", "left")
    for s in sorted(sensors):
        series = series_stats(df, s).select("target", *[F.col(a).alias(f"profile_{s}_{b}") for a, b in SERIES.items()])
        steep = gradient_stats(df, s)
        out = out.join(series, "target").join(steep.select("target", *[F.col(c).alias(f"profile_{s}_{c}") for c in steep.columns if c != "target"]), "target")
    return out


def profile_stats(df: DataFrame) -> DataFrame:
    """Extent and sampling of profiles."""
    gap = F.col("depth") - F.lag("depth").over(by_depth())
    return (
        df.withColumn("_g", gap)
        .groupBy("target")
        .agg(F.count("*").alias("n"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), (F.max("depth") - F.min("depth")).alias("depth_span"), F.avg("_g").alias("step_mean"), F.stddev_pop("_g").alias("step_std"), F.min("_g").alias("step_min"), F.max("_g").alias("step_max"))
    )


def average_rank(x: str, keys: list[str] | None = None) -> Column:
    """Rank of a value with ties at their mean; NULLs have none. Without keys the ranking is global, which one task does:
    meant for tables of profiles, not of samples."""
    part = Window.partitionBy(*(keys or []), F.col(x).isNull())
    ties = F.count("*").over(Window.partitionBy(*(keys or []), x))
    return F.when(F.col(x).isNotNull(), F.rank().over(part.orderBy(x)) + (ties - 1) / 2)


def correlations(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Pearson r of column pairs by group over rows with both; 0 for fewer than two or no variation."""
    out = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        out.append(F.when((F.count(x) >= 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).otherwise(0.0).alias(f"r_{a}_{b}"))
    return df.groupBy(*keys).agg(*out)


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Spearman's rho by group; NULL unless both have three distinct values."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumn("_a", average_rank(a, keys)).withColumn("_b", average_rank(b, keys))
    rho = F.when((F.count_distinct(a) >= 3) & (F.count_distinct(b) >= 3), F.corr("_a", "_b"))
    return ranked.groupBy(*keys).agg(rho.alias("rho"), F.count("*").alias("n"))


def score_buckets(df: DataFrame, score: str) -> DataFrame:
    """How many profiles score below .60, to .80 and above, with median, mean and sample deviation."""
    x = F.col(score)
    return df.agg(F.count_if(x < 0.6).alias("low"), F.count_if((x >= 0.6) & (x < 0.8)).alias("middle"), F.count_if(x >= 0.8).alias("high"), F.percentile(score, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def top(df: DataFrame, score: str, n: int, best: bool = True) -> DataFrame:
    """The n best (or worst) profiles; ties by target."""
    return df.orderBy(F.desc(score) if best else F.asc(score), "target").limit(n)


def change_counts(df: DataFrame, before: str, after: str, tolerance: float = 1e-9) -> DataFrame:
    d = F.col(after) - F.col(before)
    return df.agg(F.count_if(d > tolerance).alias("improved"), F.count_if(F.abs(d) <= tolerance).alias("same"), F.count_if(d < -tolerance).alias("worse"))


def largest_changes(df: DataFrame, before: str, after: str, n: int = 5) -> DataFrame:
    """(kind, rank, target, before, after, change): the n largest gains and the n largest losses, ties by target; changes of 0 are
    neither."""
    rows = df.select("target", F.col(before).alias("before"), F.col(after).alias("after"), (F.col(after) - F.col(before)).alias("change")).filter("change <> 0")
    parts = []
    for kind, order in (("gain", F.desc("change")), ("loss", F.asc("change"))):
        own = rows.filter("change > 0" if kind == "gain" else "change < 0").orderBy(order, "target").limit(n)
        parts.append(own.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "target")).alias("rank"), "target", "before", "after", "change"))
    return parts[0].unionByName(parts[1])


def diagnosis(n_pred: Column, n_true: Column, precision: Column, recall: Column, f1: Column, iqr: Column, roughness: Column, snr: Column, thickness: Column, span: Column) -> Column:
    """Findings about a profile's result, as texts. A NULL statistic has no finding.

    Fixed values: the limits of the rules.
    """
    ratio = n_pred / F.nullif(n_true, F.lit(0))
    over, under = F.coalesce(ratio > 1.5, F.lit(False)), F.coalesce(ratio < 0.55, F.lit(False))
    rules = [
        (over, "over-segmented: too many boundaries, precision suffers"),
        (under, "under-segmented: layers missed, recall suffers"),
        ((n_true == 0) & (n_pred > 2), "boundaries found where the reference has none"),
        ((precision < 0.45) & (recall > 0.65) & ~over, "many spurious boundaries"),
        ((recall < 0.45) & (precision > 0.65) & ~under, "many reference boundaries missed"),
        (iqr < 0.35, "little contrast in the signal"),
        (roughness > 0.09, "rough signal"),
        (snr < 2.5, "low signal-to-noise ratio: no contrast factor"),
        ((thickness > 3.0) & (recall < 0.55), "prior of thick layers: thin ones may be suppressed"),
        ((thickness <= 0.60) & (precision < 0.60), "prior at its floor: finer than the reference"),
        (span < 6.0, "short profile"),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]), lambda x: x.isNotNull())
    rest = F.when(f1 >= 0.75, F.array(F.lit("signal and model match well"))).otherwise(F.array(F.lit("no single cause stands out")))
    return F.when(F.size(found) == 0, rest).otherwise(found)


def spread_ranks(df: DataFrame, x: str, keys: list[str], name: str) -> DataFrame:
    """(keys, x, name): the average rank of each distinct value among its keys' rows, no key in one task: values are dealt by ranges, and
    what lies in the ranges before is a sum a range."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("_n"))
    dealt = settled(counts.repartitionByRange(ranges, *keys, x).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_in").over(earlier(Window.partitionBy(*keys).orderBy("_range"))), F.lit(0)).alias("_ranges"))
    inside = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy(*keys, "_range").orderBy(x))), F.lit(0))
    placed = dealt.withColumn("_inside", inside).join(F.broadcast(sums), [*keys, "_range"])
    return placed.select(*keys, x, (F.col("_ranges") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))


def score_correlations(df: DataFrame, score: str, columns: list[str], n: int = 10) -> DataFrame:
    """(column, rho, n): Spearman's rho of columns with a score over the profiles that have both; the n strongest. Columns
    with fewer than three distinct values have none."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(score).cast("double").alias("y"), F.explode(values).alias("v")).select("v.column", "v.x", "y")
    # enough distinct values of the column decide, whatever the score
    enough = long.filter("x is not null").groupBy("column", "x").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("_k")).filter("_k >= 3").select("column")
    rows = settled(long.join(F.broadcast(enough), "column", "left_semi").filter("x is not null and y is not null"))
    ranked = rows.join(spread_ranks(rows, "x", ["column"], "_a"), ["column", "x"]).join(spread_ranks(rows, "y", ["column"], "_b"), ["column", "y"])
    out = ranked.groupBy("column").agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n")).filter(F.col("rho").isNotNull() & ~F.isnan("rho"))
    return out.orderBy(F.desc(F.abs("rho")), "column").limit(n)


def prior_summary(df: DataFrame, kappa: str = "adaptive_kappa_samples", thickness: str = "adaptive_thickness_m") -> DataFrame:
    """One row: median, least and largest kappa of the profiles and their median thickness."""
    return df.agg(F.percentile(kappa, F.lit(0.5)).alias("kappa_median"), F.min(kappa).alias("kappa_min"), F.max(kappa).alias("kappa_max"), F.percentile(thickness, F.lit(0.5)).alias("thickness_median"))


def with_diagnostics(scores: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Scores of profiles with what else is known of them; columns that both have end in _diag on that side."""
    own = diagnostics.withColumnsRenamed({c: f"{c}_diag" for c in diagnostics.columns if c in scores.columns and c != "target"})
    return scores.join(own, "target", "left")


#: Columns of profile_statistics() that a comparison of methods repeats, without the sensor's prefix.
REPEATED = ("mean", "var", "std", "iqr", "mad", "roughness", "abs_grad_mean", "abs_grad_q75", "abs_grad_q95")


def compare_methods(methods: dict[str, DataFrame], diagnostics: DataFrame, sensor: str, tolerances: tuple[float, ...] = (0.5, 1.0, 2.0), main: float = 1.0) -> DataFrame:
    """A row for each target that all of `methods` (name to boundary_scores()) and the diagnostics have: counts, average layer
    thicknesses, scores of each method, and what each later method gains in F1 over each earlier one."""
    from .evaluate import name_of

    first = next(iter(methods))
    own = [c for c in ("adaptive_thickness_m", "adaptive_kappa_samples", "n_strong_peaks", "spatial_density_mean", "spatial_density_max") if c in diagnostics.columns]
    stats = [F.col(f"profile_{sensor}_{c}").alias(f"{sensor}_{c}") for c in REPEATED]
    out = diagnostics.select("target", F.col("profile_n_samples").alias("n_samples"), F.col("profile_depth_span_m").alias("depth_span_m"), F.col("profile_step_mean_m").alias("step_mean_m"), *stats, *own)
    layer = lambda n: F.col("depth_span_m") / (F.col(n) + 1)
    for name, scores in methods.items():
        f1 = [F.col(f"f1_{name_of(t)}").alias(f"{name}_f1_{name_of(t)}") for t in tolerances]
        true = [F.col("n_true").alias("true_boundaries")] if name == first else []
        out = out.join(scores.select("target", *true, F.col("n_pred").alias(f"{name}_boundaries"), *f1), "target").withColumn(f"{name}_layer_m", layer(f"{name}_boundaries"))
    out = out.withColumn("true_layer_m", layer("true_boundaries"))
    names, at = list(methods), name_of(main)
    gains = {f"{b}_over_{a}": F.col(f"{b}_f1_{at}") - F.col(f"{a}_f1_{at}") for i, a in enumerate(names) for b in names[i + 1 :]}
    return out.withColumns(gains)


def _poisson(draws: np.ndarray) -> np.ndarray:
    """Poisson numbers of mean 1 by inversion of uniform ones."""
    mass = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(mass, draws, side="right")


def bootstrap_mean(df: DataFrame, value: str, resamples: int = 5000, seed: int = 12) -> DataFrame:
    """Mean with a 95 % interval by resampling. A resample draws Poisson(1) copies of every row, from a stream of numbers that the
    row's place seeds. A task adds its rows to two sums a resample, which is all that leaves it: no row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(resamples), np.zeros(resamples, np.int64)
        for batch in batches:
            for key, v in zip(batch.column(1).to_numpy().tolist(), batch.column(0).to_numpy().tolist(), strict=True):
                copies = _poisson(np.random.Generator(np.random.Philox(key=[seed, key])).random(resamples))
                sums += copies * v
                counts += copies
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(sums), pa.array(counts)], ["resample", "s", "k"])

    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_row"))
    parts = rows.mapInArrow(run, "resample int, s double, k long")
    means = parts.groupBy("resample").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg("_v").alias("mean")).crossJoin(ends)
