"""Hazards as columns: a profile's spec is a base hazard h and factors for each sample, and a least run length.

The effective hazard of run length r at a sample is 0 for r below the least, else h * factors, clipped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import settled
from .clean import by_depth, gradient_uniform, smoothed, step_of, with_quantile

LARGEST = 1.0 - 1e-12


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, lit(low)), lit(high))


def constant(kappa: Column) -> Column:
    return 1.0 / F.greatest(kappa.cast("double"), F.lit(1.0))


def depth_aware(depth: Column, step: Column, kappa0: float = 1.0, growth: float = 0.05, least: float = 0.5) -> Column:
    """Expected thickness grows with depth."""
    return clip(step / F.greatest(F.lit(least), kappa0 + growth * depth), 1e-12, LARGEST)


def least_run(thickness: float, step: Column) -> Column:
    """Samples of a least thickness, half to even."""
    return F.rint(F.lit(thickness) / step).cast("int")


def rate_factor(signal: str, strength: float | Column) -> Column:
    """clip(1 + strength * (signal / mean - 1)) divided by its own mean over the profile: the rate stays."""
    whole = Window.partitionBy("target")
    return clip(1.0 + strength * (F.col(signal) / F.greatest(F.avg(signal).over(whole), F.lit(1e-12)) - 1.0), 1e-3, 100.0)


def with_rate_factor(df: DataFrame, signal: str, strength: float | Column, name: str) -> DataFrame:
    whole = Window.partitionBy("target")
    raw = df.withColumn("_raw", rate_factor(signal, strength))
    mean = F.avg("_raw").over(whole)
    return raw.withColumn(name, F.when(mean > 0, F.col("_raw") / mean).otherwise(1.0)).drop("_raw")


def effective(h: Column, r: Column, least: Column, *factors: Column) -> Column:
    out = clip(h, 0.0, LARGEST)
    for f in factors:
        out = clip(out * f, 0.0, LARGEST)
    return F.when(r < least, 0.0).otherwise(out)


def lr_contrast(df: DataFrame, x: str, half: int, name: str = "contrast") -> DataFrame:
    """|mean of the `half` samples before - after| over the deviation of both and the sample; 0 near the ends."""
    w = by_depth()
    left, right, both = w.rowsBetween(-half, -1), w.rowsBetween(1, half), w.rowsBetween(-half, half)
    enough = max(2, half // 2)
    value = F.abs(F.avg(x).over(left) - F.avg(x).over(right)) / (F.stddev_pop(x).over(both) + 1e-9)
    return df.withColumn(name, F.when((F.count(x).over(left) >= enough) & (F.count(x).over(right) >= enough), value).otherwise(0.0))


def local_noise(df: DataFrame, x: str, half: int) -> DataFrame:
    """(target, local_noise): median of the deviations of strided windows of 2 * half + 1 samples."""
    stride = max(1, half // 2)
    around = by_depth().rowsBetween(-half, half)
    rows = df.withColumn("_i", F.row_number().over(by_depth()) - 1)
    rows = rows.withColumn("_s", F.when(F.count(x).over(around) >= 3, F.stddev_pop(x).over(around)))
    local = F.percentile(F.when((F.col("_i") % stride == 0), F.col("_s")), F.lit(0.5))
    few = F.when(F.count(x) > 1, F.stddev_pop(x)).otherwise(1e-4)
    return rows.groupBy("target").agg(F.when(F.count(x) < 4, few).otherwise(F.coalesce(local, F.stddev_pop(x))).alias("local_noise"))


def contrast_parameters(iqr: Column, noise: Column, threshold: float = 2.5) -> dict[str, Column]:
    """Signal-to-noise ratio, whether contrast is used, its strength and the quantile below which gradients are dropped."""
    snr = F.greatest(iqr, F.lit(1e-4)) / F.greatest(noise, F.lit(1e-4))
    used = snr >= threshold
    strength = clip(0.30 + 0.09 * F.greatest(F.lit(0.0), snr - threshold), 0.10, 1.20)
    drop = F.when(snr >= 5.0, 0.12).when(snr >= 3.5, 0.09).when(snr >= 2.5, 0.06).otherwise(0.03)
    return {"snr": snr, "use_contrast": used, "contrast_strength": F.when(used, strength).otherwise(0.0), "drop_quantile": drop}


#: Fixed values of the blend: base thickness, its bounds, the quantile of strong peaks and the three weights.
KAPPA = {"base": 0.6, "least": 0.5, "most": 2.5, "quantile": 0.8, "weights": (0.5, 0.35, 0.15)}


def kappa_inputs(df: DataFrame, x: str, quantile: float = KAPPA["quantile"], smooth: int = 0) -> DataFrame:
    """(target, step, n, iqr, g75, spacing, n_strong): what a profile's thickness prior is blended of, by its signal smoothed over
    at most so many samples (odd, an even number counts as one less)."""
    w = by_depth()
    rows = smoothed(df, x, smooth - 1 + smooth % 2).join(step_of(df), "target").withColumn("_g", F.abs(gradient_uniform(x, F.col("step"))))
    rows = with_quantile(rows, "_g", quantile, "_q").withColumns({"_b": F.lag("_g").over(w), "_a": F.lead("_g").over(w)})
    strong = (F.col("_g") > F.col("_b")) & (F.col("_g") >= F.col("_a")) & (F.col("_g") >= F.col("_q"))
    # the depth of the strong peak before, without a second pass over the samples
    before = F.last(F.when(strong, F.col("depth")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_d", F.when(strong, F.col("depth") - before)).withColumn("_s", strong)
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.groupBy("target").agg(F.first("step").alias("step"), F.count("*").alias("n"), (F.get(quartiles, F.lit(1)) - F.get(quartiles, F.lit(0))).alias("iqr"), F.percentile("_g", F.lit(0.75)).alias("g75"), F.percentile("_d", F.lit(0.5)).alias("spacing"), F.count_if("_s").alias("n_strong"))
    return out


def blended(floor: float = 0.0, base: float = KAPPA["base"], least: float = KAPPA["least"], most: float = KAPPA["most"]) -> dict[str, Column]:
    """thickness, peak_spacing and variation_scale of the columns of kappa_inputs()."""
    low = F.greatest(F.lit(float(floor)), F.lit(float(least)), F.col("step"))
    high = F.greatest(low, F.lit(float(most)))
    spacing = clip(F.coalesce("spacing", F.lit(float(base))), low, high)
    scale = clip(F.when(F.col("g75") > 0, F.col("iqr") / F.col("g75")).otherwise(float(base)), low, high)
    a, b, c = KAPPA["weights"]
    few, short = F.col("n") < 3, F.lit(float(max(floor, base)))
    whole = clip(a * base + b * spacing + c * scale, low, high)
    return {name: F.when(few, short).otherwise(v) for name, v in (("thickness", whole), ("peak_spacing", spacing), ("variation_scale", scale))}


def adaptive_kappa(df: DataFrame, x: str, floor: float = 0.0, base: float = KAPPA["base"], least: float = KAPPA["least"], most: float = KAPPA["most"], quantile: float = KAPPA["quantile"], smooth: int = 0) -> DataFrame:
    """(target, thickness, kappa, peak_spacing, variation_scale, n_strong): a thickness prior of each profile, blended of a
    base, the spacing of strong gradient peaks and IQR over the upper quartile of the gradient."""
    parts = blended(floor, base, least, most)
    rows = kappa_inputs(df, x, quantile, smooth).withColumns(parts)
    strong = F.when(F.col("n") < 3, 0).otherwise(F.col("n_strong")).cast("long").alias("n_strong")
    return rows.select("target", "thickness", (F.col("thickness") / F.col("step")).alias("kappa"), "peak_spacing", "variation_scale", strong)


def nearest(targets: DataFrame, k: int) -> DataFrame:
    """(target, other, d): the k nearest other targets by (x, y), ties by target; those without coordinates take no part.

    Targets meet those of their own and the eight cells around. Where the kth found is no farther than one width of a cell,
    no nearer one can lie outside; the other targets try again with cells twice as wide, until the cells hold all. The first
    cells are narrow, so that crowded places are settled before the cells grow.
    """
    located = settled(targets.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("target", "x", "y"))
    s = located.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((F.min, 0), (F.max, 1))]).first()
    spans = [(s.x1 or 0) - (s.x0 or 0), (s.y1 or 0) - (s.y0 or 0)]
    width = (math.sqrt(spans[0] * spans[1] * 2 * k / max(s.n, 1)) or max(spans) * 2 * k / max(s.n, 1) or 1.0) / 2
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    other = located.select(F.col("target").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")).alias("d")
    place = F.row_number().over(Window.partitionBy("target").orderBy("d", "other"))
    out, rest = None, located
    while True:
        at = [(F.floor(F.col(c) / width)) for c in ("x", "y", "x2", "y2")]
        asking = rest.withColumns({"cx": at[0], "cy": at[1]}).withColumn("o", around).select("target", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        pairs = asking.join(other.withColumns({"cx": at[2], "cy": at[3]}), ["cx", "cy"]).filter("target <> other")
        best = settled(pairs.select("target", "other", d).withColumn("_r", place).filter(F.col("_r") <= k))
        whole = width > max(spans)
        done = best if whole else best.join(best.filter((F.col("_r") == k) & (F.col("d") <= width)).select("target"), "target", "left_semi")
        out = done if out is None else out.unionByName(done)
        rest = settled(rest.join(done.select("target").distinct(), "target", "left_anti"))
        if whole or rest.isEmpty():
            return out.drop("_r")
        width *= 2


#: Bandwidths from a point beyond which its kernel isn't added: less than 1e-14 of its height is left there.
REACH = 8


def neighbour_density(targets: DataFrame, points: DataFrame, grid: DataFrame, k: int = 6, bandwidth: float = 1.5) -> DataFrame:
    """(target, depth, density): Gaussian kernels at the change points (target, boundary) of the k nearest other targets,
    weighted by 1 / (distance + 1) over the k chosen. targets: (target, x, y). Samples meet the points in their cell of depth and
    those beside it, not all of the neighbours'."""
    total = F.sum(1 / (F.col("d") + 1)).over(Window.partitionBy("target"))
    weighed = nearest(targets, k).withColumn("weight", (1 / (F.col("d") + 1)) / total).select("target", "other", "weight")
    marks = weighed.join(points.select(F.col("target").alias("other"), "boundary"), "other").select("target", "weight", "boundary")
    width = REACH * bandwidth
    marks = marks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("boundary") / width) - 1, F.floor(F.col("boundary") / width) + 1)))
    z = (F.col("depth") - F.col("boundary")) / bandwidth
    kernel = F.when(F.abs(z) <= REACH, F.col("weight") * F.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * bandwidth))
    rows = grid.select("target", "depth", F.floor(F.col("depth") / width).alias("cell")).join(marks, ["target", "cell"], "left")
    return rows.groupBy("target", "depth").agg(F.coalesce(F.sum(kernel), F.lit(0.0)).alias("density"))
