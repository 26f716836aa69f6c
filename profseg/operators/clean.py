"""Cleaning and alignment of profiles: frames with a target, a depth and sensor columns."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_STEP = 0.02


def by_depth(*more: str) -> Window:
    return Window.partitionBy("target").orderBy("depth", *more)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many partitions as the session shuffles to, or has cores for. What follows costs time and
    not bytes, so that partitions must not be joined by their small size: an explicit number isn't."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def collapse(df: DataFrame, step: float, sensors: list[str]) -> DataFrame:
    """Overlapping pushes on one grid: mean of each sensor by rounded depth (half to even)."""
    grid = (F.rint(F.col("depth") / step) * step).alias("depth")
    return df.groupBy("target", grid).agg(*[F.avg(s).alias(s) for s in sensors])


def mean_of_duplicates(df: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """One row for each exact depth of a group."""
    return df.groupBy(*keys, "depth").agg(*[F.avg(s).alias(s) for s in sensors])


def fill_by_index(df: DataFrame, sensor: str) -> DataFrame:
    """Missing values interpolated linearly by place in the profile; ends held; a profile without values is 0."""
    numbered = df.withColumn("_i", F.row_number().over(by_depth()))
    seen = F.when(F.col(sensor).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(sensor).alias("v")))
    back = by_depth().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_depth().rowsBetween(0, Window.unboundedFollowing)
    both = numbered.withColumn("_p", F.last(seen, ignorenulls=True).over(back)).withColumn("_n", F.first(seen, ignorenulls=True).over(ahead))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
    filled = F.coalesce(F.col(sensor), line, p["v"], n["v"], F.lit(0.0))
    return both.withColumn(sensor, filled).drop("_i", "_p", "_n")


def standardise(df: DataFrame, sensors: list[str]) -> DataFrame:
    """(value - mean) / (population deviation + 1e-9) in each profile."""
    whole = Window.partitionBy("target")
    z = lambda s: (F.col(s) - F.avg(s).over(whole)) / (F.stddev_pop(s).over(whole) + 1e-9)
    return df.withColumns({s: z(s) for s in sensors})


def step_of(df: DataFrame) -> DataFrame:
    """(target, step): median difference of neighbouring depths, DEFAULT_STEP where there is none."""
    gaps = df.select("target", (F.col("depth") - F.lag("depth").over(by_depth())).alias("gap"))
    return gaps.groupBy("target").agg(F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(DEFAULT_STEP)).alias("step"))


def between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share with the first product not rounded by itself (its error and that of the sum are added), as SQL
    engines with a fused multiply-add have it: a threshold between two values that differ in their last place falls alike."""
    rest = 1 - share
    halves = lambda v: (v * 134217729.0 - (v * 134217729.0 - v), v - (v * 134217729.0 - (v * 134217729.0 - v)))
    (a, b), (c, d) = halves(low), halves(rest)
    p, q = low * rest, high * share
    lost = ((a * c - p) + a * d + b * c) + b * d
    total = p + q
    part = total - p
    return F.when(low == high, low).otherwise(total + (((p - (total - part)) + (q - part)) + lost))


def with_quantile(df: DataFrame, x: str, q: float, name: str) -> DataFrame:
    """Rows with that quantile of `x` in their profile, between() the two values around it by rank."""
    whole = Window.partitionBy("target")
    ranked = df.withColumns({"_r": F.row_number().over(whole.orderBy(F.col(x).asc_nulls_last())) - 1, "_at": F.lit(q) * (F.count(x).over(whole) - 1)})
    of_rank = lambda rank: F.max(F.when(F.col("_r") == rank, F.col(x))).over(whole)
    ends = ranked.withColumns({"_l": of_rank(F.floor("_at")), "_h": of_rank(F.ceil("_at"))})
    return ends.withColumn(name, between(F.col("_l"), F.col("_h"), F.col("_at") - F.floor("_at"))).drop("_r", "_at", "_l", "_h")


def surface_tops(strata: DataFrame, include_bottom: bool = False) -> DataFrame:
    """(target, boundaries): sorted distinct tops below the surface; with the deepest bottom, if asked for."""
    tops = F.array_sort(F.collect_set(F.when(F.col("top") > 0, F.col("top"))))
    out = F.array_sort(F.array_distinct(F.array_append(tops, F.max("bottom")))) if include_bottom else tops
    return strata.groupBy("target").agg(out.alias("boundaries"))


def internal_tops(strata: DataFrame) -> DataFrame:
    """(target, boundaries): sorted distinct tops but the first."""
    tops = F.array_sort(F.collect_set("top"))
    return strata.groupBy("target").agg(F.when(F.size(tops) > 0, F.slice(tops, 2, F.greatest(F.size(tops) - 1, F.lit(0)))).otherwise(tops).alias("boundaries"))


def depths_at(df: DataFrame, indexes: DataFrame) -> DataFrame:
    """(target, index, depth) of sample indexes (from 0) of profiles."""
    numbered = df.select("target", "depth", (F.row_number().over(by_depth()) - 1).alias("index"))
    return indexes.join(numbered, ["target", "index"])


@cache
def moving_polynomial(size: int, degree: int = 3) -> np.ndarray:
    """Weights of a window's samples in the value that its least-squares polynomial has at each of its places: in fractions, each
    rounded once, so that sums over few-digit samples tie where they should."""
    basis: list[list[int]] = []
    for power in range(min(degree, size - 1) + 1):
        v = [Fraction(i - size // 2) ** power for i in range(size)]
        for b in basis:
            share = sum(a * c for a, c in zip(v, b, strict=True)) / sum(c * c for c in b)
            v = [a - share * c for a, c in zip(v, b, strict=True)]
        whole = math.lcm(*[a.denominator for a in v])
        basis.append([int(a * whole) for a in v])
    norms = [sum(c * c for c in b) for b in basis]
    below = math.lcm(*norms)
    parts = [(b, below // n) for b, n in zip(basis, norms, strict=True)]
    return np.array([[sum(b[at] * b[i] * times for b, times in parts) / below for i in range(size)] for at in range(size)])


def _weights(spark: SparkSession, window: int) -> DataFrame:
    """(_size, _place, _own): moving_polynomial() of all odd windows up to `window`. A table, since so many literals would burden each
    plan."""
    rows = [(size, place, own) for size in range(3, window + 1, 2) for place, own in enumerate(moving_polynomial(size).tolist())]
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({c: pa.array(v, kind) for c, v, kind in zip(("_size", "_place", "_own"), zip(*rows, strict=True), kinds, strict=True)}))


def smoothed(df: DataFrame, x: str, window: int, name: str | None = None) -> DataFrame:
    """`x` by a moving cubic over `window` samples (odd; an even one counts as one more); the ends follow the polynomial of the first
    and the last window. A profile shorter than that has the largest odd window that fits; below three nothing is smoothed. `x` has
    no NULLs."""
    name = name or x
    if window < 3:
        return df.withColumn(name, F.col(x))
    window += 1 - window % 2
    rows = df.withColumns({"_w": F.collect_list(x).over(by_depth().rowsBetween(1 - window, window - 1)), "_i": F.row_number().over(by_depth()) - 1, "_n": F.count("*").over(Window.partitionBy("target"))})
    size = F.least(F.lit(window), F.col("_n") - 1 + F.col("_n") % 2).cast("int")
    half = F.shiftright("_size", 1)
    place = F.when(F.col("_i") < half, F.col("_i")).when(F.col("_i") >= F.col("_n") - half, F.col("_size") - F.col("_n") + F.col("_i")).otherwise(half).cast("int")
    rows = rows.withColumn("_size", size).withColumn("_place", place)
    rows = rows.join(F.broadcast(_weights(df.sparkSession, window)), ["_size", "_place"], "left")
    first = F.col("_i") - F.col("_place") - F.greatest(F.lit(0), F.col("_i") - (window - 1))
    near = F.slice("_w", (first + 1).cast("int"), F.greatest(F.col("_size"), F.lit(1)))
    total = F.aggregate(F.zip_with(near, F.col("_own"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = F.when(F.col("_size") >= 3, total).otherwise(F.col(x)).alias(name)
    return rows.select(*[value if c == name else F.col(c) for c in df.columns], *[value] * (name not in df.columns))


def gradient_uniform(x: str, step: Column, order: Window | None = None) -> Column:
    """Central differences on a grid of one step, one-sided at the ends; NULL in a profile of one sample."""
    w = order if order is not None else by_depth()
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    inner = (after - before) / (2 * step)
    return F.coalesce(inner, (after - F.col(x)) / step, (F.col(x) - before) / step)


def gradient_depth(x: str, order: Window | None = None) -> Column:
    """Second-order differences on the true depths, one-sided at the ends."""
    w = order if order is not None else by_depth()
    x0, x1, x2 = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    h1 = F.col("depth") - F.lag("depth").over(w)
    h2 = F.lead("depth").over(w) - F.col("depth")
    inner = (h1 * h1 * x2 - h2 * h2 * x0 + (h2 * h2 - h1 * h1) * x1) / (h1 * h2 * (h1 + h2))
    return F.coalesce(inner, (x2 - x1) / h2, (x1 - x0) / h1)
