"""Refinement of change points by the gradient of the signal, as joins of points with samples of the same target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import between, by_depth, gradient_uniform, smoothed, with_quantile


def with_gradient(df: DataFrame, x: str, step: Column, smooth: int = 0) -> DataFrame:
    """Samples with index i (from 0), g = |gradient| and whether they are a local peak of it; of the signal smoothed over so many
    samples."""
    rows = smoothed(df, x, smooth).select("target", "depth", (F.row_number().over(by_depth()) - 1).alias("i"), F.abs(gradient_uniform(x, step)).alias("g"))
    peak = (F.col("g") > F.lag("g").over(by_depth())) & (F.col("g") >= F.lead("g").over(by_depth()))
    return rows.withColumn("peak", F.coalesce(peak, F.lit(False)))


def separate(indexes: Column, least: Column | int) -> Column:
    """Of sorted indexes, from the left, those at least so far behind the last one kept."""
    keep = lambda kept, i: F.when((F.size(kept) == 0) | (i - F.try_element_at(kept, F.lit(-1)) >= least), F.array_append(kept, i)).otherwise(kept)
    return F.aggregate(indexes, F.slice(indexes, 1, 0), keep)


def _near(points: DataFrame, samples: DataFrame, radius: int | Column, most: int) -> DataFrame:
    """Points with the samples (j, g, peak) at most `radius` (never above `most`) from them. The window is spread over index
    cells, so that a point meets the samples around it, not its whole profile. Both sides are shuffled: the planner takes the copies of
    points, one a variant and cell, for no more than the points and would broadcast them all."""
    width = 2 * most + 1
    s = samples.select("target", F.col("i").alias("j"), "g", "peak", F.floor(F.col("i") / width).alias("cell"))
    cells = points.withColumn("cell", F.explode(F.sequence(F.floor((F.col("i") - most) / width), F.floor((F.col("i") + most) / width))))
    return cells.hint("merge").join(s, ["target", "cell"]).filter(F.abs(F.col("i") - F.col("j")) <= radius).drop("cell")


def snap(points: DataFrame, samples: DataFrame, radius: int, strength: float | None = None, drop_quantile: float | Column | None = None, nearest: bool = False, separation: int = 0) -> DataFrame:
    """(target, indexes): change points (target, i) moved to the steepest sample within `radius` samples, or to the
    nearest peak of the gradient there; only if that is `strength` times as steep; flat ones dropped; duplicates and
    points too close behind another merged."""
    one = {"name": "", "radius": radius, "strength": strength, "drop": drop_quantile, "nearest": nearest, "separation": separation}
    return snap_variants(points, samples, [one]).drop("variant")


def snap_variants(points: DataFrame, samples: DataFrame, variants: list[dict], keys: list[str] | None = None) -> DataFrame:
    """(keys, variant, target, indexes): the points under each variant of snap(), all in one pass over points and samples. A
    variant has a name, radius, strength, drop, nearest and separation; drop may be a column of the points."""
    keys = keys or []
    lit = lambda v, kind: v if isinstance(v, Column) else F.lit(v).cast(kind)
    rows = [F.struct(F.lit(v["name"]).alias("variant"), F.lit(v["radius"]).alias("radius"), lit(v.get("strength"), "double").alias("strength"), lit(v.get("drop"), "double").alias("drop"), F.lit(bool(v.get("nearest"))).alias("nearest"), F.lit(int(v.get("separation") or 0)).alias("separation")) for v in variants]
    asked = points.select(*keys, "target", "i", F.explode(F.array(*rows)).alias("v")).select(*keys, "target", "i", "v.*")
    own = [*keys, "variant", "target", "i"]
    near = _near(asked, samples, F.col("radius"), max(v["radius"] for v in variants))
    steepest = F.max(F.struct(F.col("g").alias("o1"), (-F.col("j")).alias("o2"), "j", "g"))
    closest = F.min(F.when(F.col("peak"), F.struct(F.abs(F.col("j") - F.col("i")).alias("o1"), F.col("j").alias("o2"), "j", "g")))
    here = F.max(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("g0")
    moved = near.groupBy(*own).agg(here, steepest.alias("s"), closest.alias("c"), *[F.first(c).alias(c) for c in ("nearest", "strength", "drop", "separation")])
    at = lambda c: F.when(F.col("nearest"), F.coalesce(f"c.{c}", f"s.{c}")).otherwise(F.col(f"s.{c}"))
    moved = moved.withColumns({"j": at("j"), "g1": at("g")}).drop("s", "c", "nearest")
    stay = F.col("strength").isNotNull() & (F.col("g0") > 0) & (F.col("g1") < F.col("strength") * F.col("g0"))
    moved = moved.withColumns({"j": F.when(stay, F.col("i")).otherwise(F.col("j")), "g1": F.when(stay, F.col("g0")).otherwise(F.col("g1"))})
    if any(v.get("drop") is not None for v in variants):
        # the quantiles of each profile's gradients that some point asks for
        asked_for = moved.filter("drop is not null").select("target", "drop").distinct()
        wanted = asked_for.groupBy("target").agg(F.array_sort(F.collect_set("drop")).alias("quantiles"))
        sorted_g = samples.join(wanted, "target").groupBy("target").agg(F.array_sort(F.collect_list("g")).alias("gs"), F.first("quantiles").alias("quantiles"))
        floors = sorted_g.select("target", F.explode("quantiles").alias("drop"), "gs").select("target", "drop", linear_quantile(F.col("gs"), F.col("drop")).alias("floor"))
        moved = moved.join(floors, ["target", "drop"], "left").filter(F.col("drop").isNull() | (F.col("g1") >= F.col("floor")))
    out = moved.groupBy(*keys, "variant", "target").agg(F.array_sort(F.collect_set("j")).alias("indexes"), F.first("separation").alias("separation"))
    return out.select(*keys, "variant", "target", F.when(F.col("separation") > 0, separate(F.col("indexes"), F.col("separation"))).otherwise(F.col("indexes")).alias("indexes"))


def linear_quantile(ordered: Column, q: Column) -> Column:
    """The quantile of a sorted array, linear between its values."""
    at = q * (F.size(ordered) - 1)
    low = F.get(ordered, F.floor(at).cast("int"))
    high = F.get(ordered, F.ceil(at).cast("int"))
    return between(low, high, at - F.floor(at))


def confident(points: DataFrame, probability: str, quantile: float) -> DataFrame:
    """Change points whose probability reaches that quantile of their profile's."""
    return with_quantile(points, probability, quantile, "_f").filter(F.col(probability) >= F.col("_f")).drop("_f")


def two_radii(points: DataFrame, samples: DataFrame, small: int, large: int, ratio: float) -> DataFrame:
    """(target, i, j): the peak within the large radius if it is `ratio` times as steep as that in the small one."""
    near = _near(points.select("target", "i"), samples, large, large)
    order = F.struct("g", -F.col("j"))
    inner = F.abs(F.col("i") - F.col("j")) <= small
    best = near.groupBy("target", "i").agg(F.max(order).alias("far"), F.max(F.when(inner, order)).alias("close"))
    return best.select("target", "i", F.when(F.col("far.g") >= ratio * F.col("close.g"), -F.col("far.col2")).otherwise(-F.col("close.col2")).alias("j"))


def augment(points: DataFrame, samples: DataFrame, quantile: float, distance: int) -> DataFrame:
    """(target, i): the points, and peaks at that quantile of all peaks or steeper that are `distance` samples from every
    point."""
    steep = with_quantile(samples.filter("peak"), "g", quantile, "floor").filter(F.col("g") >= F.col("floor")).select("target", "i")
    # steep samples and points in order: the point before and the one behind tell the distance
    marks = points.select("target", "i", F.lit(True).alias("mark"))
    both = marks.unionByName(steep.withColumn("mark", F.lit(False)))
    order = Window.partitionBy("target").orderBy("i")
    point = F.when(F.col("mark"), F.col("i"))
    before = F.last(point, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    behind = F.first(point, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    far = F.coalesce(F.col("i") - before >= distance, F.lit(True)) & F.coalesce(behind - F.col("i") >= distance, F.lit(True))
    free = both.withColumn("_far", far).filter("not mark and _far").select("target", "i")
    return points.select("target", "i").unionByName(free).distinct()
