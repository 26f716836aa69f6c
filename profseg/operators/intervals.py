"""Segments of profiles and joins of samples and segments with intervals. Every join has the target as an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edges(df: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(target, edges): least and largest depth and the boundaries between, sorted. Only targets of both frames."""
    ends = df.groupBy("target").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    marks = boundaries.groupBy("target").agg(F.collect_set("boundary").alias("marks"))
    inner = F.filter("marks", lambda b: (b > F.col("low")) & (b < F.col("high")))
    return ends.join(marks, "target").select("target", F.array_sort(F.array_distinct(F.concat(F.array("low", "high"), inner))).alias("edges"))


def _merged(cuts: Column, least: float, grow_first: bool) -> Column:
    """Fold the edges from the top; the last edge kept is always the one before, so its segment grows by replacing it."""
    rest = F.slice(cuts, 2, F.greatest(F.size(cuts) - 1, F.lit(0)))

    def step(kept: Column, edge: Column) -> Column:
        thin = edge - F.element_at(kept, -1) < least
        if grow_first:
            thin = thin | ((F.size(kept) == 2) & (F.element_at(kept, -1) - F.element_at(kept, 1) < least))
        grown = F.array_append(F.slice(kept, 1, F.size(kept) - 1), edge)
        return F.when((F.size(kept) > 1) & thin, grown).otherwise(F.array_append(kept, edge))

    return F.when(F.size(cuts) < 2, cuts).otherwise(F.aggregate(rest, F.slice(cuts, 1, 1), step))


def merge_thin(cuts: Column, least: float) -> Column:
    """Edges without segments thinner than `least`: a thin first segment takes in the next, a later one joins the one
    before."""
    return _merged(cuts, least, True)


def merge_thin_behind(cuts: Column, least: float) -> Column:
    """As above, but a thin first segment stays."""
    return _merged(cuts, least, False)


def segments(cuts: DataFrame) -> DataFrame:
    """(target, segment_id, top, bottom, thickness) from (target, edges); ids from 0 downwards."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.element_at("edges", i).alias("top"), F.element_at("edges", i + 1).alias("bottom")))
    rows = cuts.filter(F.size("edges") > 1).select("target", F.posexplode(pairs).alias("segment_id", "s"))
    return rows.select("target", "segment_id", "s.top", "s.bottom", (F.col("s.bottom") - F.col("s.top")).alias("thickness"))


def _under(df: DataFrame, tops: DataFrame, at: str, strict: bool = False) -> DataFrame:
    """Rows of `df` with `_s`, the last of the structs `_s` of `tops` (target, depth, _s) whose depth isn't below that in
    `at` (`strict`: lies above it). A union sorted in each target: no pair of row and interval is made."""
    rows = df.withColumns({"_at": F.col(at), "_kind": F.lit(0 if strict else 1)})
    marks = tops.select("target", F.col("depth").alias("_at"), F.lit(1 if strict else 0).alias("_kind"), "_s")
    order = Window.partitionBy("target").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).filter(F.col("_kind") == (0 if strict else 1)).drop("_at", "_kind")


def assign(df: DataFrame, segs: DataFrame, inclusive: bool = False) -> DataFrame:
    """Samples with their segment. A segment holds its top but not its bottom, the last one both; inclusive: each both, so
    that a sample on a bound is in both segments. Segments of a target don't overlap."""
    last = F.col("segment_id") == F.max("segment_id").over(Window.partitionBy("target"))
    own = segs.withColumn("_last", last).select("target", F.col("top").alias("depth"), F.struct("segment_id", F.col("top").alias("seg_top"), F.col("bottom").alias("seg_bottom"), "_last").alias("_s"))
    ends = F.lit(True) if inclusive else F.col("_s._last")
    inside = (F.col("depth") < F.col("_s.seg_bottom")) | (ends & (F.col("depth") <= F.col("_s.seg_bottom")))
    found = _under(df, own, "depth").filter(inside)
    if inclusive:  # the segment that ends where a sample lies, if another begins there
        above = _under(df, own, "depth", strict=True).filter((F.col("depth") == F.col("_s.seg_bottom")) & ~F.col("_s._last"))
        found = found.unionByName(above)
    return found.select(*[c for c in df.columns], "_s.segment_id", "_s.seg_top", "_s.seg_bottom")


def dominant_unit(segs: DataFrame, strata: DataFrame) -> DataFrame:
    """Segments with the unit of the stratum that overlaps most; the first of equals, NULL without overlap.
    strata: target, top, bottom, unit, file_pos (of any type that orders), in any order, overlapping or not. Segments and strata meet in cells of the
    width of a target's average interval, so that few pairs don't overlap."""
    keys = ["target", "segment_id", "top", "bottom"]
    size = segs.groupBy("target").agg(F.greatest(F.avg(F.col("bottom") - F.col("top")), F.lit(1e-9)).alias("_w"))
    cells = lambda df, top, bottom: df.join(size, "target").withColumn("_cell", F.explode(F.sequence(F.floor(F.col(top) / F.col("_w")), F.floor(F.col(bottom) / F.col("_w"))))).drop("_w")
    ends = segs.groupBy("target").agg(F.min("top").alias("_lo"), F.max("bottom").alias("_hi"))
    s = strata.select("target", F.col("top").alias("_t"), F.col("bottom").alias("_b"), "unit", "file_pos").join(ends, "target").filter((F.col("_b") > F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    s = s.withColumns({"_from": F.greatest("_t", "_lo"), "_to": F.least("_b", "_hi")})
    overlap = F.least("bottom", "_b") - F.greatest("top", "_t")
    # a pair that shares several cells counts in each alike: the largest overlap is the same
    best = F.min_by("unit", F.struct(-overlap, "file_pos"))
    found = cells(segs, "top", "bottom").join(cells(s, "_from", "_to"), ["target", "_cell"]).filter(overlap > 0).groupBy(*keys).agg(best.alias("unit"))
    return segs.join(found, keys, "left")


def asof_unit(df: DataFrame, strata: DataFrame) -> DataFrame:
    """Samples with the unit of the last stratum whose top isn't below them, if its bottom isn't above. A union sorted in
    each target: no pair of sample and stratum is made."""
    tops = strata.select("target", F.col("top").alias("depth"), F.struct("bottom", "unit").alias("_s"))
    found = _under(df, tops, "depth")
    return found.withColumn("unit", F.when(F.col("depth") <= F.col("_s.bottom"), F.col("_s.unit"))).drop("_s")


def within_distance(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, distance) of targets at most `radius` apart: a join of grid cells with their neighbours."""
    cell = lambda c: F.floor(F.col(c) / radius)
    rows = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    left = rows.select(F.col("target").alias("a"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    right = rows.select(F.col("target").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), around.alias("o")).select("b", "x2", "y2", (cell("x2") + F.col("o.i")).alias("cx"), (cell("y2") + F.col("o.j")).alias("cy"))
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return left.join(right, ["cx", "cy"]).filter(F.col("a") < F.col("b")).select("a", "b", d.alias("distance")).filter(F.col("distance") <= radius)


def segment_graph(segs: DataFrame, points: DataFrame, radius: float, sigma: float) -> DataFrame:
    """Edges (a, a_segment, b, b_segment, weight) of overlapping segments of near targets."""
    near = within_distance(points, radius)
    s = lambda side: segs.select(F.col("target").alias(side), F.col("segment_id").alias(f"{side}_segment"), F.col("top").alias(f"{side}_top"), F.col("bottom").alias(f"{side}_bottom"))
    both = near.join(s("a"), "a").join(s("b"), "b")
    overlap = F.least("a_bottom", "b_bottom") - F.greatest("a_top", "b_top")
    thick = F.greatest(F.col("a_bottom") - F.col("a_top"), F.col("b_bottom") - F.col("b_top"))
    weight = F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma)) * F.try_divide(overlap, thick)
    return both.filter(overlap > 0).select("a", "a_segment", "b", "b_segment", weight.alias("weight")).filter(F.col("weight") > 1e-6)


def clip_to_depth(segs: DataFrame, cut: float) -> DataFrame:
    """Segments below a depth, the cut one from there on."""
    return segs.filter(F.col("bottom") > cut).withColumn("top", F.greatest("top", F.lit(float(cut)))).withColumn("thickness", F.col("bottom") - F.col("top"))


def coordinate_outliers(points: DataFrame, factor: float = 3.0) -> DataFrame:
    """Locations within `factor` interquartile ranges of the quartiles in x and y; all of them if fewer than four."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    ends = points.agg(F.count("*").alias("n"), *[e.alias(name) for c in ("x", "y") for name, e in ((f"{c}1", q(c, 0.25)), (f"{c}3", q(c, 0.75)))])
    rows = points.crossJoin(F.broadcast(ends))  # one row
    ok = lambda c: F.col(c).between(F.col(f"{c}1") - factor * (F.col(f"{c}3") - F.col(f"{c}1")), F.col(f"{c}3") + factor * (F.col(f"{c}3") - F.col(f"{c}1")))
    return rows.filter((F.col("n") < 4) | (ok("x") & ok("y"))).select(*points.columns)


def least_distance(points: DataFrame) -> DataFrame:
    """One row: the smallest positive distance of two targets, NULL if there is none. Locations are distinct points first;
    each meets its nearest one by cells."""
    from .hazards import nearest

    places = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("x", "y").distinct()
    named = places.select(F.struct("x", "y").alias("target"), "x", "y")
    return nearest(named, 1).agg(F.min("d").alias("least_distance"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Samples with the label of their segment; without one NULL. A segment with two labels is an error."""
    keys = ["target", "segment_id"]
    count = F.count("*").over(Window.partitionBy(*keys))
    ok = F.when(count > 1, F.raise_error(F.concat_ws(" ", F.lit("labels of a segment repeat:"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.lit(True))
    return rows.join(labels.withColumn("_ok", ok).filter("_ok").drop("_ok"), keys, "left")


def with_first_labels(rows: DataFrame, labels: DataFrame, *order: str) -> DataFrame:
    """Samples with the first label of their segment by `order` (then by the labels themselves), NULL without one: labels may repeat."""
    keys = ["target", "segment_id"]
    others = [c for c in labels.columns if c not in keys and c not in order]
    first = labels.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order, *others)).alias("_first"))
    return rows.join(first, keys, "left").select("*", "_first.*").drop("_first")


def with_location(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with the coordinates of their target (x, y and what else `places` has), NULL where it has none."""
    return rows.join(places, "target", "left")
