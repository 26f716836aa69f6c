"""Features of segments. Input are samples with their segment: target, segment_id, seg_top, seg_bottom, depth, sensors.

Shapes stay in arrays or in long rows (target, segment_id, sensor, idx, value) and are widened at the sink only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import friction_ratio, log1p_clipped, log1p_from_zero, log1p_positive, relative_depth
from .clean import gradient_depth

KEYS = ("target", "segment_id")
STATS = {"mean": F.avg, "std": F.stddev_pop, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}


def meta() -> list[Column]:
    return [F.first("seg_top").alias("top"), F.first("seg_bottom").alias("bottom"), F.first(F.col("seg_bottom") - F.col("seg_top")).alias("thickness"), F.count("*").alias("n_rows")]


def summary(rows: DataFrame, sensors: list[str], stats: tuple[str, ...] = tuple(STATS)) -> DataFrame:
    """Chosen statistics of each sensor; unknown names are skipped."""
    return rows.groupBy(*KEYS).agg(*meta(), *[STATS[k](s).alias(f"{s}_{k}") for s in sensors for k in stats if k in STATS])


def distribution(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """Moments, five quantiles, interquartile range and range of each sensor."""
    out = []
    for s in sensors:
        q = {n: F.percentile(s, F.lit(p)) for n, p in (("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))}
        out += [F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
        out += [c.alias(f"{s}_{n}") for n, c in q.items()] + [(q["q75"] - q["q25"]).alias(f"{s}_iqr"), (F.max(s) - F.min(s)).alias(f"{s}_range")]
    return rows.groupBy(*KEYS).agg(*meta(), *out)


def geometry(rows: DataFrame) -> DataFrame:
    """Place and size of a segment, and its place in its profile."""
    ends = rows.groupBy("target").agg(F.min("depth").alias("profile_min"), F.max("depth").alias("profile_max"))
    own = rows.groupBy(*KEYS).agg(*meta())
    span = F.col("profile_max") - F.col("profile_min")
    place = lambda c: F.when(span > 0, (c - F.col("profile_min")) / span).otherwise(0.0)
    mid = (F.col("top") + F.col("bottom")) / 2
    return own.join(ends, "target").select(*KEYS, "top", "bottom", mid.alias("mid"), "thickness", F.log1p("thickness").alias("log_thickness"), "n_rows", F.coalesce(F.try_divide(F.col("n_rows").cast("double"), F.col("thickness")), F.lit(0.0)).alias("row_density"), "profile_min", "profile_max", span.alias("profile_range"), place(F.col("top")).alias("rel_top"), place(mid).alias("rel_mid"), place(F.col("bottom")).alias("rel_bottom"))


def depth_derivatives(rows: DataFrame, sensors: list[str]) -> DataFrame:
    """Statistics of the gradient on true depths, and roughness: mean |change| over the gap, of each sensor. Duplicate
    depths are averaged; fewer than two leave NULLs."""
    own = rows.groupBy(*KEYS, "depth").agg(*[F.avg(s).alias(s) for s in sensors])
    w = Window.partitionBy(*KEYS).orderBy("depth")
    gap = F.col("depth") - F.lag("depth").over(w)
    cols = {}
    for s in sensors:
        cols[f"_g_{s}"] = gradient_depth(s, w)
        cols[f"_r_{s}"] = F.abs(F.col(s) - F.lag(s).over(w)) / gap
    out = []
    for s in sensors:
        g = f"_g_{s}"
        out += [STATS[k](g).alias(f"{s}_grad_{k}") for k in STATS] + [F.avg(F.abs(g)).alias(f"{s}_grad_abs_mean"), F.avg(f"_r_{s}").alias(f"{s}_roughness")]
    return own.withColumns(cols).groupBy(*KEYS).agg(*out)


def engineered(rows: DataFrame, cone: str = "SCPT_RES", sleeve: str = "SCPT_FRES", ratio: str = "SCPT_NQT", friction: str = "SCPT_NFR", zeros: bool = False) -> DataFrame:
    """Statistics of the friction ratio, the logarithm of the cone resistance and logarithms of the normalised pair (positive values
    of it; with `zeros` those of 0 too); NULL where `rows` lacks a column that they need."""
    normalised = log1p_from_zero if zeros else log1p_positive
    there = lambda *c: all(x in rows.columns for x in c)
    none = F.lit(None).cast("double")
    made = {
        "Rf": friction_ratio(F.col(sleeve), F.col(cone)) if there(cone, sleeve) else none,
        "log_qc": log1p_clipped(F.col(cone)) if there(cone) else none,
        f"log_{ratio}": normalised(F.col(ratio)) if there(ratio) else none,
        f"log_{friction}": normalised(F.col(friction)) if there(friction) else none,
    }
    own = rows.select(*KEYS, *[v.alias(f"_{k}") for k, v in made.items()])
    q = lambda c, p: F.percentile(f"_{c}", F.lit(p))
    out = []
    for c in made:
        out += [F.avg(f"_{c}").alias(f"{c}_mean"), F.stddev_pop(f"_{c}").alias(f"{c}_std")]
        if c in ("Rf", "log_qc"):
            out += [q(c, 0.5).alias(f"{c}_median"), q(c, 0.25).alias(f"{c}_q25"), q(c, 0.75).alias(f"{c}_q75")]
        if c == "Rf":
            out.append((q(c, 0.75) - q(c, 0.25)).alias("Rf_iqr"))
    return own.groupBy(*KEYS).agg(*out)


def interpolated(points: Column, at: Column) -> Column:
    """The value at a place of sorted points (x, y), linear between them and held at the ends. Binary search isn't needed:
    segments are short, and both neighbours come from one filter each."""
    below = F.try_element_at(F.filter(points, lambda p: p["x"] <= at), F.lit(-1))
    above = F.get(F.filter(points, lambda p: p["x"] > at), F.lit(0))
    line = below["y"] + (above["y"] - below["y"]) * (at - below["x"]) / (above["x"] - below["x"])
    return F.coalesce(line, below["y"], above["y"])


def shapes(rows: DataFrame, sensors: list[str], length: int) -> DataFrame:
    """(target, segment_id, sensor, shape): each sensor on `length` even places from 0 to 1 of its segment. Duplicate depths
    are averaged; a shape without values is NULL."""
    long = rows.select(*KEYS, relative_depth(F.col("depth"), F.col("seg_top"), F.col("seg_bottom")).alias("x"), F.explode(F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("y")) for s in sensors])).alias("v"))
    means = long.groupBy(*KEYS, "v.sensor", "x").agg(F.avg("v.y").alias("y"))
    points = means.groupBy(*KEYS, "sensor").agg(F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("x", "y")))).alias("points"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i.cast("double") / max(1, length - 1))
    return points.select(*KEYS, "sensor", F.when(F.size("points") > 0, F.transform(grid, lambda at: interpolated(F.col("points"), at))).alias("shape"))


def derivative(shape: Column, length: int) -> Column:
    """Central differences of a shape on an even grid, one-sided at the ends; 0 for a single place."""
    if length < 2:
        return F.transform(shape, lambda x: F.lit(0.0))
    h = 1.0 / (length - 1)
    get = lambda i: F.get(shape, i)
    inner = lambda x, i: F.when(i == 0, (get(F.lit(1)) - x) / h).when(i == length - 1, (x - get(i - 1)) / h).otherwise((get(i + 1) - get(i - 1)) / (2 * h))
    return F.transform(shape, inner)


def paa(rows: DataFrame, sensors: list[str], bins: int) -> DataFrame:
    """(target, segment_id, sensor, paa, paa_d): means of `bins` equal parts of a shape of 8 * bins places, and their
    derivative."""
    fine = shapes(rows, sensors, 8 * bins)
    means = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.aggregate(F.slice("shape", b * 8 + 1, 8), F.lit(0.0), lambda a, x: a + x) / 8)
    return fine.select(*KEYS, "sensor", F.when(F.col("shape").isNotNull(), means).alias("paa")).withColumn("paa_d", derivative(F.col("paa"), bins))


def shape_name(sensor: str, kind: str, index: int, length: int) -> str:
    return f"{sensor}_{kind}{index:0{max(2, len(str(length - 1)))}d}"


def widen(long: DataFrame, arrays: dict[str, str], sensors: list[str], length: int) -> DataFrame:
    """Arrays by sensor to columns like sensor_r00. arrays: column to the letters of its names."""
    out = []
    for s in sensors:
        own = lambda c, s=s: F.first(F.when(F.col("sensor") == s, F.col(c)), ignorenulls=True)
        out += [F.get(own(c), F.lit(i)).alias(shape_name(s, kind, i, length)) for c, kind in arrays.items() for i in range(length)]
    return long.groupBy(*KEYS).agg(*out)


#: The names of geometry() in a hybrid matrix, in order.
GEOMETRY = {"top": "seg_top_depth", "bottom": "seg_bottom_depth", "mid": "seg_mid_depth", "thickness": "seg_thickness", "log_thickness": "seg_log_thickness", "n_rows": "seg_n_rows", "row_density": "seg_row_density", "profile_min": "profile_min_depth", "profile_max": "profile_max_depth", "profile_range": "profile_depth_range", "rel_top": "seg_rel_top_profile", "rel_mid": "seg_rel_mid_profile", "rel_bottom": "seg_rel_bottom_profile"}
DISTRIBUTION = ("mean", "std", "min", "max", "q10", "q25", "median", "q75", "q90", "iqr", "range")
DERIVATIVE = ("mean", "std", "median", "min", "max", "abs_mean")
ENGINEERED = ("Rf_mean", "Rf_std", "Rf_median", "Rf_q25", "Rf_q75", "Rf_iqr", "log_qc_mean", "log_qc_std", "log_qc_median", "log_qc_q25", "log_qc_q75")
#: What a definition's extra_derived adds.
EXTRA = {"Rf": ("Rf_mean", "Rf_std", "Rf_median"), "log_qc": ("log_qc_mean", "log_qc_std")}


def matrix_columns(kind: str, sensors: list[str], length: int = 32, derivatives: bool = False, stats: tuple[str, ...] = tuple(STATS), thickness: bool = False, extra: tuple[str, ...] = (), ratio: str = "SCPT_NQT", friction: str = "SCPT_NFR", values: list[str] | None = None) -> list[str]:
    """The columns of a feature matrix in order, each once. `values` are the names of what fft and stft have by sensor."""
    if kind == "summary":
        names = [f"{s}_{k}" for s in sensors for k in stats if k in STATS]
    elif kind in ("resample", "paa"):
        base, change = ("r", "d") if kind == "resample" else ("paa", "paa_d")
        names = [shape_name(s, k, i, length) for s in sensors for k in (base, change)[: 1 + derivatives] for i in range(length)]
    elif kind == "hybrid":
        names = list(GEOMETRY.values())
        for s in sensors:
            names += [f"{s}_{k}" for k in DISTRIBUTION] + [shape_name(s, k, i, length) for k in ("r", "dr") for i in range(length)]
            names += [f"d_{s}_dz_{k}" for k in DERIVATIVE] + [f"{s}_roughness"]
        return list(dict.fromkeys([*names, *ENGINEERED, *[f"log_{c}_{k}" for c in (ratio, friction) for k in ("mean", "std")]]))
    elif kind in ("fft", "stft"):
        names = [f"{kind}_{s}_{v}" for s in sensors for v in values or []]
    else:
        raise ValueError(f"unknown representation: {kind}")
    more = [c for name in EXTRA if name in extra for c in EXTRA[name]]
    return list(dict.fromkeys([*names, *["thickness"] * thickness, *more]))


def hybrid(rows: DataFrame, sensors: list[str], length: int = 24, cone: str = "SCPT_RES", sleeve: str = "SCPT_FRES", ratio: str = "SCPT_NQT", friction: str = "SCPT_NFR") -> DataFrame:
    """Geometry, distribution, shapes with derivatives, true-depth derivatives and engineered features, side by side under
    the names of matrix_columns(), with top, bottom, thickness and n_rows."""
    keys = list(KEYS)
    own = geometry(rows).withColumns({new: F.col(old) for old, new in GEOMETRY.items()}).select(*keys, "top", "bottom", "thickness", "n_rows", *GEOMETRY.values())
    shape = shapes(rows, sensors, length).withColumn("d", derivative(F.col("shape"), length))
    change = depth_derivatives(rows, sensors).withColumnsRenamed({f"{s}_grad_{k}": f"d_{s}_dz_{k}" for s in sensors for k in DERIVATIVE})
    parts = (distribution(rows, sensors).drop("top", "bottom", "thickness", "n_rows"), widen(shape, {"shape": "r", "d": "dr"}, sensors, length), change, engineered(rows, cone, sleeve, ratio, friction))
    for more in parts:  # all dealt by the same keys: joined where they are
        own = own.join(more, keys)
    return own.select(*keys, "top", "bottom", "thickness", "n_rows", *matrix_columns("hybrid", sensors, length, ratio=ratio, friction=friction))


def pivot_sensors(long: DataFrame, values: list[str], sensors: list[str], keys: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Long rows (keys, sensor, values) to a column for each sensor and value, named prefix_sensor_value. Keys may be NULL, which
    is a key like any other; a sensor without a row leaves NULLs."""
    pick = lambda s, v: F.first(F.when(F.col("sensor") == s, F.col(v)), ignorenulls=True).alias(f"{prefix}{s}_{v}")
    return long.groupBy(*(keys or KEYS)).agg(*[pick(s, v) for s in sensors for v in values])


def frequency_name(freq: float) -> str:
    """Fixed form: 0.25 is pwr_0_25."""
    return f"pwr_{freq:.2f}".replace(".", "_")


def wide_power(power: DataFrame, sensors: list[str], grid: list[float], prefix: str = "stft_", keys: list[str] | None = None) -> DataFrame:
    """Powers (keys, sensor, freq, power, n_windows) to columns prefix_sensor_pwr_0_25 and prefix_sensor_n_windows."""
    keys = keys or list(KEYS)
    at = lambda f: F.first(F.when(F.round("freq", 6) == round(f, 6), F.col("power")), ignorenulls=True).alias(frequency_name(f))
    rows = power.groupBy(*keys, "sensor").agg(F.max("n_windows").alias("n_windows"), *[at(f) for f in grid])
    return pivot_sensors(rows, ["n_windows", *[frequency_name(f) for f in grid]], sensors, keys, prefix)


def quality(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n, missing, ratio, mean, std, min, max, near_constant) of every feature column."""
    long = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("v")).select("v.*")
    out = long.groupBy("feature").agg(F.count("x").alias("n"), (F.count("*") - F.count("x")).alias("missing"), ((F.count("*") - F.count("x")) / F.count("*")).alias("ratio"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.coalesce(F.var_pop("x") < 1e-12, F.lit(True)).alias("near_constant"))
    return out.orderBy("ratio", "near_constant", "feature")


def validate(features: DataFrame, names: list[str]) -> DataFrame:
    """One row: segments, constant columns and the share of missing cells."""
    kinds = [(F.count_distinct(n) + F.when(F.count(n) < F.count("*"), 1).otherwise(0) <= 1).cast("int") for n in names]
    missing = sum((F.count("*") - F.count(n) for n in names[1:]), F.count("*") - F.count(names[0]))
    out = features.agg(F.count("*").alias("n_segments"), sum(kinds[1:], kinds[0]).cast("long").alias("n_constant"), (missing / (F.count("*") * len(names))).alias("missing_share"))
    return out.withColumn("usable", (F.col("n_segments") > 1) & (F.col("n_constant") < len(names)))
