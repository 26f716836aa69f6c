"""The frames that charts and reports are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import detect


def interval_frames(strata: DataFrame, segments: DataFrame) -> DataFrame:
    """(target, side, top, bottom, unit) of every target of either: the reference's layers and the predicted ones, without those
    that lack an end, in order of target, side and top."""
    side = lambda df, name, unit: df.select(F.col("target").cast("string").alias("target"), F.lit(name).alias("side"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.col(unit).cast("string").alias("unit"))
    rows = side(strata, "reference", "unit").unionByName(side(segments, "predicted", "predicted_unit"))
    return rows.filter("target is not null and top is not null and bottom is not null").orderBy("target", "side", "top")


def soil_scatter(rows: DataFrame, q: str, f: str, label: str) -> DataFrame:
    """(label, q, f, ic, zone) of the samples that have both of a soil chart's coordinates."""
    own = rows.select(F.col(label).alias("label"), F.col(q).cast("double").alias("q"), F.col(f).cast("double").alias("f")).filter(fn.valid_pair(F.col("q"), F.col("f")))
    ic = fn.soil_index(F.col("q"), F.col("f"))
    return own.withColumn("ic", ic).withColumn("zone", fn.soil_zone(F.col("ic"), F.col("q")))


def soil_grid(spark, n: int = 400, q: tuple[float, float] = (1.0, 1000.0), f: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """(i, j, q, f, zone): the zones of a soil chart on n by n places, evenly spaced in logarithms."""
    cells = spark.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("j"))
    at = lambda c, ends: ends[0] * F.pow(F.lit(ends[1] / ends[0]), F.col(c) / (n - 1))
    out = cells.withColumns({"q": at("j", q), "f": at("i", f)})
    return out.withColumn("zone", fn.soil_zone(fn.soil_index(F.col("q"), F.col("f")), F.col("q")))


def posterior_map(df: DataFrame, sensors: list[str], floor: float = 1e-6, **settings) -> DataFrame:
    """(target, depth, run, heat): -log10 of the run-length posterior; shares below the floor have no row and count as the
    floor's heat."""
    rows = detect.posteriors(df, sensors, floor, **settings)
    return rows.select("target", "depth", "run", (-F.log10(F.greatest("p", F.lit(floor)))).alias("heat"))


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A report: each table's first rows under its name. For tables of results, in the order that they have."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        found = df.limit(rows + 1).collect()
        show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v).replace("|", "\\|")
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join(show(v) for v in row) + " |" for row in found[:rows]]
        more = ["", f"({rows} rows shown)"] if len(found) > rows else []
        parts += ["", f"## {name}", "", *lines, *more]
    return "\n".join(parts) + "\n"
