"""Reading and writing of measurement, strata, location and boundary tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import as_number
from .shared import settled

__all__ = ["Dataset", "settled"]

#: Column names of the measurement files and what they are called here.
MEASURED = {"SCPT_ICBE": "Ic", "SCPT_NQT": "Qtn", "SCPT_NFR": "Fr", "SCPT_QT": "Qt", "SCPT_RES": "qc", "SCPT_FRES": "fs", "SCPT_PWP2": "u2", "SCPT_NU2": "U2"}
BOUNDARY_HEADERS = ("boundary_depth", "depth", "depth_m")


#: Names of the files of the known dataset profiles.
PROFILES = {
    "default": {"cpt": "CPT_clean.csv", "strata": "Input_Strata_merged_boundaries.csv", "locations": "Input_Location_clean.csv", "perfect_recall": "perfect_recall.csv"},
    "new_location": {"cpt": "2_CPT_clean.csv", "strata": "2_Input_Strata_only_loc_targets.csv", "locations": "2_Input_Location.csv", "perfect_recall": "new_dataset_51_profiles_high_recall.csv"},
}


@dataclass(frozen=True)
class Dataset:
    """Where the files of a dataset lie; prefixes tell several in one folder apart, a profile names its files."""

    root: str
    prefix: str = ""
    profile: str = "default"

    def path(self, name: str) -> str:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown dataset profile: {self.profile}; there are: {', '.join(PROFILES)}")
        return f"{self.root.rstrip('/')}/{self.prefix}{PROFILES[self.profile].get(name, name)}"

    def missing(self, spark: SparkSession, names: tuple[str, ...] = ("cpt", "strata", "locations")) -> list[str]:
        """Those of the named files that aren't there, by whatever file system the root names."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [(name, jvm.org.apache.hadoop.fs.Path(self.path(name))) for name in names]
        return [name for name, path in paths if not path.getFileSystem(conf).exists(path)]

    def check(self, spark: SparkSession, names: tuple[str, ...] = ("cpt", "strata", "locations")) -> Dataset:
        """This, if its files are there."""
        if missing := self.missing(spark, names):
            raise FileNotFoundError(f"{self.root} lacks {', '.join(self.path(n).rsplit('/', 1)[1] for n in missing)}")
        return self

    def boundary_files(self, spark: SparkSession) -> list[str]:
        """Names of the CSV files under boundaries/, sorted; none without that folder."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/boundaries")
        system = folder.getFileSystem(conf)
        if not system.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().endswith(".csv"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns: headers and cells trimmed, a byte order mark dropped, blank cells NULL."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    return out.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in out.columns])


def in_file_order(df: DataFrame) -> DataFrame:
    """With file_pos, which grows in the order of the files' names and of the rows in each: a file's name, where a split of it
    begins and the row's place in that. How splits are packed into tasks doesn't matter. Tables that are no files go by partition."""
    row = F.monotonically_increasing_id()
    try:
        return df.withColumn("file_pos", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), row.alias("row")))
    except AnalysisException:
        return df.withColumn("file_pos", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("split"), row.alias("row")))


def need(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df


def measurements(df: DataFrame, sensors: list[str], target: str = "Target", depth: str = "Depth") -> DataFrame:
    """target, depth and sensors as numbers, rows without target or depth dropped; only these columns are read."""
    need(df, [target, depth, *sensors])
    rows = df.select(F.col(target).alias("target"), as_number(F.col(depth).cast("string")).alias("depth"), *[as_number(F.col(s).cast("string")).alias(s) for s in sensors])
    return rows.dropna(subset=["target", "depth"])


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in MEASURED.items() if k in df.columns})


def strata(df: DataFrame, point_as_target: bool = False) -> DataFrame:
    """target, point_id, top, bottom, unit, file_pos. Of a target with several points only the first in the file counts."""
    need(df, ["PointID", "Top", "Bottom", "UNIT"])
    rows = df if "file_pos" in df.columns else in_file_order(df)
    target = F.col("PointID") if point_as_target else F.col("Target")
    rows = rows.select(target.alias("target"), F.col("PointID").alias("point_id"), as_number(F.col("Top").cast("string")).alias("top"), as_number(F.col("Bottom").cast("string")).alias("bottom"), F.col("UNIT").alias("unit"), "file_pos").dropna(subset=["target", "top", "bottom", "unit"])
    first = rows.groupBy("target").agg(F.min_by("point_id", "file_pos").alias("point_id"))
    return rows.join(first, ["target", "point_id"], "left_semi")


def with_fallback(main: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of `other` for targets that `main` lacks are added."""
    return main.unionByName(other.join(main, "target", "left_anti"), allowMissingColumns=True)


def locations(df: DataFrame) -> DataFrame:
    """The first row of each target: target, x, y, z and, if there, bathymetry; what isn't a number is NULL."""
    rows = df if "file_pos" in df.columns else in_file_order(df)
    numbers = [as_number(F.col(c).cast("string")).alias(c.lower()) for c in ("X", "Y", "Z", "Bathymetry") if c in df.columns]
    rows = rows.select(F.trim("Target").alias("target"), *numbers, "file_pos").filter("target is not null")
    first = F.row_number().over(Window.partitionBy("target").orderBy("file_pos"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n", "file_pos")


def boundaries(df: DataFrame) -> DataFrame:
    """Distinct (target, boundary) of a table whose headers may be spelt in any case."""
    names = {c.lower(): c for c in df.columns}
    depth = next((names[n] for n in BOUNDARY_HEADERS if n in names), None)
    if "target" not in names or depth is None:
        raise ValueError(f"a boundary table needs a target and one of {', '.join(BOUNDARY_HEADERS)}; there are: {', '.join(df.columns)}")
    rows = df.select(F.col(names["target"]).cast("string").alias("target"), as_number(F.col(depth).cast("string")).alias("boundary"))
    return rows.dropna().distinct()


def pick_targets(df: DataFrame, include: list | None = None, exclude: list | None = None, first: int | None = None, located: DataFrame | None = None, need_some: bool = False) -> DataFrame:
    """Rows of chosen targets: some, all but some, the first by name, those with coordinates. No rows left is an error if some are
    needed."""
    out = df
    if include:
        out = out.filter(F.col("target").isin(include))
    if exclude:
        out = out.filter(~F.col("target").isin(exclude))
    if located is not None:
        finite = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in ("x", "y")]
        out = out.join(located.filter(finite[0] & finite[1]), "target", "left_semi")
    if first is not None:
        out = out.join(out.select("target").distinct().orderBy("target").limit(first), "target", "left_semi")
    if need_some and out.isEmpty():
        raise ValueError("no targets are left by the filters")
    return out


def excluded(df: DataFrame, reason: str, kept: DataFrame) -> DataFrame:
    """(target, reason) of the targets that `kept` lacks."""
    return df.select("target").distinct().join(kept, "target", "left_anti").withColumn("reason", F.lit(reason))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet, or as CSV with a header, arrays and structs of it as JSON."""
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_all(tables: dict[str, DataFrame], root: str, kind: str = "parquet") -> None:
    """Each table under its name."""
    for name, df in tables.items():
        write(df, f"{root.rstrip('/')}/{name}", kind)
