"""The driver's tables as profiles, strata and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENSORS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor: users are targets, hours since the start of 2024 are depths."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), (micros / 3.6e9).alias("depth"), "value", "event_type", "event_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sensors: suppliers are targets, days since 1995-01-02 are depths, with duplicate depths."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), days.cast("double").alias("depth"), *SENSORS, "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


def item_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As items(), one row a depth."""
    return items(spark, sf_dir).groupBy("target", "depth").agg(*[F.avg(s).alias(s) for s in SENSORS])


def event_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of each user with the most frequent event type, the smallest of equals."""
    week = F.floor(F.col("depth") / 168.0)
    counts = events(spark, sf_dir).groupBy("target", week.alias("week"), "event_type").agg(F.count("*").alias("n"))
    units = counts.groupBy("target", "week").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("unit"))
    return units.select("target", (F.col("week") * 168.0).alias("top"), (F.col("week") * 168.0 + 168.0).alias("bottom"), "unit", F.col("week").alias("file_pos"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 1000.0).alias("y"))


def every(df: DataFrame, n: int) -> DataFrame:
    """(target, boundary): the depth of each nth sample of a profile, as a stand-in for change points."""
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("target").orderBy("depth")) - 1
    return df.withColumn("_i", i).filter((F.col("_i") > 0) & (F.col("_i") % n == 0)).select("target", F.col("depth").alias("boundary"), F.col("_i").alias("i"))


#: The same frames as SQL.
SQL = """
with events_p as (select user_id as target, (epoch_us(ts) - 1704067200000000) / 3.6e9 as depth, value, event_type, event_id from events),
items as (select l_suppkey as target, date_diff('day', date '1995-01-02', l_shipdate::date)::double as depth, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus from lineitem),
prof as (select target, depth, avg(l_quantity) as l_quantity, avg(l_extendedprice) as l_extendedprice, avg(l_discount) as l_discount, avg(l_tax) as l_tax from items group by 1, 2),
ecount as (select target, floor(depth / 168)::bigint as week, event_type, count(*) as n from events_p group by 1, 2, 3),
strata as (select target, week * 168.0::double as top, week * 168.0::double + 168 as bottom, event_type as unit, week as file_pos from ecount qualify row_number() over (partition by target, week order by n desc, event_type) = 1),
locations as (select s_suppkey as target, s_acctbal as x, s_nationkey * 1000.0::double as y from supplier),
enum as (select *, row_number() over (partition by target order by depth) - 1 as i from events_p),
marks as (select target, depth as boundary, i from enum where i > 0 and i % 10 = 0),
marks5 as (select target, depth as boundary, i from enum where i > 0 and i % 5 = 0)
"""
