"""Scores of boundaries and of clusters against reference intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCES = (0.5, 1.0, 2.0)


def name_of(tolerance: float) -> str:
    return str(float(tolerance)).replace(".", "_")


def matched_costs(pred: Column, true: Column) -> Column:
    """Distances of the greedy one-to-one matching of two sorted arrays: always the closest pair that is left, ties by
    place. Done once; a tolerance only cuts the result."""
    pairs = F.flatten(F.transform(pred, lambda p, i: F.transform(true, lambda t, j: F.struct(F.abs(p - t).alias("cost"), i.alias("i"), j.alias("j")))))
    empty = F.struct(F.array().cast("array<int>").alias("is"), F.array().cast("array<int>").alias("js"), F.array().cast("array<double>").alias("costs"))

    def take(s: Column, pair: Column) -> Column:
        used = F.array_contains(s["is"], pair["i"]) | F.array_contains(s["js"], pair["j"])
        more = F.struct(F.array_append(s["is"], pair["i"]).alias("is"), F.array_append(s["js"], pair["j"]).alias("js"), F.array_append(s["costs"], pair["cost"]).alias("costs"))
        return F.when(used, s).otherwise(more)

    return F.aggregate(F.array_sort(pairs), empty, take)["costs"]


def f1_columns(tp: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where nothing is there to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = share(tp, n_pred), share(tp, n_true)
    return p, r, share(2 * tp, n_pred + n_true)


def _at_most(limit: float):
    return lambda x: x <= limit


def boundary_scores(pred: DataFrame, true: DataFrame, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """Per target of either frame (target, boundary): counts, precision, recall and F1 at each tolerance."""
    lists = lambda df, name: df.filter("boundary is not null").groupBy("target").agg(F.array_sort(F.collect_list("boundary")).alias(name))
    none = F.array().cast("array<double>")
    both = lists(pred, "pred").join(lists(true, "true"), "target", "full_outer").select("target", F.coalesce("pred", none).alias("pred"), F.coalesce("true", none).alias("true"))
    rows = both.select("target", F.size("pred").cast("long").alias("n_pred"), F.size("true").cast("long").alias("n_true"), matched_costs(F.col("pred"), F.col("true")).alias("_c"))
    for t in tolerances:
        n = name_of(t)
        rows = rows.withColumn(f"tp_{n}", F.size(F.filter("_c", _at_most(t))).cast("long"))
        p, r, f = f1_columns(F.col(f"tp_{n}"), F.col("n_pred"), F.col("n_true"))
        rows = rows.withColumns({f"fp_{n}": F.col("n_pred") - F.col(f"tp_{n}"), f"fn_{n}": F.col("n_true") - F.col(f"tp_{n}"), f"precision_{n}": p, f"recall_{n}": r, f"f1_{n}": f})
    return rows.drop("_c")


def scores_by(points: DataFrame, name: str, names: list, true: DataFrame, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """boundary_scores() of several runs at once: points (name, target, boundary) of runs whose names are listed, so that runs
    without any points count too. Per name and target."""
    key = F.struct(name, "target").alias("target")
    every = true.withColumn(name, F.explode(F.array(*[F.lit(n) for n in names])))
    scores = boundary_scores(points.select(key, "boundary"), every.select(key, "boundary"), tolerances)
    return scores.select(F.col(f"target.{name}").alias(name), F.col("target.target").alias("target"), *[c for c in scores.columns if c != "target"])


def pooled_by(scores: DataFrame, name: str, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """A row a name: pooled precision, recall and F1 and the mean F1 of profiles at each tolerance."""
    sums = [F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true")]
    for t in tolerances:
        sums += [F.sum(f"tp_{name_of(t)}").alias(f"_tp_{name_of(t)}"), F.avg(f"f1_{name_of(t)}").alias(f"mean_f1_{name_of(t)}")]
    rows = scores.groupBy(name).agg(*sums)
    out = []
    for t in tolerances:
        n = name_of(t)
        p, r, f = f1_columns(F.col(f"_tp_{n}"), F.col("n_pred"), F.col("n_true"))
        out += [p.alias(f"precision_{n}"), r.alias(f"recall_{n}"), f.alias(f"f1_{n}"), F.col(f"mean_f1_{n}")]
    return rows.select(name, "n_pred", "n_true", *out)


def pooled_scores(scores: DataFrame, tolerances: tuple[float, ...] = TOLERANCES) -> DataFrame:
    """One row a tolerance: precision, recall and F1 of all boundaries together, mean and median F1 of profiles."""
    rows = scores.select("n_pred", "n_true", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tolerance"), F.col(f"tp_{name_of(t)}").alias("tp"), F.col(f"f1_{name_of(t)}").alias("f1")) for t in tolerances])).alias("s"))
    sums = rows.groupBy("s.tolerance").agg(F.sum("s.tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"), F.avg("s.f1").alias("mean_f1"), F.percentile("s.f1", F.lit(0.5)).alias("median_f1"))
    p, r, f = f1_columns(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return sums.select("tolerance", p.alias("pooled_precision"), r.alias("pooled_recall"), f.alias("pooled_f1"), "mean_f1", "median_f1")


def name_clusters(rows: DataFrame) -> DataFrame:
    """(cluster_id, predicted_unit): the most frequent unit of a cluster's samples, the smallest of equals."""
    counts = rows.filter("unit is not null").groupBy("cluster_id", "unit").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.min_by("unit", F.struct(-F.col("n"), "unit")).alias("predicted_unit"))


def class_report(rows: DataFrame, true: str = "unit", pred: str = "predicted_unit") -> DataFrame:
    """Precision, recall, F1 and support of each label of either column."""
    table = rows.filter(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = table.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).alias("n_pred"), F.col("n").alias("n_true")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("n_pred"), F.lit(0).alias("n_true")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "n_pred", "n_true")])
    p, r, f = f1_columns(F.col("hit"), F.col("n_pred"), F.col("n_true"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n_true").alias("support"), "hit")


def cluster_metrics(rows: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, weighted F1 of the names; ARI and NMI of the cluster ids."""
    labelled = rows.filter("unit is not null and predicted_unit is not null")
    report = class_report(labelled)
    names = report.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return names.crossJoin(agreement(labelled, "unit", "cluster_id"))  # one row each


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic) of two labellings, from their table of counts."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    marked = cells.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    # each margin occurs once for each of its cells: share it among them
    ka, kb = F.count("*").over(Window.partitionBy("a")), F.count("*").over(Window.partitionBy("b"))
    marked = marked.withColumns({"ca": two("na") / ka, "cb": two("nb") / kb, "ka": ka, "kb": kb})
    sums = marked.agg(F.sum("n").alias("n"), F.sum(two("n")).alias("s"), F.sum("ca").alias("sa"), F.sum("cb").alias("sb"), F.sum(F.col("n") * F.log("n")).alias("h"), F.sum(F.col("n") * F.log("na")).alias("ha"), F.sum(F.col("n") * F.log("nb")).alias("hb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("n") * (F.col("n") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0))
    n = F.col("n")
    h_a, h_b = F.log(n) - F.col("ha") / n, F.log(n) - F.col("hb") / n
    mutual = F.log(n) + (F.col("h") - F.col("ha") - F.col("hb")) / n
    nmi = F.when((h_a + h_b) <= 1e-12, 1.0).otherwise(F.greatest(mutual, F.lit(0.0)) / ((h_a + h_b) / 2))
    return sums.select(ari.alias("ari"), nmi.alias("nmi"))
