"""Run records, model and feature-set registries, and comparisons of runs."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "model_id string, run string, started double, elapsed double, input string, boundary_source string, nmi double, ari double, accuracy double, config string"


def record(spark: SparkSession, table: str, model_id: str, config: dict, metrics: dict, source: str = "ground_truth", started: float | None = None) -> str:
    """Append a run to the run table (Parquet, a folder a model) and return its name."""
    now = time.time()
    run = time.strftime("%Y%m%d-%H%M%S", time.gmtime(now)) + f"-{int(now * 1e6) % 1_000_000:06d}"
    row = (model_id, run, started or now, now - (started or now), str(config.get("input", "")), source, *[float(metrics[k]) if metrics.get(k) is not None else None for k in ("nmi", "ari", "accuracy")], json.dumps(config, sort_keys=True))
    spark.createDataFrame([row], RUN).write.mode("append").partitionBy("model_id").parquet(table)
    return run


def best(runs: DataFrame) -> DataFrame:
    """The best run of each model by NMI, a missing one counting 0; of equals the latest."""
    key = F.struct(F.coalesce("nmi", F.lit(0.0)).alias("nmi"), "run")
    return runs.groupBy("model_id").agg(F.max_by("run", key).alias("run"), F.max(key)["nmi"].alias("nmi"))


def best_of_all(runs: DataFrame, folder: Column | None = None) -> DataFrame:
    """The best run of all by NMI, a missing one counting 0, or of each folder; of equals the earliest, then the first model by name.
    (folder, model_id, run, nmi)"""
    rows = runs.select((folder if folder is not None else F.lit(None).cast("string")).alias("folder"), "model_id", "run", F.coalesce("nmi", F.lit(0.0)).alias("nmi"))
    return rows.groupBy("folder").agg(F.min_by(F.struct("model_id", "run", "nmi"), F.struct((-F.col("nmi")).alias("less"), "run", "model_id")).alias("best")).select("folder", "best.*")


def latest(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model_id").agg(F.max("run").alias("run"))


def listed(runs: DataFrame, model_id: str | None = None, input_file: str | None = None, sort: str = "run", descending: bool = True) -> DataFrame:
    out = runs
    if model_id is not None:
        out = out.filter(F.col("model_id") == model_id)
    if input_file is not None:
        out = out.filter(F.col("input") == input_file)
    return out.orderBy(F.desc(sort) if descending else F.asc(sort))


def by_source(runs: DataFrame, metrics: tuple[str, ...] = ("nmi", "ari", "accuracy")) -> DataFrame:
    """A row a model and metric with a column for each boundary source and the last minus the first; models with at least
    two sources."""
    sources = [r.boundary_source for r in runs.select("boundary_source").distinct().orderBy("boundary_source").collect()]
    long = runs.select("model_id", "boundary_source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("v")).select("model_id", "boundary_source", "v.*")
    wide = long.groupBy("model_id", "metric").pivot("boundary_source", sources).agg(F.max("value"))
    filled = [F.when(F.col(s).isNotNull(), F.col(s)) for s in sources]
    there = F.filter(F.array(*filled), lambda x: x.isNotNull())
    return wide.withColumn("delta", F.when(F.size(there) > 1, F.try_element_at(there, F.lit(-1)) - F.try_element_at(there, F.lit(1)))).filter(F.size(there) > 1)


def delta(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Differences b - a of columns by key, of rows of either."""
    rows = a.select(key, *[F.col(c).alias(f"{c}_a") for c in columns]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns]), key, "full_outer")
    return rows.withColumns({f"{c}_delta": F.col(f"{c}_b") - F.col(f"{c}_a") for c in columns})


class Registry:
    """JSON definitions by id in a folder of folders; `best` wins where an id occurs twice."""

    def __init__(self, root: str, key: str):
        self.root, self.key = Path(root), key

    def all(self) -> dict[str, dict]:
        found: dict[str, dict] = {}
        for path in sorted(self.root.rglob("*.json"), key=lambda p: (p.parent.name == "best", str(p))):
            item = json.loads(path.read_text())
            found[item.get(self.key, path.stem)] = item
        return found

    def load(self, name: str) -> dict:
        path = self.root / name
        if path.suffix == ".json" and path.exists():
            return json.loads(path.read_text())
        if name not in (found := self.all()):
            raise KeyError(f"no {self.key} {name!r}")
        return found[name]

    def save(self, item: dict, folder: str = "", replace: bool = False) -> Path:
        if any(part in (".", "..") for part in folder.split("/")):
            raise ValueError(f"not a folder: {folder!r}")
        if not replace and item[self.key] in self.all():
            raise ValueError(f"{self.key} {item[self.key]!r} exists")
        path = self.root / folder / f"{re.sub(r'[^A-Za-z0-9._-]+', '_', item[self.key])}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(item, indent=1, sort_keys=True))
        return path

    def delete(self, name: str) -> None:
        for path in self.root.rglob("*.json"):
            if json.loads(path.read_text()).get(self.key, path.stem) == name:
                path.unlink()


def run_suite(entries: list[dict], fit, prefix: str = "", only: list[str] | None = None, limit: int | None = None, dry: bool = False) -> tuple[list[dict], list[dict]]:
    """Fit each entry of a suite that is asked for. Results and errors, a row each: one failure doesn't stop the rest."""
    if bad := [e["model_id"] for e in entries if not e["model_id"].startswith(prefix)]:
        raise ValueError(f"without the prefix {prefix!r}: {bad}")
    chosen = [e for e in entries if not only or e["model_id"] in only][:limit]
    results, errors = [], []
    for entry in chosen:
        began = time.time()
        try:
            metrics = {} if dry else fit(entry)
            results.append({**entry, **metrics, "elapsed": time.time() - began})
        except Exception as error:  # noqa: BLE001  a suite reports what failed
            errors.append({"model_id": entry["model_id"], "error": f"{type(error).__name__}: {error}"})
    return results, errors
