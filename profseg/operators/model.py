"""Preprocessing and clustering of feature matrices: rows with an id and an array column `x`.

EM runs over the distributed matrix: each pass sums responsibilities and moments in every partition and adds these, a few
numbers a cluster, on the driver. All covariance shapes share the pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .linkage import agglomerate, squares, ward
from .selection import percentiles
from .smoothing import connected, smooth_labels, smooth_near, smooth_segments

__all__ = ["agglomerate", "connected", "smooth_labels", "smooth_near", "smooth_segments", "ward"]


def robust_scale(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Median imputation, then (x - median) / IQR with 1 for an IQR of 0; exact percentiles, columns without a value are
    dropped. The percentiles of all columns are found together, with no column in one task."""
    held = settled(df)
    quartiles = [0.25, 0.5, 0.75]
    q = percentiles(held, columns, quartiles)
    kept = [c for c in columns if q[c] is not None]
    # imputed values move the quartiles: they count as the median
    filled = held.withColumns({c: F.coalesce(c, F.lit(q[c][1])) for c in kept})
    q = percentiles(filled, kept, quartiles)
    scaled = {c: (F.col(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0) for c in kept}
    return filled.withColumns(scaled), kept


def as_matrix(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def _moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (divisor n) of the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0)], "ss": [(x.T @ x).ravel()]})

    rows = df.select("x").mapInPandas(run, "n long, s array<double>, ss array<double>").collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = sum(r.n for r in rows)
    mean = np.sum([r.s for r in rows], axis=0) / n
    return n, mean, np.sum([r.ss for r in rows], axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)


def pca(df: DataFrame, components: int) -> DataFrame:
    """The leading principal components, at most min(features, rows - 1); the largest loading of each is positive."""
    n, mean, cov = _moments(df)
    k = max(1, min(components, len(mean), n - 1))
    _, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["x"] = list((np.stack(batch["x"].to_numpy()) - mean) @ axes)
            yield batch

    return df.mapInPandas(run, df.schema)


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # k x d x d whatever the shape
    kind: str
    log_likelihood: float = -math.inf
    n: int = 0

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) by row and cluster."""
        out = np.empty((len(x), len(self.weights)))
        plain = self.kind in ("diag", "spherical")
        for j, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            if plain:
                v = np.diag(c)
                form, half_log = ((x - m) ** 2 / v).sum(axis=1), 0.5 * np.log(v).sum()
            else:
                low = np.linalg.cholesky(c)
                z = np.linalg.solve(low, (x - m).T)
                form, half_log = (z * z).sum(axis=0), np.log(np.diag(low)).sum()
            out[:, j] = math.log(max(w, 1e-300)) - 0.5 * (len(m) * math.log(2 * math.pi) + form) - half_log
        return out

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k - 1 + {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]

    @property
    def bic(self) -> float:
        return self.parameters * math.log(max(self.n, 1)) - 2 * self.log_likelihood


def _squares(r: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """What a kind of covariance needs of the second moments: squares of each cluster, products of each, or of all rows."""
    if kind in ("diag", "spherical"):
        return r.T @ (x * x)
    if kind == "tied":
        return x.T @ x
    return np.stack([(x * share[:, None]).T @ x for share in r.T])


def _covariances(r: np.ndarray, means: np.ndarray, squares: np.ndarray, kind: str, ridge: float) -> np.ndarray:
    k, d = means.shape
    if kind in ("diag", "spherical"):
        v = squares / r[:, None] - means * means
        out = np.stack([np.diag(row) if kind == "diag" else np.eye(d) * row.mean() for row in v])
    elif kind == "tied":
        out = np.repeat(((squares - (means * r[:, None]).T @ means) / r.sum())[None], k, axis=0)
    else:
        out = squares / r[:, None, None] - means[:, :, None] * means[:, None, :]
    return out + ridge * np.eye(d)


def _pass(df: DataFrame, kind: str, weighers: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Of each model, sums over all rows of responsibilities, of rows and second moments by cluster, and of log likelihoods: one scan
    whatever the number of models."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [None] * len(weighers)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                for i, weigh in enumerate(weighers):
                    r, logs = weigh(x)
                    part = [r.sum(axis=0), r.T @ x, _squares(r, x, kind), float(logs.sum())]
                    totals[i] = part if totals[i] is None else [a + b for a, b in zip(totals[i], part, strict=True)]
        if weighers and totals[0] is not None:
            yield pd.DataFrame({"m": range(len(totals)), "r": [t[0] for t in totals], "s": [t[1].ravel() for t in totals], "ss": [t[2].ravel() for t in totals], "l": [t[3] for t in totals]})

    rows = df.select("x").mapInPandas(run, "m int, r array<double>, s array<double>, ss array<double>, l double").collect()
    out = []
    for i in range(len(weighers)):
        own = [row for row in rows if row.m == i]
        r = np.sum([row.r for row in own], axis=0)
        d = len(own[0].s) // len(r)
        shape = {"diag": (len(r), d), "spherical": (len(r), d), "tied": (d, d), "full": (len(r), d, d)}[kind]
        out.append((r, np.sum([row.s for row in own], axis=0).reshape(len(r), d), np.sum([row.ss for row in own], axis=0).reshape(shape), sum(row.l for row in own)))
    return out


def kmeans(df: DataFrame, k: int, seed: int = 0, starts: int = 10, turns: int = 50) -> tuple[np.ndarray, float]:
    """Centres and inertia: Spark's own k-means, the best of several starts."""
    if k == 1:
        n, mean, cov = _moments(df)
        return mean[None], float(n * np.trace(cov))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector("x").alias("features")).persist()
    try:
        fits = [KMeans(k=k, seed=seed + i, maxIter=turns).fit(rows) for i in range(starts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return np.array(best.clusterCenters()), float(best.summary.trainingCost)
    finally:
        rows.unpersist()


def mixture(df: DataFrame, k: int, kind: str = "diag", seed: int = 0, ridge: float = 1e-6, turns: int = 100, tolerance: float = 1e-3) -> Mixture:
    """Gaussian mixture by EM from k-means; stops when the mean log likelihood gains less than the tolerance."""
    return mixtures(df, [k], kind, seed, ridge, turns, tolerance)[k]


def mixtures(df: DataFrame, ks: list[int], kind: str = "diag", seed: int = 0, ridge: float = 1e-6, turns: int = 100, tolerance: float = 1e-3) -> dict[int, Mixture]:
    """Mixtures of all these numbers of clusters. In a turn one scan serves all that haven't stopped, so that there are as many scans as
    the slowest has turns. The matrix is held for them."""
    held = df.select("x").persist()
    try:
        n = held.count()
        if any(not 1 <= k <= n for k in ks):
            raise ValueError(f"k must lie between 1 and the {n} rows")
        return _fitted(held, n, ks, kind, seed, ridge, turns, tolerance)
    finally:
        held.unpersist()


def _nearest(centres: np.ndarray):
    def weigh(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.zeros((len(x), len(centres)))
        r[np.arange(len(x)), squares(x, centres).argmin(axis=1)] = 1.0
        return r, np.zeros(len(x))

    return weigh


def _expected(model: Mixture):
    def weigh(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = model.log_parts(x)
        top = logs.max(axis=1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return np.exp(logs - whole[:, None]), whole

    return weigh


def _fitted(df: DataFrame, n: int, ks: list[int], kind: str, seed: int, ridge: float, turns: int, tolerance: float) -> dict[int, Mixture]:
    def fitted(sums: tuple, likelihood: float) -> Mixture:
        r, s, second, _ = sums
        r = r + 10 * np.finfo(float).eps
        means = s / r[:, None]
        return Mixture(r / r.sum(), means, _covariances(r, means, second, kind, ridge), kind, likelihood, n)

    ks = sorted(set(ks))
    begun = _pass(df, kind, [_nearest(kmeans(df, k, seed, starts=1)[0]) for k in ks])
    models = {k: fitted(sums, -math.inf) for k, sums in zip(ks, begun, strict=True)}
    open_ = ks
    for _ in range(turns):
        if not open_:
            break
        going = []
        for k, sums in zip(open_, _pass(df, kind, [_expected(models[k]) for k in open_]), strict=True):
            gain, models[k].log_likelihood = sums[3] - models[k].log_likelihood, sums[3]
            if gain / n >= tolerance:
                models[k] = fitted(sums, sums[3])
                going.append(k)
        open_ = going
    return models


def select_by_bic(df: DataFrame, least: int, most: int, kind: str = "diag", seed: int = 0, ridge: float = 1e-6) -> tuple[Mixture, dict[int, float]]:
    """The mixture of the smallest BIC over numbers of clusters; of equals the smaller number."""
    held = df.select("x").persist()
    try:
        fits = mixtures(held, list(range(max(1, least), min(most, held.count()) + 1)), kind, seed, ridge)
    finally:
        held.unpersist()
    best = min(fits, key=lambda k: (fits[k].bic, k), default=None)
    return fits.get(best), {k: m.bic for k, m in fits.items()}


def predict(df: DataFrame, model: Mixture | np.ndarray, probabilities: bool = False) -> DataFrame:
    """cluster_id of each row under a mixture or k-means centres, and the probabilities under a mixture."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, 1))
            if isinstance(model, Mixture):
                logs = model.log_parts(x) if len(batch) else np.zeros((0, len(model.weights)))
                p = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(batch) else logs
                p = p / p.sum(axis=1, keepdims=True) if len(batch) else p
                batch["cluster_id"] = p.argmax(axis=1)
                if probabilities:
                    batch["p"] = list(p)
            else:
                batch["cluster_id"] = squares(x, model).argmin(axis=1) if len(batch) else []
            yield batch.drop(columns="x")

    keep = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "x")
    if probabilities and not isinstance(model, Mixture):
        raise ValueError("only a mixture has probabilities")
    return df.mapInPandas(run, keep + ", cluster_id int" + ", p array<double>" * probabilities)
