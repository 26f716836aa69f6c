"""A quality classifier as a sparse rule ensemble.

Statistics of a text are Spark column expressions. Small trees are grown on random halves of a bounded sample of labelled
rows; each path from a root to a node is a rule, a conjunction of comparisons. Lasso logistic regression weighs the rules
and leaves few; these compile to one Spark column, so that scoring runs in the JVM over every whole text.

Null texts count as empty; every statistic is defined for them. Without labels, or with labels of one kind, the score is
a constant. Labels repeated for a document count once, as the smaller; a null label is none. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, pick

#: Labelled rows to learn from, about so many, chosen by a hash of the id.
TRAIN_ROWS = 16_000
TREES, DEPTH, LEAST = 24, 3, 12
LASSO = 0.002


def stat_columns(text: Column) -> dict[str, Column]:
    """Counts that the statistics are made of."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    return {
        "chars": F.length(t),
        "letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "uppers": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "digits": F.length(F.regexp_replace(t, r"[^0-9]+", "")),
        "blanks": F.length(F.regexp_replace(t, r"[^\s]+", "")),
        "marks": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'()-]+", "")),
        "bangs": F.length(F.regexp_replace(t, "[^!]+", "")),
        "bars": F.length(F.regexp_replace(t, r"[^|]+", "")),
        "words": words,
        "lines": F.split(t, "\n"),
    }


def ratio(over: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(over.cast("double"), under.cast("double")), F.lit(0.0))


STATS = ("log_words", "upper_share", "digit_share", "letter_share", "mark_share", "bang_share", "bar_share", "word_length", "distinct_words", "repeated_next", "distinct_lines", "line_length", "stops")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with the statistics of it."""
    keep = [c for c in docs.columns if c != text]
    counts = docs.select(*keep, *[c.alias(f"_{n}") for n, c in stat_columns(F.col(text)).items()])
    c = {n: F.col(f"_{n}") for n in ("chars", "letters", "uppers", "digits", "blanks", "marks", "bangs", "bars", "words", "lines")}
    n_words = F.size(c["words"])
    inked = c["chars"] - c["blanks"]
    repeats = F.size(F.filter(c["words"], lambda w, i: F.equal_null(w, F.get(c["words"], i + 1))))
    ends = F.size(F.filter(c["words"], lambda w: F.endswith(w, F.lit("."))))
    return counts.select(
        *keep,
        F.log1p(n_words.cast("double")).alias("log_words"),
        ratio(c["uppers"], c["letters"]).alias("upper_share"),
        ratio(c["digits"], inked).alias("digit_share"),
        ratio(c["letters"], inked).alias("letter_share"),
        ratio(c["marks"], inked).alias("mark_share"),
        ratio(c["bangs"], inked).alias("bang_share"),
        ratio(c["bars"], inked).alias("bar_share"),
        ratio(inked, n_words).alias("word_length"),
        ratio(F.size(F.array_distinct(c["words"])), n_words).alias("distinct_words"),
        ratio(repeats, n_words).alias("repeated_next"),
        ratio(F.size(F.array_distinct(c["lines"])), F.size(c["lines"])).alias("distinct_lines"),
        ratio(n_words, F.size(c["lines"])).alias("line_length"),
        ratio(ends, n_words).alias("stops"),
    )


#: A comparison: statistic, whether it must be at most the bound (else above it), the bound.
Test = tuple[int, bool, float]


@dataclass
class Model:
    intercept: float
    rules: list[tuple[tuple[Test, ...], float]]

    def column(self) -> Column:
        """The score as one Spark column over the columns of with_stats()."""
        logit = F.lit(float(self.intercept))
        for tests, weight in self.rules:
            holds = F.lit(True)
            for stat, at_most, bound in tests:
                value = F.col(STATS[stat])
                holds = holds & ((value <= bound) if at_most else (value > bound))
            logit = logit + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        logit = np.full(len(x), self.intercept)
        for tests, weight in self.rules:
            logit += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-logit))


def _holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for stat, at_most, bound in tests:
        held &= (x[:, stat] <= bound) if at_most else (x[:, stat] > bound)
    return held


def _best_split(x: np.ndarray, y: np.ndarray, stats: np.ndarray) -> tuple[int, float] | None:
    """The split by one of `stats` that lowers the Gini impurity most, among cuts halfway between quantiles."""
    best, found = 1e-9, None
    n, whole = len(y), y.mean() * (1 - y.mean())
    for stat in stats:
        values = np.unique(np.quantile(x[:, stat], np.linspace(0, 1, 33)))
        for low, high in zip(values[:-1], values[1:], strict=True):
            cut = (low + high) / 2
            left = x[:, stat] <= cut
            k = int(left.sum())
            if k < LEAST or n - k < LEAST:
                continue
            p, q = y[left].mean(), y[~left].mean()
            gain = whole - (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
            if gain > best:
                best, found = gain, (int(stat), float(cut))
    return found


def _paths(x: np.ndarray, y: np.ndarray, depth: int, path: tuple[Test, ...], rng: np.random.Generator) -> list[tuple[Test, ...]]:
    """Rules of all nodes of a tree under `path`."""
    out = [path] if path else []
    if depth == 0 or y.min() == y.max():
        return out
    stats = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
    split = _best_split(x, y, stats)
    if split is None:
        return out
    stat, cut = split
    left = x[:, stat] <= cut
    return out + _paths(x[left], y[left], depth - 1, (*path, (stat, True, cut)), rng) + _paths(x[~left], y[~left], depth - 1, (*path, (stat, False, cut)), rng)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient steps."""
    n, d = z.shape
    design = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / (np.linalg.norm(design, 2) ** 2 + 1e-9)
    w = v = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-np.clip(design @ v, -40, 40))) - y) / n
        step = v - rate * slope
        step[1:] = np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = step + (t - 1) / t_next * (step - w), step, t_next
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """The rule ensemble of a sample: x by STATS, y 0 or 1."""
    if len(y) == 0:
        return Model(0.0, [])
    if y.min() == y.max():
        return Model(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    rng = np.random.default_rng(seed)
    rules: dict[tuple[Test, ...], None] = {}
    for _ in range(TREES):
        rows = rng.random(len(y)) < 0.5
        if rows.sum() and y[rows].min() != y[rows].max():
            rules |= dict.fromkeys(_paths(x[rows], y[rows], DEPTH, (), rng))
    kept, seen = [], set()
    for rule in rules:
        held = _holds(x, rule)
        key = held.tobytes()
        if key not in seen and held.any() and not held.all():
            seen.add(key)
            kept.append((rule, held))
    if not kept:
        return Model(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    intercept, weights = lasso_logistic(np.array([h for _, h in kept], float).T, y.astype(float), LASSO)
    return Model(intercept, [(rule, float(w)) for (rule, _), w in zip(kept, weights, strict=True) if abs(w) > 1e-6])


def sample(docs: DataFrame, labels: DataFrame, label: str, learns: Column, train_rows: int) -> DataFrame:
    """About `train_rows` labelled rows of `docs` (doc_id, text) where `learns` is true, with their label as y.

    The sampled labels, whose number the parameter bounds, are broadcast; no text is shuffled.
    """
    known = pick(labels, doc_id="long", **{label: "int"}).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learns)
    n = known.count()
    share = min(1.0, train_rows / max(1, n))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"))
    return docs.join(F.broadcast(known), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learns: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled documents (doc_id, text)."""
    found = with_stats(sample(docs, labels, "quality", learns, train_rows))
    # a row for each sampled id, however often the id is repeated; combined before the shuffle
    rows = found.groupBy("doc_id").agg(F.min(F.struct(*STATS, "y")).alias("row")).select("doc_id", "row.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([[r[s] for s in STATS] for r in rows], float).reshape(len(rows), len(STATS))
    return fit(x, np.array([r.y for r in rows], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` without its text, with score (0 to 1) and predicted (0 or 1)."""
    keep = [c for c in docs.columns if c != "text"]
    scored = with_stats(docs).select(*keep, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, with all their columns, whatever their names."""
    rows = docs.select(F.struct(*own_columns(docs)).alias("_row"), F.col("text").cast("string").alias("text"))
    scored = score(rows, model)
    # not a filter, which would be pushed below the statistics and repeat them for each rule
    passed = scored.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("predicted"))))
    return passed.select("_row.*")
