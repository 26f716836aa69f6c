"""Exact percentiles of many columns by radix selection: counts of leading bits narrow each order statistic down.

A double's bits, with the sign turned around, order as its values do. Each pass over the rows counts, for every order statistic that
is asked for, the next BITS bits of the values that begin as it does; all columns share the pass, tasks send counts only.
Once few values are left that begin alike, one more pass takes them out. No column is sorted and no task sees one whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 10
#: So many values that begin alike are taken out and sorted.
FEW = 4096


@dataclass(frozen=True)
class Wanted:
    """An order statistic: of a column's values whose first `depth` bits are `prefix`, that of rank `rank`; there are `size`."""

    column: int
    asked: int
    rank: int
    size: int
    prefix: int = 0
    depth: int = 0


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that order as the values do, nan last."""
    raw = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63))).view(np.uint64)


def value_of(bits: int) -> float:
    raw = np.array([bits], np.uint64)
    return float(np.where(raw >> np.uint64(63), raw ^ np.uint64(1 << 63), ~raw).view(np.float64)[0])


def _like(bits: np.ndarray, w: Wanted) -> np.ndarray:
    return bits if w.depth == 0 else bits[bits >> np.uint64(64 - w.depth) == np.uint64(w.prefix)]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [ordered_bits(np.asarray(column.drop_null())) for column in batch.columns]


def _narrowed(rows: DataFrame, open_: list[Wanted]) -> list[Wanted]:
    """Each with BITS more bits."""
    groups = sorted({(w.column, w.prefix, w.depth): w for w in open_}.values(), key=lambda w: (w.column, w.prefix))
    step = min(BITS, 64 - open_[0].depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(groups), 1 << step), np.int64)
        for batch in batches:
            bits = _columns(batch)
            for i, w in enumerate(groups):
                part = _like(bits[w.column], w) >> np.uint64(64 - w.depth - step)
                counts[i] += np.bincount((part & np.uint64((1 << step) - 1)).astype(np.int64), minlength=1 << step)
        g, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[g, b])], ["g", "b", "n"])

    found = {}
    for r in rows.mapInArrow(run, "g int, b int, n long").groupBy("g", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        found.setdefault(r.g, {})[r.b] = r.n
    place = {(w.column, w.prefix): i for i, w in enumerate(groups)}
    out = []
    for w in open_:
        left = w.rank
        for b, n in sorted(found[place[w.column, w.prefix]].items()):
            if left < n:
                out.append(replace(w, rank=left, size=n, prefix=w.prefix << step | b, depth=w.depth + step))
                break
            left -= n
    return out


def _taken(rows: DataFrame, closed: list[Wanted]) -> dict[tuple[int, int], float]:
    groups = sorted({(w.column, w.prefix, w.depth): w for w in closed}.values(), key=lambda w: (w.column, w.prefix))
    place = {(w.column, w.prefix, w.depth): i for i, w in enumerate(groups)}
    ranks: dict[int, list[tuple[int, int]]] = {}
    for w in closed:
        ranks.setdefault(place[w.column, w.prefix, w.depth], []).append((w.asked, w.rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _columns(batch)
            parts = [_like(bits[w.column], w) for w in groups]
            g = np.repeat(np.arange(len(groups), dtype=np.int32), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.concatenate(parts).view(np.int64))], ["g", "bits"])

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(pdf["bits"].to_numpy().view(np.uint64))
        w = groups[key[0]]
        asked = ranks[key[0]]
        return pd.DataFrame({"c": [w.column] * len(asked), "asked": [a for a, _ in asked], "v": [value_of(values[r]) for _, r in asked]})

    return {(r.c, r.asked): r.v for r in rows.mapInArrow(run, "g int, bits long").groupBy("g").applyInPandas(pick, "c int, asked int, v double").collect()}


def order_statistics(rows: DataFrame, ranks: list[list[int]], sizes: list[int], few: int = FEW) -> list[dict[int, float]]:
    """For each column of `rows` (doubles) its values of the given ranks, from 0, among its `sizes` values that aren't null."""
    rows = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
    open_ = [Wanted(i, rank, rank, sizes[i]) for i, own in enumerate(ranks) for rank in dict.fromkeys(own)]
    closed, out = [], [{} for _ in ranks]
    while open_:
        closed += [w for w in open_ if w.size <= few]
        whole = [w for w in open_ if w.size > few and w.depth == 64]
        for w in whole:
            out[w.column][w.asked] = value_of(w.prefix)
        open_ = [w for w in open_ if w.size > few and w.depth < 64]
        if open_:
            open_ = _narrowed(rows, open_)
    for (column, asked), value in (_taken(rows, closed) if closed else {}).items():
        out[column][asked] = value
    return out


def percentiles(df: DataFrame, columns: list[str], at: list[float], few: int = FEW) -> dict[str, list[float] | None]:
    """Of each column its percentiles, as Spark's percentile() has them: linear between two values. None for a column without a value.
    `df` is read a few times: it should be a table."""
    if not columns:
        return {}
    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).toDF(*[f"_{i}" for i in range(len(columns))])
    sizes = list(rows.agg(*[F.count(f"_{i}") for i in range(len(columns))]).first())
    ranks = [[f((n - 1) * q) for q in at for f in (math.floor, math.ceil)] if n else [] for n in sizes]
    found = order_statistics(rows, ranks, sizes, few)

    def between(values: dict[int, float], place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        if low == high or values[low] == values[high]:
            return values[low]
        return (high - place) * values[low] + (place - low) * values[high]

    return {c: [between(found[i], (sizes[i] - 1) * q) for q in at] if sizes[i] else None for i, c in enumerate(columns)}
