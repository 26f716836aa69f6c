"""Ward's agglomeration of many rows, exactly: clusters that are each other's nearest merge at once.

Ward's distance is reducible: a merge brings no cluster nearer to a third than its parts were. So all mutually nearest pairs may merge in one
turn and the merges are those of one pair at a time, and only clusters whose nearest one has merged look for a new one. Nearest
clusters are found by blocks: clusters are packed by their two widest axes into blocks of neighbours, each looks through its
own block first and then through those whose box isn't provably farther than the best found.

Once a group has few clusters left, one task merges the rest; the merges are the same. The number of turns is about the logarithm
of the number of clusters for scattered rows, but as many as there are clusters where distances grow along a chain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dropped, settled
from .smoothing import connected

#: Clusters of a group whose distances one task holds at the end (32 MB); it changes no result.
TASK_ROWS = 2000
#: Rows of a block, and how many blocks there are at most, beyond which blocks get larger: their boxes are broadcast.
BLOCK_ROWS, MOST_BLOCKS = 512, 20_000


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, to within rounding, without an array of differences."""
    middle = y.mean(axis=0) if len(y) else 0.0
    x, y = x - middle, y - middle
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None], 0.0)


def merges_of(x: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All merges of Ward's method as (height, one row, another), rows standing for the clusters. Nearest-neighbour chains."""
    n = len(x)
    size, alive = np.ones(n) if sizes is None else sizes.astype(float), np.ones(n, bool)
    d = squares(x, x) * (2 * size[:, None] * size[None] / (size[:, None] + size[None])) if n else np.zeros((0, 0))
    np.fill_diagonal(d, np.inf)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        b = int(np.where(alive, d[a], np.inf).argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[a, b]), a, b))
            others = alive.copy()
            others[[a, b]] = False
            t = size[a] + size[b] + size[others]
            d[a, others] = d[others, a] = ((size[a] + size[others]) * d[a, others] + (size[b] + size[others]) * d[b, others] - size[others] * d[a, b]) / t
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    return merges


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of Ward's agglomeration of the rows into k clusters, numbered by first row, in memory."""
    n = len(x)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for _, a, b in sorted(merges_of(x), key=lambda m: m[0])[: n - max(1, min(k, n))]:
        parent[root(b)] = root(a)
    names: dict[int, int] = {}
    return np.array([names.setdefault(root(i), len(names)) for i in range(n)], int)


def nearest(ids: np.ndarray, size: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other_size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the place of its nearest other and Ward's distance to it; rows without one are left out: (rows, places, distances).
    Distances are the same from either side, and equal ones go by the smaller, then the larger id of the pair."""
    rows, places, distances = [], [], []
    step = max(1, (4 << 20) // max(1, len(other)))
    for begin in range(0, len(x), step):
        part = slice(begin, begin + step)
        weight = 2 * size[part, None] * other_size[None] / (size[part, None] + other_size[None])
        rough = squares(x[part], other)
        scale = rough.max(initial=0.0) * 1e-12
        rough = (rough + scale) * weight
        rough[ids[part, None] == other_ids[None]] = np.inf
        i, j = np.nonzero(rough <= rough.min(axis=1, initial=np.inf, keepdims=True) * (1 + 1e-9) + 2 * scale * weight)
        there = ids[begin + i] != other_ids[j]
        i, j = i[there], j[there]
        exact = ((x[begin + i] - other[j]) ** 2).sum(axis=1) * weight[i, j]
        a, b = ids[begin + i], other_ids[j]
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        rows.append(begin + i[first])
        places.append(j[first])
        distances.append(exact[first])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(rows, int), join(places, int), join(distances, float)


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _axes(state: DataFrame) -> np.ndarray:
    """The two widest axes of the rows."""
    from .model import _moments

    _, _, cov = _moments(state)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :2]


def _packed(state: DataFrame, kind: str) -> tuple[DataFrame, list]:
    """The clusters with their block, and the boxes of all blocks. Slabs are cut along one axis, blocks within along the other."""
    n, axes = state.count(), _axes(state)
    block = max(BLOCK_ROWS, math.ceil(n / MOST_BLOCKS))
    slabs = max(1, math.ceil(math.sqrt(n / block)))

    along = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, axis.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for axis in (axes[:, 0], axes[:, -1])]
    ranged = state.select("*", along[0].alias("p1"), along[1].alias("p2")).repartitionByRange(slabs, "g", "p1", "id")
    placed = ranged.sortWithinPartitions("g", "p2", "id").withColumn("m", F.monotonically_increasing_id())
    number = F.shiftleft(F.shiftright("m", 33), 33) + F.floor(F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) / block)
    rows = settled(placed.select("g", "id", "size", "x", "nn", "d", number.alias("block")))

    def box(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _stack(pdf)
        return pd.DataFrame({"g": pd.Series([key[0]], dtype=object), "block": [key[1]], "low": [x.min(axis=0)], "high": [x.max(axis=0)], "least": [pdf["size"].min()]})

    boxes = rows.groupBy("g", "block").applyInPandas(box, f"g {kind}, block long, low array<double>, high array<double>, least double")
    return rows, boxes.toPandas()


def _searched(queries: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """(id, nn, d) of queries (g, block, id, size, x) over the members of the block that each names."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = right["id"].to_numpy()
        at, found, d = nearest(left["id"].to_numpy(), left["size"].to_numpy(), _stack(left), ids, right["size"].to_numpy(), _stack(right)) if len(left) and len(right) else ([], [], [])
        return pd.DataFrame({"id": left["id"].to_numpy()[at], "nn": ids[found], "d": d}) if len(at) else pd.DataFrame({"id": pd.Series(dtype="int64"), "nn": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})

    members = rows.select("g", "block", "id", "size", "x").groupBy("g", "block")
    return queries.groupBy("g", "block").cogroup(members).applyInPandas(run, "id long, nn long, d double")


def _with_nearest(rows: DataFrame, boxes: pd.DataFrame, kind: str) -> DataFrame:
    """(g, id, size, x, nn, d) where nn is filled in for those that lack it."""
    asks = rows.filter("nn is null").select("g", "block", "id", "size", "x")
    own = settled(_searched(asks, rows, kind))
    shared = rows.sparkSession.sparkContext.broadcast({g: (part["block"].to_numpy(), np.stack(part["low"]), np.stack(part["high"]), part["least"].to_numpy()) for g, part in boxes.groupby("g")})

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, out = _stack(batch), []
            for i, (g, block, size, best) in enumerate(zip(batch["g"], batch["block"], batch["size"], batch["best"], strict=True)):
                blocks, low, high, least = shared.value[g]
                outside = np.maximum(np.maximum(low - x[i], x[i] - high), 0.0)
                bound = (outside * outside).sum(axis=1) * (2 * size * least / (size + least))
                open_ = (blocks != block) & ~(bound * (1 - 1e-9) > (np.inf if best != best else best))
                out.append(blocks[open_])
            counts = [len(o) for o in out]
            yield batch.loc[batch.index.repeat(counts), ["g", "id", "size", "x"]].assign(block=np.concatenate(out) if out else np.zeros(0, int))

    seen = asks.join(own.select("id", F.col("d").alias("best")), "id", "left").select("g", "block", "id", "size", "x", "best")
    wider = seen.mapInPandas(further, f"g {kind}, id long, size double, x array<double>, block long")
    order = F.struct("d", F.least("id", "nn"), F.greatest("id", "nn"))
    best = own.unionByName(_searched(wider, rows, kind)).groupBy("id").agg(F.min_by(F.struct("nn", "d"), order).alias("best"))
    joined = rows.join(best, "id", "left")
    return settled(joined.select("g", "id", "size", "x", F.coalesce("nn", "best.nn").alias("nn"), F.coalesce("d", "best.d").alias("d")))


def _merged(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merges (g, a, b, height) of mutually nearest clusters, and the clusters after them; nn is null where it must be found."""
    other = state.select(F.col("id").alias("nn"), F.col("nn").alias("back"), F.col("size").alias("o_size"), F.col("x").alias("o_x"))
    total = F.col("size") + F.col("o_size")
    mean = F.zip_with("x", "o_x", lambda a, b: (a * F.col("size") + b * F.col("o_size")) / total)
    pairs = settled(state.join(other, "nn").filter("back = id and id < nn").select("g", "id", "nn", total.alias("total"), mean.alias("mean"), "d"))
    none = F.lit(None)
    made = pairs.select("g", "id", F.col("total").alias("size"), F.col("mean").alias("x"), none.cast("long").alias("nn"), none.cast("double").alias("d"))
    gone = pairs.select(F.explode(F.array("id", "nn")).alias("gone"))
    rest = state.join(gone, state["id"] == gone["gone"], "left_anti")
    lost = gone.select(F.col("gone").alias("lost"))
    rest = rest.join(lost, rest["nn"] == lost["lost"], "left")
    kept = F.col("lost").isNull()
    rest = rest.select("g", "id", "size", "x", F.when(kept, F.col("nn")).alias("nn"), F.when(kept, F.col("d")).alias("d"))
    return pairs.select("g", F.col("id").alias("a"), F.col("nn").alias("b"), F.col("d").alias("height")), made.unionByName(rest)


def _finished(state: DataFrame, kind: str) -> DataFrame:
    """The merges of groups of few clusters, each group in one task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, found = pdf["id"].to_numpy(), merges_of(_stack(pdf), pdf["size"].to_numpy())
        height, a, b = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"g": pd.Series([key[0]] * len(found), dtype=object), "a": ids[list(a)] if found else [], "b": ids[list(b)] if found else [], "height": height, "step": range(len(found))})

    return state.select("g", "id", "size", "x").groupBy("g").applyInPandas(run, f"g {kind}, a long, b long, height double, step long")


def dendrogram(points: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """All merges of Ward's method within each group: (g, a, b, height, turn, step) from (g, id, size, x), where clusters go by the
    smallest id of their members or, in the last turn, by any; turn and step order merges of equal height."""
    kind, turn, found = dict(points.dtypes)["g"], 0, []
    none = F.lit(None)
    state = settled(points.select("g", "id", F.col("size").cast("double").alias("size"), "x", none.cast("long").alias("nn"), none.cast("double").alias("d")))
    while True:
        sizes = settled(state.groupBy("g").agg(F.count("*").alias("n")))
        few = state.join(sizes.filter(F.col("n") <= task_rows).select("g"), "g", "left_semi")
        found.append(settled(_finished(few, kind).select("g", "a", "b", "height", F.lit(turn).alias("turn"), "step")))
        if sizes.filter(F.col("n") > task_rows).isEmpty():
            break
        rows, boxes = _packed(state.join(sizes.filter(F.col("n") > task_rows).select("g"), "g", "left_semi"), kind)
        merges, after = _merged(_with_nearest(rows, boxes, kind))
        found.append(settled(merges.select("g", "a", "b", "height", F.lit(turn).alias("turn"), F.lit(0).cast("long").alias("step"))))
        before, state, turn = state, settled(after), turn + 1
        dropped(before, rows, sizes)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def agglomerate(df: DataFrame, keys: list[str], k: int, group: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """cluster_id by Ward's method, of all rows or within each group, numbered by first row in the order of the keys; at most k
    clusters. Rows that are alike are one from the start and never told apart. Rows without `x` are in no cluster."""
    rows = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.struct(*keys).alias("key"), "x").filter("x is not null")
    rows = settled(rows.orderBy("key").withColumn("id", F.monotonically_increasing_id()))
    points = settled(rows.groupBy("g", "x").agg(F.min("id").alias("id"), F.count("*").alias("size")))
    merges = dendrogram(points, task_rows)
    top = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("height"), F.desc("turn"), F.desc("step")))
    cut = merges.withColumn("top", top).filter(F.col("top") < max(1, k)).select("a", "b")
    links = merges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(cut.select(F.col("a").alias("u"), F.col("b").alias("v")), ["u", "v"], "left_anti")
    regions = connected(links).withColumnRenamed("node", "id")
    whole = points.join(regions, "id", "left").select("g", "x", F.coalesce("region", "id").alias("region"))
    names = whole.select("g", "region").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy("g").orderBy("region")) - 1)
    return rows.join(whole.join(names, ["g", "region"]), ["g", "x"]).select("key.*", "cluster_id")
