"""Exact top-k inner products by an impact-ordered index, score at a time.

Components become integers floor(SCALE * x). A block of candidates is an inverted index: for each dimension and each of a
few quantised magnitudes (impacts) a segment of postings, the candidates whose component has that impact, with its value.
Segments are processed by descending impact, those of all dimensions for one before the next: one product of a matrix that
holds only these adds them to the partial scores of the queries that are still open. After each impact a bound holds what unread postings can add to a candidate's
score: the smaller of largest unread magnitude times the query's L1 norm and the product of the query's norm and the norm
of the candidate's unread part. A query is closed, and reads no further postings, only when that bound proves that few
candidates can still be among its k best; these are scored exactly. A task carries the k best of each query from block to
block, so that the last of them closes most queries early in a later block; the k best of those of all tasks are the answer.

Vectors that are null or hold null or non-finite components take no part; vectors meet only others of their length. Blocks whose
partial scores doubles can't hold exactly are scored with integers of any size, every candidate. A repeated query id asks once, with its smallest vector; repeated candidates count as
often as they are there; rows with the query's own id are never its candidates. Rows with null ids take no part. Ties go to
the smaller id. Scores beyond 64 bits count as the nearest that fits. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, written

SCALE = 1024
#: Vectors in a packed block, candidate blocks that a copy of the queries meets, quantised impacts, queries at a time.
BLOCK, BLOCKS_PER_COPY, IMPACTS, QUERIES = 2048, 128, 8, 256
#: Copies of the queries for each core, if the blocks are few; query blocks that a task holds.
COPIES_PER_CORE, QUERY_BLOCKS = 4, 64
#: A query is closed when at most so many times k candidates can still be its members.
ENOUGH = 6
#: Sums below are exact in doubles.
WIDE = 2.0**52


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite)


def whole_of(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def integer_of(x: float) -> int:
    """floor(SCALE * x), exactly; from 2^53 on doubles are whole themselves."""
    return math.floor(SCALE * x) if abs(x) < 2.0**53 else SCALE * int(x)


def _integers(whole: np.ndarray, vectors: np.ndarray | None) -> list[list[int]]:
    return [[*map(int, row)] for row in whole.tolist()] if vectors is None else [[*map(integer_of, row)] for row in vectors.tolist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as blocks of at most BLOCK of the same length: (dims, ids, whole), ids and components as bytes."""
    waiting: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(dims: int, ids: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary())], ["dims", "ids", "whole"])

    for batch in batches:
        own, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
        lengths = lists.value_lengths().to_numpy()
        ends, flat = np.cumsum(lengths, dtype=np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for dims in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dims)
            ids, whole = own[at], flat[(ends[at] - dims)[:, None] + np.arange(dims)]
            if dims in waiting:
                ids, whole = (np.concatenate(both) for both in zip(waiting[dims], (ids, whole), strict=True))
            full = len(ids) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                yield block(dims, ids[i : i + BLOCK], whole[i : i + BLOCK])
            waiting[dims] = ids[full:], whole[full:]
    for dims, (ids, whole) in waiting.items():
        if len(ids):
            yield block(dims, ids, whole)


def pack(vectors: DataFrame) -> DataFrame:
    """The vectors as blocks with a key, written to the shared folder."""
    blocks = vectors.select("vec_id", "embedding").mapInArrow(_packed, "dims int, ids binary, whole binary")
    return written(blocks.withColumn("block", F.xxhash64("dims", "ids", "whole")), "topk-blocks")


class Block:
    """An impact-ordered inverted index of a block of candidates."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, vectors: np.ndarray | None = None):
        """`whole` holds the integers; `vectors` what they were made of, for those that doubles can't hold."""
        self.ids, self.whole, self.vectors = ids, whole, vectors
        self.impacts: list[tuple[np.ndarray, int, float, np.ndarray]] = []
        self.read = 0  # postings processed so far, one for each query that a posting is added for
        size = np.abs(whole)
        self.largest = float(size.max(initial=0.0))
        if self.largest >= WIDE:
            return
        # impact i holds magnitudes in (edge[i - 1], edge[i]]; quantiles of the block, so that segments are alike in size
        edges = np.unique(np.quantile(size, np.linspace(0, 1, IMPACTS + 1))) if size.size else np.array([0.0])
        impact = np.maximum(np.searchsorted(edges, size), 1)
        for i in range(len(edges) - 1 if len(edges) > 1 else 1, 0, -1):
            here = (impact == i) & (whole != 0)  # zeros add nothing: they have no posting
            rest = np.where(impact < i, size, 0.0)
            self.impacts.append((np.where(here, whole, 0.0), int(here.sum()), float(rest.max(initial=0.0)), np.sqrt((rest * rest).sum(axis=1))))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, vectors: np.ndarray | None = None, bars: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """(query_id, vec_id, score) of each query's k best in this block, ties to smaller ids. A query with a bar, the least of k
        scores that it has elsewhere, needs none below it."""
        bars = np.full(len(queries), -np.inf) if bars is None else bars
        if not len(self.ids) or not len(queries):
            return
        largest = float(np.abs(queries).max(initial=0.0))
        # partial sums in doubles may not be exact: every candidate is a possible member
        if max(self.largest, largest) >= WIDE or self.largest * largest * max(1, queries.shape[1]) >= WIDE:
            yield from self._exact_wide(query_ids, _integers(queries, vectors), k)
            return
        for i in range(0, len(queries), QUERIES):
            yield from self._at_a_time(query_ids[i : i + QUERIES], queries[i : i + QUERIES], k, bars[i : i + QUERIES])

    def _at_a_time(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[int, int, int]]:
        open_ = np.arange(len(queries))
        partial = np.zeros((len(self.ids), len(queries)))  # a row a candidate, a column an open query
        own = self.ids[:, None] == query_ids
        l1, l2 = np.abs(queries).sum(axis=1), np.sqrt((queries * queries).sum(axis=1))
        keep = min(k, len(self.ids))
        for postings, n, largest, norms in self.impacts:
            asked = queries[open_]
            partial += postings @ asked.T
            self.read += n * len(open_)
            if largest:
                rest = np.minimum(largest * l1[open_], norms[:, None] * l2[open_]) * (1 + 1e-9) + 1e-6
            else:
                rest = np.zeros((1, len(open_)))
            least = bars[open_]
            new = np.flatnonzero(np.isneginf(least))  # without a bar: the k-th best of what is certain here
            if len(new):
                floor = np.where(own[:, new], -np.inf, partial[:, new] - rest[:, new])
                least[new] = np.partition(floor, len(self.ids) - keep, axis=0)[len(self.ids) - keep]
            possible = (partial + rest >= least) & ~own
            closed = np.count_nonzero(possible, axis=0) <= ENOUGH * k if largest else np.ones(len(open_), bool)
            for j in np.flatnonzero(closed & possible.any(axis=0)).tolist():
                members = np.flatnonzero(possible[:, j])
                scores = self.whole[members] @ asked[j]
                members, scores = members[scores >= bars[open_[j]]], scores[scores >= bars[open_[j]]]
                for m in np.lexsort((self.ids[members], -scores))[:k]:
                    yield int(query_ids[open_[j]]), int(self.ids[members[m]]), int(scores[m])
            if closed.all():
                break
            if closed.any():
                open_, partial, own = open_[~closed], partial[:, ~closed], own[:, ~closed]

    def _exact_wide(self, query_ids: np.ndarray, queries: list[list[int]], k: int) -> Iterator[tuple[int, int, int]]:
        rows = list(zip(self.ids.tolist(), _integers(self.whole, self.vectors), strict=True))
        for query_id, whole in zip(query_ids.tolist(), queries, strict=True):
            cut = lambda score: max(-(2**63), min(2**63 - 1, score))
            scored = sorted((-cut(sum(a * b for a, b in zip(whole, row, strict=True))), i) for i, row in rows if i != query_id)
            for score, vec_id in scored[:k]:
                yield query_id, vec_id, -score


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: OrderedDict[int, Block] = OrderedDict()
        # of each query block: where its queries stand, their bars, their k best so far as (-score, vec_id)
        held: dict[bytes, tuple[dict[int, int], np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                if row["block"] not in indexes:
                    ids = np.frombuffer(row["ids"], np.int64)
                    vectors = np.frombuffer(row["whole"], np.float64).reshape(len(ids), dims)
                    indexes[row["block"]] = Block(ids, whole_of(vectors), vectors)
                    if len(indexes) > 4:
                        indexes.popitem(last=False)
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                asked = np.frombuffer(row["queries"], np.float64).reshape(len(query_ids), dims)
                if row["query_ids"] not in held:
                    held[row["query_ids"]] = {q: i for i, q in enumerate(query_ids.tolist())}, np.full(len(query_ids), -np.inf), {}
                places, bars, best = held[row["query_ids"]]
                fresh: dict[int, list[tuple[int, int]]] = {}
                for query_id, vec_id, score in indexes[row["block"]].best(query_ids, whole_of(asked), k, asked, bars):
                    fresh.setdefault(query_id, []).append((-score, vec_id))
                for query_id, more in fresh.items():
                    best[query_id] = sorted(best.get(query_id, []) + more)[:k]
                    if len(best[query_id]) == k:
                        bars[places[query_id]] = -best[query_id][-1][0]
        for _, _, best in held.values():
            found = [(query_id, vec_id, -cost) for query_id, own in best.items() for cost, vec_id in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where `is_query` is true.

    Query blocks are copied once for every BLOCKS_PER_COPY candidate blocks (or for each share of them that keeps the
    cores busy) and joined with these by equal keys: a stated query set against all rows, in blocks. Both sides are dealt
    to the executors, and a task holds at most about QUERY_BLOCKS query blocks: the planner takes the copies for no more than the
    queries themselves and would broadcast them all.
    """
    rows = usable(vectors)
    candidates = pack(rows)
    queries = pack(rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n = candidates.count()
    copies = max(1, min(n, max(COPIES_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCKS_PER_COPY))))
    groups = max(1, -(-queries.count() // QUERY_BLOCKS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    shares = candidates.select("dims", "block", "ids", "whole", F.pmod("block", F.lit(copies)).alias("share"), every(groups).alias("group"))
    asked = queries.select("dims", F.col("ids").alias("query_ids"), F.col("whole").alias("queries"), every(copies).alias("share"), F.pmod("block", F.lit(groups)).alias("group"))
    keys = ["share", "group", "dims"]
    # dealt to an explicit number of partitions: by their few bytes adaptive execution would join them
    dealt = [df.repartition(copies * groups, *keys).hint("merge") for df in (shares, asked)]
    pairs = dealt[0].join(dealt[1], keys).select("dims", "block", "ids", "whole", "query_ids", "queries")
    found = pairs.mapInArrow(_pairs(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 10"""
