"""Connected parts of graphs, and smoothing of labels over a graph by iterated conditional modes in row order.

A sweep visits the nodes in row order; each takes the label that is cheapest given its neighbours, of which the earlier ones have
been visited already. Parts are told apart by targets and swept whole, each in one task, which reads its edges once and numbers
them itself. Only parts of too many rows are cut into blocks of neighbouring rows. A block may take its next sweep when its
earlier neighbour blocks have taken it and its later ones the one before, so that blocks apart from each other are swept at
once, several sweeps are under way in one part, and the labels are those of one sweep after the other, whatever the blocks.

Where the graph is that of overlapping segments of near targets, its edges are never written (smooth_near): a task holds the
segments of a part, in order of place, and weighs a target's neighbours when it visits it. Rows kept grow with the segments, not
with their pairs; the time of a sweep grows with the pairs.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, settled
from .intervals import segment_graph

#: Nodes that one task sweeps; it changes no label. Without edges a task holds more.
TASK_NODES, NEAR_NODES = 20_000, 1_000_000


def connected(edges: DataFrame) -> DataFrame:
    """(node, region) of the nodes of `edges` (u, v): the smallest node that each can reach. Each turn every node takes the
    smallest label around it and the label of its label, and is written; turns grow with the logarithm of a path's length."""
    low, edges = _drawn_together(edges)
    regions = _joined(edges)
    return low.join(regions.withColumnRenamed("node", "low"), "low", "left").select("node", F.coalesce("region", "low").alias("region"))


def _drawn_together(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, low): the smallest of each node and its neighbours, and the edges between these, of which a dense graph has few."""
    pairs = settled(edges.select("u", "v").distinct())
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("low")))
    ends = [low.select(F.col("node").alias(end), F.col("low").alias(f"{end}_low")) for end in ("u", "v")]
    between = settled(pairs.join(ends[0], "u").join(ends[1], "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v")).filter("u <> v").distinct())
    dropped(pairs)
    return low, between


def _joined(edges: DataFrame) -> DataFrame:
    """connected() by turns."""
    both = settled(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("region")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("region").alias("low"))
        least = labels.join(around, "node").select("node", "region", F.least("region", "low").alias("to"))
        further = labels.select(F.col("node").alias("to"), F.col("region").alias("next"))
        new = settled(least.join(further, "to").select("node", F.least("to", "next").alias("region"), (F.least("to", "next") < F.col("region")).alias("changed")))
        dropped(labels)
        labels = new.drop("changed")
        if new.filter("changed").isEmpty():
            return labels


def beside(n: int, u: np.ndarray, v: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours of n nodes one node after the other: where each node's begin, the neighbours in order, the weights."""
    order = np.lexsort((v, u))
    return np.searchsorted(u[order], np.arange(n + 1)), v[order], weights[order]


def sweep(unary: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray], strength: float, labels: np.ndarray, sweeps: int) -> int:
    """Change labels in row order; rows beyond those of `unary` are fixed. The number of the last sweep that changed one, or -1.
    A node none of whose neighbours has changed since it was visited would keep its label and is passed over."""
    starts, others, weights = near
    n, k = unary.shape
    weights = strength * weights
    starts, open_ = starts.tolist(), np.zeros(len(labels), bool)
    open_[:n] = np.diff(starts) > 0
    last = -1
    for turn in range(sweeps):
        changed = False
        for i in range(n):
            if not open_[i]:
                continue
            open_[i] = False
            beside_ = others[starts[i] : starts[i + 1]]
            # each label costs the weights of the neighbours that have another: all weights but those that agree
            best = int((unary[i] - np.bincount(labels[beside_], weights[starts[i] : starts[i + 1]], k)).argmin())
            if best != labels[i]:
                labels[i] = best
                open_[beside_] = True
                changed = True
        if not changed:
            break
        last = turn
    return last


def smooth_labels(unary: np.ndarray, edges: list[tuple[int, int, float]], strength: float, sweeps: int = 20) -> np.ndarray:
    """Iterated conditional modes in memory: labels in row order, each the first that is cheapest given its neighbours."""
    a, b, w = (np.array([e[i] for e in edges], kind) for i, kind in enumerate((np.int64, np.int64, float)))
    labels = unary.argmin(axis=1)
    sweep(unary, beside(len(unary), np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])), strength, labels, sweeps)
    return labels


def _swept_whole(nodes: DataFrame, edges: DataFrame, strength: float, sweeps: int) -> DataFrame:
    """Parts (region, target, segment_id, cost, label) with their edges (part, a, a_segment, b, b_segment, weight), all sweeps:
    target, segment_id, label, moved (the last sweep that changed a label)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        targets = pc.unique(left["target"])
        targets = targets.take(pc.sort_indices(targets))
        numbers = lambda column: pc.fill_null(pc.index_in(column, targets), -1).to_numpy().astype(np.int64)
        t, segment = numbers(left["target"]), left["segment_id"].to_numpy().astype(np.int64)
        order = np.lexsort((segment, t))
        least = segment.min(initial=0)
        width = segment.max(initial=0) - least + 1
        ids = (t * width + segment - least)[order]
        ends, there = [], np.ones(len(right), bool)
        for end in ("a", "b"):
            key, at = numbers(right[end]), right[f"{end}_segment"].to_numpy() - least
            there &= (key >= 0) & (at >= 0) & (at < width)
            key = key * width + at
            place = np.minimum(np.searchsorted(ids, key), max(len(ids) - 1, 0))
            there &= ids[place] == key if len(ids) else False
            ends.append(place)
        a, b = (x[there] for x in ends)
        w = right["weight"].to_numpy()[there]
        left = left.take(pa.array(order))
        cost = left["cost"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), -1)
        labels = left["label"].to_numpy().astype(np.int64)
        last = -1
        if len(a):
            last = sweep(cost, beside(len(left), np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])), strength, labels, sweeps)
        return pa.table({"target": left["target"], "segment_id": left["segment_id"], "label": pa.array(labels, pa.int32()), "moved": pa.array(np.full(len(left), last), pa.int32())})

    schema = f"target {nodes.schema['target'].dataType.simpleString()}, segment_id int, label int, moved int"
    return nodes.groupBy("region").cogroup(edges.groupBy("part")).applyInArrow(run, schema)


def _blocks(rows: DataFrame, regions: DataFrame, task_nodes: int) -> DataFrame:
    """(node, at, part, chunk, cost, label) of the rows of the graph: at numbers them in row order, a chunk is a run of them."""
    known = rows.join(regions, "node")
    sizes = regions.groupBy("region").agg(F.count("*").alias("n"))
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(regions.count() / (5 * task_nodes)))
    ordered = known.join(sizes, "region").repartitionByRange(ranges, "region", "node").sortWithinPartitions("region", "node").withColumn("at", F.monotonically_increasing_id())
    number = F.shiftleft(F.shiftright("at", 33), 33) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / task_nodes)
    numbered = settled(ordered.select("node", "region", "at", F.when(F.col("n") <= task_nodes, F.lit(0).cast("long")).otherwise(number).alias("chunk"), "cost", "label"))
    parts = numbered.groupBy("region").agg(F.min("at").alias("part"))
    return settled(numbered.join(parts, "region").drop("region"))


def _swept(work: DataFrame, sides: DataFrame, strength: float, sweeps: int) -> DataFrame:
    """Blocks (part, chunk, done, at, cost, label) with their edges (u, v, weight, v_label): the next sweep, or all that are left
    where no neighbour is outside."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("at")
        ids = left["at"].to_numpy()
        outside = np.setdiff1d(right["v"].to_numpy(), ids)
        names = np.concatenate([ids, outside])
        labels = np.zeros(len(names), int)
        labels[: len(ids)] = left["label"].to_numpy()
        order = np.argsort(names, kind="stable")
        place = lambda values: order[np.searchsorted(names[order], values)]
        u, v = place(right["u"].to_numpy()), place(right["v"].to_numpy())
        labels[v] = right["v_label"].to_numpy()
        near = beside(len(ids), u, v, right["weight"].to_numpy())
        done = int(left["done"].iloc[0])
        turns = 1 if len(outside) else sweeps - done
        last = sweep(np.stack(left["cost"].to_numpy()), near, strength, labels, turns)
        return left[["part", "chunk", "at"]].assign(label=labels[: len(ids)], done=done + turns, moved=done + last if last >= 0 else -1)

    schema = "part long, chunk long, at long, label int, done int, moved int"
    return work.groupBy("part", "chunk").cogroup(sides.groupBy("part", "chunk")).applyInPandas(run, schema)


def _with_costs(p: DataFrame) -> DataFrame:
    """target, segment_id, cost, label: the first that is cheapest by itself."""
    unary = F.transform("p", lambda x: -F.log(F.least(F.greatest(x, F.lit(1e-10)), F.lit(1.0))))
    first = F.array_position(F.col("cost"), F.array_min("cost")).cast("int") - 1
    return p.select("target", F.col("segment_id").cast("int").alias("segment_id"), unary.alias("cost")).withColumn("label", first)


def smooth_segments(p: DataFrame, graph: DataFrame, strength: float, sweeps: int = 20, task_nodes: int = TASK_NODES) -> DataFrame:
    """(target, segment_id, cluster_id) by iterated conditional modes over the segment graph. p: target, segment_id, p.

    Connected parts of the graph don't meet; within one the order is that of target and segment. Segments without neighbours keep
    the most probable cluster. Labels that the last of `sweeps` still changed are warned of.
    """
    rows = settled(_with_costs(p))
    edges = settled(graph.select("a", F.col("a_segment").cast("int").alias("a_segment"), "b", F.col("b_segment").cast("int").alias("b_segment"), F.col("weight").cast("double").alias("weight")))
    # targets that are linked share a part; so their segments do, linked or not
    regions = settled(connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "target"))
    sizes = rows.join(regions, "target").groupBy("region").agg(F.count("*").alias("n"))
    regions = settled(regions.join(sizes.select("region", (F.col("n") > task_nodes).alias("large")), "region"))
    alone = rows.join(regions, "target", "left_anti").select("target", "segment_id", "label")
    parts = [(rows.join(r, "target"), edges.join(r.select(F.col("target").alias("a"), F.col("region").alias("part")), "a")) for r in (regions.filter(large).drop("large") for large in ("not large", "large"))]
    swept = settled(_swept_whole(*parts[0], strength, sweeps))
    out = alone.unionByName(swept.drop("moved"))
    late = not swept.filter(F.col("moved") == sweeps - 1).isEmpty()
    if not regions.filter("large").isEmpty():
        smoothed, more = _smoothed_in_blocks(*parts[1], strength, sweeps, task_nodes)
        out, late = out.unionByName(smoothed), late or more
    if late:
        warnings.warn(f"labels still changed in the last of {sweeps} sweeps", stacklevel=2)
    return out.withColumnRenamed("label", "cluster_id")


def _smoothed_in_blocks(nodes: DataFrame, links: DataFrame, strength: float, sweeps: int, task_nodes: int) -> tuple[DataFrame, bool]:
    """(target, segment_id, label) of large parts, and whether the last sweep still changed labels."""
    node = lambda a, b: F.struct(F.col(a).alias("target"), F.col(b).alias("segment_id"))
    rows = settled(nodes.select(node("target", "segment_id").alias("node"), "region", "cost", "label"))
    regions, rows = rows.select("node", "region"), rows.drop("region")
    edges = settled(links.select(node("a", "a_segment").alias("u"), node("b", "b_segment").alias("v"), "weight"))
    placed = _blocks(rows, regions, task_nodes)
    labels = placed.select("at", "part", "chunk", "cost", "label")
    ends = [placed.select(F.col("node").alias(e), F.col("at").alias(f"{e}_at"), F.col("part"), F.col("chunk").alias(f"{e}_chunk")) for e in ("u", "v")]
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).join(ends[0], "u").join(ends[1].drop("part"), "v")
    sides = settled(sides.select("part", F.col("u_chunk").alias("chunk"), F.col("u_at").alias("u"), F.col("v_at").alias("v"), F.col("v_chunk").alias("other"), "weight"))
    borders = settled(sides.filter("chunk <> other").select("part", "chunk", "other").distinct())
    blocks = settled(labels.select("part", "chunk").distinct().select("part", "chunk", F.lit(0).alias("done"), F.lit(-1).alias("moved")))
    while True:
        # a part is through after a sweep without change, or after the last
        parts = blocks.groupBy("part").agg(F.min("done").alias("least"), F.max("moved").alias("moved"))
        unfinished = parts.filter(F.col("least") < F.least(F.lit(sweeps), F.col("moved") + 2)).select("part")
        beside = borders.join(blocks.select("part", F.col("chunk").alias("other"), F.col("done").alias("theirs")), ["part", "other"])
        around = beside.groupBy("part", "chunk").agg(F.min(F.when(F.col("other") < F.col("chunk"), F.col("theirs"))).alias("before"), F.min(F.when(F.col("other") > F.col("chunk"), F.col("theirs"))).alias("after"))
        turn = blocks.join(unfinished, "part", "left_semi").join(around, ["part", "chunk"], "left").filter((F.col("done") < sweeps) & F.coalesce(F.col("before") > F.col("done"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("done"), F.lit(True)))
        turn = settled(turn.select("part", "chunk", "done"))
        if turn.isEmpty():
            break
        work = labels.join(turn, ["part", "chunk"])
        needed = sides.join(turn.select("part", "chunk"), ["part", "chunk"]).drop("other").join(labels.select(F.col("at").alias("v"), F.col("label").alias("v_label")), "v")
        out = settled(_swept(work, needed, strength, sweeps))
        fresh = out.select("at", F.col("label").alias("to"))
        old = labels, blocks
        labels = settled(labels.join(fresh, "at", "left").select("at", "part", "chunk", "cost", F.coalesce("to", "label").alias("label")))
        did = out.select("part", "chunk", F.col("done").alias("now"), F.col("moved").alias("last")).distinct()
        blocks = settled(blocks.join(did, ["part", "chunk"], "left").select("part", "chunk", F.coalesce("now", "done").alias("done"), F.greatest("moved", F.coalesce("last", F.lit(-1))).alias("moved")))
        if old[0].inputFiles() != placed.inputFiles():
            dropped(old[0])
        dropped(old[1], turn, out)
    smoothed = placed.select("node", "at").join(labels.select("at", "label"), "at").select("node.target", "node.segment_id", "label")
    return smoothed, not blocks.filter(F.col("moved") == sweeps - 1).isEmpty()


def sweep_near(cost: np.ndarray, labels: np.ndarray, spans: np.ndarray, first: np.ndarray, place: np.ndarray, at: np.ndarray, radius: float, sigma: float, strength: float, sweeps: int) -> int:
    """As sweep(), over the graph of segment_graph(), whose edges are weighed where they are needed. Nodes are in row order, with their
    spans (top, bottom); first[t] is the first node of target t, and one beyond the last; place[i] is the target that lies at at[i]."""
    axis = int(np.argmax(np.ptp(at, axis=0))) if len(at) else 0
    order = np.argsort(at[:, axis], kind="stable")
    place, at = place[order], at[order]
    u, size = at[:, axis], np.diff(first)
    begins = np.concatenate([[0], np.cumsum(size[place])])
    nodes = np.repeat(first[place] - begins[:-1], size[place]) + np.arange(begins[-1])  # of the places one after the other
    top, bottom = spans[nodes].T.copy()
    thick = bottom - top
    one = np.eye(cost.shape[1])[labels[nodes]]
    own = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=len(size)))[:-1])
    reach = radius + 1e-9 * (radius + np.abs(u).max(initial=0.0))
    lows, highs = np.searchsorted(u, u - reach, "left"), np.searchsorted(u, u + reach, "right")
    open_, last = np.ones(len(size), bool), -1
    for turn in range(sweeps):
        changed = False
        for t in np.flatnonzero(size > 0).tolist():
            if not open_[t]:
                continue
            open_[t] = False
            here = slice(first[t], first[t + 1])
            gain = np.zeros((size[t], cost.shape[1]))
            low, high = spans[here].T[:, :, None]
            for i in own[t].tolist():
                a, b = lows[i], highs[i]
                d = np.hypot(at[a:b, 0] - at[i, 0], at[a:b, 1] - at[i, 1])
                factor = np.where((d <= radius) & (place[a:b] != t), np.exp(-d * d / (2 * sigma * sigma)), 0.0)
                beside_ = slice(begins[a], begins[b])
                overlap = np.minimum(high, bottom[beside_]) - np.maximum(low, top[beside_])
                weight = np.zeros_like(overlap)
                np.divide(overlap, np.maximum(high - low, thick[beside_]), out=weight, where=overlap > 0)
                weight *= np.repeat(factor, size[place[a:b]])
                weight[weight <= 1e-6] = 0.0
                gain += weight @ one[beside_]
            best = (cost[here] - strength * gain).argmin(axis=1)
            new = np.flatnonzero(best != labels[here])
            if not len(new):
                continue
            labels[here] = best
            for i in own[t].tolist():
                one[begins[i] + new] = 0.0
                one[begins[i] + new, best[new]] = 1.0
                open_[place[lows[i] : highs[i]]] = True
            open_[t], changed = False, True
        if not changed:
            break
        last = turn
    return last


def near_parts(places: DataFrame, radius: float) -> DataFrame:
    """(target, region): targets in different regions are more than `radius` apart. Of places (target, x, y) only cells of that
    width and the boxes around their places are linked, and the cells of one target."""
    at = settled(places.withColumns({c: F.floor(F.col(p) / radius) for c, p in (("cx", "x"), ("cy", "y"))}).withColumn("cell", F.xxhash64("cx", "cy")))
    ends = [f(c).alias(f"{c}_{name}") for c in ("x", "y") for name, f in (("low", F.min), ("high", F.max))]
    cells = settled(at.groupBy("cx", "cy", "cell").agg(*ends))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j))))"))
    others = cells.select(F.col("cell").alias("v"), *[F.col(c).alias(f"{c}2") for c in ("x_low", "x_high", "y_low", "y_high")], "cx", "cy", around.alias("o"))
    others = others.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")})
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}_low2") - F.col(f"{c}_high"), F.col(f"{c}_low") - F.col(f"{c}_high2"))
    linked = cells.join(others, ["cx", "cy"]).filter((F.col("cell") < F.col("v")) & (F.hypot(gap("x"), gap("y")) <= radius)).select(F.col("cell").alias("u"), "v")
    first = settled(at.groupBy("target").agg(F.min("cell").alias("node")))
    same = at.join(first.withColumnRenamed("node", "u"), "target").filter("u <> cell").select("u", F.col("cell").alias("v"))
    regions = connected(linked.unionByName(same))
    return first.join(regions, "node", "left").select("target", F.coalesce("region", "node").alias("region"))


def smooth_near(p: DataFrame, segs: DataFrame, places: DataFrame, radius: float, sigma: float, strength: float, sweeps: int = 20, task_nodes: int = NEAR_NODES) -> DataFrame:
    """smooth_segments() over segment_graph(segs, places, radius, sigma), whose edges are not made. Only parts of more than
    `task_nodes` segments have them written."""
    keys = ["target", "segment_id"]
    rows = settled(_with_costs(p))
    spans = segs.select("target", F.col("segment_id").cast("int").alias("segment_id"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))
    known = places.select("target", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    regions = settled(near_parts(known, radius))
    held = known.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("places"))
    nodes = settled(rows.hint("merge").join(spans, keys).hint("merge").join(held, "target").hint("merge").join(regions, "target"))
    sizes = settled(nodes.groupBy("region").agg(F.count("*").alias("n")))
    large = nodes.join(sizes.filter(F.col("n") > task_nodes).select("region"), "region", "left_semi").select(*keys)

    def run(part: pa.Table) -> pa.Table:
        targets = pc.unique(part["target"])
        targets = targets.take(pc.sort_indices(targets))
        t, segment = pc.index_in(part["target"], targets).to_numpy(), part["segment_id"].to_numpy()
        order = np.lexsort((segment, t))
        part, t = part.take(pa.array(order)), t[order]
        first = np.searchsorted(t, np.arange(len(targets) + 1))
        lists = part["places"].combine_chunks().take(pa.array(first[:-1]))
        at = np.stack([lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
        place = np.repeat(np.arange(len(targets)), lists.value_lengths().to_numpy())
        cost = part["cost"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        labels = part["label"].to_numpy().astype(np.int64)
        spans = np.stack([part[c].to_numpy() for c in ("top", "bottom")], 1).astype(float)
        last = sweep_near(cost, labels, spans, first, place, at, radius, sigma, strength, sweeps)
        return pa.table({"target": part["target"], "segment_id": part["segment_id"], "label": pa.array(labels, pa.int32()), "moved": pa.array(np.full(len(part), last), pa.int32())})

    # few rows and much work: dealt to an explicit number of partitions
    parts = max(1, min(4 * sizes.count(), 16 * rows.sparkSession.sparkContext.defaultParallelism))
    small = nodes.join(sizes.filter(F.col("n") <= task_nodes).select("region"), "region", "left_semi").repartition(parts, "region")
    swept = settled(small.groupBy("region").applyInArrow(run, f"target {nodes.schema['target'].dataType.simpleString()}, segment_id int, label int, moved int"))
    out = rows.join(nodes.select(*keys), keys, "left_anti").select(*keys, "label").unionByName(swept.drop("moved"))
    if not swept.filter(F.col("moved") == sweeps - 1).isEmpty():
        warnings.warn(f"labels still changed in the last of {sweeps} sweeps", stacklevel=2)
    out = out.withColumnRenamed("label", "cluster_id")
    if not large.isEmpty():
        own = settled(large)
        graph = segment_graph(segs.join(own.select("target").distinct(), "target", "left_semi"), known, radius, sigma)
        out = out.unionByName(smooth_segments(p.join(own, keys, "left_semi"), graph, strength, sweeps))
    return out
