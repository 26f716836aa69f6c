"""Near-duplicates by SetSketch.

A document's set is its distinct shingles of five words, hashed to 64 bits. Documents with the same set are one class from
the start. A class is sketched by REGISTERS exponentially spaced, truncated minima: register i is floor(1 - log_BASE h) of
the smallest h that a Poisson stream of the set's elements sends to i, so that sketches merge by maximum and registers
agree about as often as the sets overlap. Bands of register values make candidates; the register comparison counts give a
maximum likelihood estimate of the overlap jointly with the known sizes, which only discards pairs far below the threshold;
the full sets decide.

Candidates of a band are compared without emitting all pairs of a bucket: every member meets the one centre that has most
in common with other classes, and what is linked becomes one component. In buckets that then still hold several components,
members of different components are compared, but only where their sizes, their overlaps with the centre, and how many other
shingles they share with any class at all, leave room for a link; large buckets are split among tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, drop_written, pick, row_id, standing_for, words_of, written

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Registers, their base and rate; rows of a band and bands. A pair at the threshold shares no band with odds of 1.2e-8.
REGISTERS, BASE, RATE = 256, 1.02, 20.0
ROWS, BANDS = 4, 48
#: Six standard deviations of the estimate below the threshold: odds of 1e-9.
LEAST_ESTIMATE = PERCENT / 100 - 6 * math.sqrt(0.75 * 0.25 / REGISTERS)
#: Sets of sizes that differ by more than this factor can't be linked; members of a bucket, of like size, in one task.
SIZE_STEP, SPLIT = 1.34, 2000
_GOLDEN, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHE_ENTRIES = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for word in words_of(text):
            h = known.get(word)
            if h is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                h = known[word] = xxhash.xxh3_64_intdigest(word)
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        if not len(words):
            return words
        size = min(SHINGLE, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            out = mix(out * _GOLDEN + words[i : i + len(out)])
        return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS values (uint16) for each set; 0 everywhere for an empty one.

    An element sends a Poisson stream of points to random registers. A stream ends once it is past the largest of its
    set's minima, so that a set of n costs about n + REGISTERS * log(REGISTERS) points.
    """
    minima = np.full(len(sets) * REGISTERS, np.inf)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    state = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.zeros(len(row))
    while len(row):
        state = state + _GOLDEN
        bits = mix(state)
        at = at - np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / REGISTERS
        np.minimum.at(minima, row * REGISTERS + (bits & np.uint64(REGISTERS - 1)).astype(np.int64), at)
        first = np.flatnonzero(np.diff(row, prepend=-1))  # rows stay in order
        worst = minima.reshape(-1, REGISTERS)[row[first]].max(axis=1)
        alive = at < np.repeat(worst, np.diff(first, append=len(row)))
        row, state, at = row[alive], state[alive], at[alive]
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(minima / RATE) / math.log(BASE))
    return np.clip(values, 0, 65535).astype(np.uint16).reshape(-1, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    values = registers[:, : ROWS * BANDS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN), values.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * _GOLDEN + values[:, :, i])
    return out.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of pairs of sketches by maximum likelihood of how often registers are above, below or
    alike, given the sizes of the sets."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    alike = REGISTERS - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    overlap = _GRID[None, :] * most[:, None]
    share = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * share) / math.log(BASE), 1e-9, 1)

    up, down = p(u[:, None] - v[:, None] * overlap), p(v[:, None] - u[:, None] * overlap)
    same = np.clip(1 - up - down, 1e-9, 1)
    fit = above[:, None] * np.log(up) + below[:, None] * np.log(down) + alike[:, None] * np.log(same)
    return overlap[np.arange(len(a)), fit.argmax(axis=1)]


def class_of(shingles: np.ndarray) -> bytes:
    """A digest of a set, which names its class."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(n_a: int, n_b: int, both: int) -> bool:
    """Whether sets of these sizes that share so many elements are linked."""
    return 100 * both >= PERCENT * (n_a + n_b - both)


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, ROW_ID, n_shingles, cls (digest of its set; null if empty), registers, bands."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", *row_id(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sets = [shingler.shingles(t.as_py()) for t in part.column(3)]
                registers = sketch(sets)
                bands = band_keys(registers)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["doc_id", *ROW_ID, "n_shingles", "cls", "registers", "bands"])

    return rows.mapInArrow(run, f"doc_id long, {ROW_ID[0]} long, {ROW_ID[1]} long, n_shingles long, cls binary, registers binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, each: bool) -> DataFrame:
    """The whole sets of the rows that stand for the classes `wanted` (c, ROW_ID): as bytes, or `each` shingle a row."""
    named = pick(docs, doc_id="long", text="string").select(*row_id(), "text")
    rows = standing_for(named, wanted.select("c", *ROW_ID)).select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingler.shingles(t.as_py()) for t in part.column(1)]
                if each:
                    names = np.repeat(np.asarray(part.column(0)), [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["c", "shingle"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "shingles"])

    return rows.mapInArrow(run, "c long, shingle long" if each else "c long, shingles binary")


def _alone(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """c and how many of the shingles of a class no other class among `touched` has."""
    each = _sets(docs, touched, each=True)
    alone = each.groupBy("shingle").agg(F.min("c").alias("c"), F.max("c").alias("last")).filter("c = last")
    return alone.groupBy("c").agg(F.count("*").alias("alone"))


def _can_link(m: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes that have at most m shingles in common can be linked."""
    return m * 100 >= (n_a + n_b - m) * PERCENT


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) whose registers don't rule out a link, with how many shingles they share by the full sets,
    and whether they are linked."""
    of = lambda side: classes.select(F.col("c").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("registers", "shingles")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                names = [np.asarray(part.column(i)) for i in (0, 1)]
                registers = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 4)]
                sets = [[np.frombuffer(s, np.uint64) for s in part.column(i).to_pylist()] for i in (3, 5)]
                sizes = [np.array([len(s) for s in x], float) for x in sets]
                near = np.flatnonzero(estimate(*registers, *sizes) >= LEAST_ESTIMATE)
                both = [overlap(sets[0][i], sets[1][i]) for i in near.tolist()]
                ok = [linked(len(sets[0][i]), len(sets[1][i]), n) for i, n in zip(near.tolist(), both, strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(n[near], pa.int64()) for n in names], pa.array(both, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "overlap", "linked"])

    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "registers_a", "shingles_a", "registers_b", "shingles_b").mapInArrow(run, "a long, b long, overlap long, linked boolean")


def _checked(docs: DataFrame, pairs: DataFrame, touched: DataFrame) -> DataFrame:
    """_compared() over candidate pairs; the sets of only those classes that are in a pair are built again."""
    pairs = written(pairs.distinct(), "near-pairs")
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(touched, "c"), "near-named")
    # repeats of the row that stands for a class give its set again
    whole = _sets(docs, named, each=False).join(named.select("c", "registers"), "c").dropDuplicates(["c"])
    classes = written(whole, "near-sets")
    found = written(_compared(pairs, classes), "near-compared")
    drop_written(classes, pairs, named)
    return found


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _split(left: DataFrame) -> DataFrame:
    """Pairs of members of one band, each once, of different labels and like size: the columns of `left` and, ending in _b,
    those of the other. Members meet by size; where many are of like size, each task has a part of them."""
    step = F.floor(F.log("n_shingles") / F.lit(math.log(SIZE_STEP))).cast("int")
    sized = left.withColumn("step", step)
    parts = sized.groupBy("band", "step").agg(F.ceil(F.count("*") / F.lit(float(SPLIT))).cast("int").alias("parts"))
    ours = sized.join(parts, ["band", "step"]).withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int")).drop("parts")
    theirs = sized.select("band", *[F.col(x).alias(f"{x}_b") for x in left.columns if x != "band"], F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"))
    theirs = theirs.join(parts, ["band", "step"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return ours.join(theirs, ["band", "step", "part"]).filter(F.col("label") < F.col("label_b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node that is reachable, for every node of `edges` (u, v).

    Large and small stars by turns: each turn links nodes to smaller ones only, halves the depth, and is written.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near-edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == state or not now.n:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "near-least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "near-large")
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "near-least")
        small = large.join(least2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = written(small.filter("u <> v").distinct(), "near-edges")
        for used in (edges, least, large, least2):
            drop_written(used)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def grouped(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, ROW_ID, n_shingles, label (a number of its component, null without shingles) and component_id
    (the smallest id in it, null if no row there has one).

    Components are of classes, whatever the ids of their rows: rows that share an id, or have none, are together only if
    their sets link them. Repeated rows and copies are one class; extra columns of `docs` are ignored.
    """
    rows = written(profiles(docs), "near-profiles")
    # a row stands for each class; a class is a number from here on
    stands = F.min(F.struct(*ROW_ID, "n_shingles", "registers", "bands")).alias("x")
    classes = rows.filter("cls is not null").groupBy("cls").agg(stands, F.min("doc_id").alias("least")).select("cls", "least", "x.*")
    reps = written(classes.withColumn("c", F.monotonically_increasing_id()), "near-representatives")

    banded = reps.select("c", F.explode("bands").alias("band"))
    busy = written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "near-bands")
    members = written(banded.join(busy, "band"), "near-members")
    touched = written(members.select("c").distinct().join(reps.select("c", *ROW_ID, "n_shingles", "registers"), "c"), "near-touched")
    shared_part = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    sized = written(touched.select("c", "n_shingles").join(_alone(docs, touched), "c", "left").select("c", "n_shingles", shared_part.alias("m")), "near-sizes")
    # a class whose own shingles leave too few for any link is done
    sized = sized.filter(_can_link(F.col("m"), F.col("n_shingles"), F.col("m")))
    held = written(members.join(sized, "c"), "near-held")
    drop_written(busy, members)

    # a bucket's centre has the largest part of its set in common with other classes; ties by a hash of the band
    rank = F.struct((F.col("m") / F.col("n_shingles")).alias("part"), F.xxhash64("band", "c").alias("by"), "c", "n_shingles", "m")
    centres = held.groupBy("band").agg(F.max(rank).alias("x"), F.count("*").alias("n")).filter("n > 1").select("band", F.col("x.c").alias("centre"), F.col("x.n_shingles").alias("n_centre"), F.col("x.m").alias("m_centre"))
    centres = written(centres, "near-centres")
    star = held.join(centres, "band").filter((F.col("c") != F.col("centre")) & _can_link(F.least("m", "m_centre"), F.col("n_shingles"), F.col("n_centre")))
    compared = _checked(docs, star.select(F.col("c").alias("a"), F.col("centre").alias("b")), touched)
    labels = written(components(_links(compared)), "near-labels")

    # buckets that still hold several components, without members that can't be linked with the smallest set there
    named = written(held.join(labels.withColumnRenamed("node", "c"), "c", "left").select("band", "c", "n_shingles", "m", F.coalesce("label", "c").alias("label")), "near-labelled")
    drop_written(held)
    ends = written(named.groupBy("band").agg(F.min("n_shingles").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band", "least"), "near-ends")
    able = named.join(ends, "band").filter(_can_link(F.col("m"), F.col("n_shingles"), F.greatest("least", "m"))).drop("least")
    # of a member's m shared shingles `inner` are the centre's, at most, and `outer` are not; both known once compared
    known = compared.select(F.col("a").alias("c"), F.col("b").alias("centre"), "overlap")
    able = able.join(centres, "band").join(known, ["c", "centre"], "left")
    own = F.col("c") == F.col("centre")
    inner = F.when(own, F.col("m")).otherwise(F.coalesce("overlap", F.least("m", "m_centre")))
    outer = F.when(own, 0).otherwise(F.col("m") - F.coalesce("overlap", F.lit(0)))
    able = written(able.select("band", "c", "n_shingles", "m", "label", inner.alias("inner"), outer.alias("outer")), "near-able")
    still = written(able.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band"), "near-open")
    left = written(able.join(still, "band").join(reps.select("c", "bands"), "c"), "near-left")
    most = F.least("m", "m_b", F.least("inner", "inner_b") + F.least("outer", "outer_b"))
    # a pair comes from the first of the bands that it shares
    first = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True).cast("int")
    cross = _split(left).filter(_can_link(most, F.col("n_shingles"), F.col("n_shingles_b")) & (F.try_element_at("bands", first) == F.col("band")))
    more = _links(_checked(docs, cross.select(F.col("c").alias("a"), F.col("c_b").alias("b")), touched))
    if more.head(1):
        stars = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
        labels = written(components(stars.unionByName(more)), "near-labels")

    joined = reps.select("cls", "c", "least").join(labels.withColumnRenamed("node", "c"), "c", "left").select("cls", "least", F.coalesce("label", "c").alias("label"))
    nodes = written(joined, "near-nodes")
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    nodes = written(nodes.select("cls", "label").join(least, "label"), "near-components")
    drop_written(reps, touched, named, able, left)
    return rows.select("doc_id", *ROW_ID, "n_shingles", "cls").join(nodes, "cls", "left").drop("cls")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept (the id is the component's smallest).

    Texts without a word have no shingles, are linked with nothing and are kept. Rows without an id take part; they are
    kept, with a null component_id, where no row of their component has one. grouped() says the rest.
    """
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return grouped(docs).select("doc_id", "n_shingles", component.alias("component_id"), F.equal_null("doc_id", component).alias("kept"))


NEAR_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select u, v from shared join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * i >= 75 * (a.n + b.n - i)),
sides as (select u, v from links union select v, u from links),
reach(node, c) as (select doc_id, doc_id from documents union select e.v, r.c from reach r join sides e on r.node = e.u)
select d.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.c)::bigint as component_id, d.doc_id = min(r.c) as kept
from documents d left join sizes z on z.doc_id = d.doc_id join reach r on r.node = d.doc_id group by d.doc_id"""
