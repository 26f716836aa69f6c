"""Merkle manifest of a dataset: a tree of fan-out 8 over each group of rows, and one over the groups' roots.

Rows are sorted over the cluster by group and order and stand in spans, a span being what one partition holds of one group, whose
first place in its group is known from the spans' sizes. Each span pushes its leaves onto a stack of open runs, a mountain
range: a run of eight that is full carries its hash to the next level, as in counting to the base of eight. What is left
are the span's peaks: complete nodes whose run reaches over an edge of the span, or ends short with the group. These few
are merged level by level with those of other spans; a short run is hashed as it is, without padding, even if it holds one
node. The path of a row is then found in its span and in the two merged runs a level that the span's ends belong to.

Groups and orders may be null, which come first; equal orders go by leaf, and leaves that are equal too are interchangeable.
Extra columns are ignored. A group of one row has its leaf for root, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, remainder, written

FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Rows of a partition, of some 250 bytes each.
SPAN_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its size in bytes before it, so that neighbouring values can't be shifted into each other."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A text that sorts as the value does, null first, and is never null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


class Forest(NamedTuple):
    """The trees of all groups: sorted rows (group, order, leaf, other, part, place), spans (group, part, start, rows, total,
    height), what the spans' stacks gave out (group, height, level, at, digest, peak), runs merged across spans (group,
    level, run, children) and roots (group, root)."""

    rows: DataFrame
    spans: DataFrame
    nodes: DataFrame
    runs: DataFrame
    roots: DataFrame


def climb(leaves: Iterable[str], start: int) -> tuple[dict[tuple[int, int], list[str]], list[tuple[int, int, list[str]]]]:
    """The full runs of a span by level and number, and its peaks as (level, place of the first, digests)."""
    stack: list[tuple[int, list[str]]] = []  # of each level: the place behind its open run, and that
    runs, peaks = {}, []
    for at, node in enumerate(leaves, start):
        for level in range(64):
            if level == len(stack):
                stack.append((0, []))
            run = [*stack[level][1], node]
            stack[level] = (at + 1, run)
            if at % FAN < FAN - 1:
                break
            stack[level] = (0, [])
            if len(run) < FAN:  # it began in another span
                peaks.append((level, at + 1 - len(run), run))
                break
            at >>= FAN_BITS  # noqa: PLW2901
            runs[level, at] = run
            node = digest(run)  # noqa: PLW2901
    peaks += [(level, end - len(run), run) for level, (end, run) in enumerate(stack) if run]
    return runs, peaks


def _spans(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("group", "part").agg(F.count("*").alias("rows"))
    own = Window.partitionBy("group")
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    out = counted.select("group", "part", "rows", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(own).alias("total"))
    return out.withColumn("height", F.expr(f"size(filter(sequence(0, 20), l -> shiftleft(1L, {FAN_BITS} * l) < total))"))


def _stacks(key, rows: pa.Table, spans: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    start, height = spans.column("start")[0].as_py(), spans.column("height")[0].as_py()
    runs, peaks = climb(rows.column("leaf").to_pylist(), start)
    found = [(level, first + i, node, True) for level, first, run in peaks for i, node in enumerate(run)]
    found += [(level + 1, at, digest(run), False) for (level, at), run in runs.items()]
    level, at, node, peak = zip(*found, strict=True)
    # a full run's node is either below another full run or a peak as well
    peaks_at = {(lv, a) for lv, a, _, p in found if p}
    keep = pa.array([p or (lv, a) not in peaks_at for lv, a, _, p in found])
    table = pa.table({"group": pa.array([key[0].as_py()] * len(found)), "height": pa.array([height] * len(found), pa.int32()), "level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64()), "digest": pa.array(node), "peak": pa.array(peak)})
    return table.filter(keep)


def grow(leaves: DataFrame, name: str, span_rows: int = SPAN_ROWS) -> Forest:
    """The trees over (group, order, leaf, other): group is a text and never null, other is carried along."""
    # the number of a row splits rows that are equal in all else
    salted = written(leaves.select("group", "order", "leaf", "other", F.monotonically_increasing_id().alias("salt")), f"{name}-leaves")
    parts = max(leaves.sparkSession.sparkContext.defaultParallelism, math.ceil(salted.count() / span_rows))
    keys = [F.col("group"), F.col("order").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    ordered = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = written(ordered.select("group", "order", "leaf", "other", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), f"{name}-rows")
    spans = written(_spans(rows), f"{name}-spans")
    own = rows.select("group", "part", "place", "leaf").groupBy("group", "part")
    schema = "group string, height int, level int, at long, digest string, peak boolean"
    nodes = written(own.cogroup(spans.groupBy("group", "part")).applyInArrow(_stacks, schema), f"{name}-nodes")
    runs, roots = _merged(nodes, spans.agg(F.max("height")).first()[0] or 0, name)
    return Forest(rows, spans, nodes, runs, roots)


def _merged(nodes: DataFrame, height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs across spans, from the leaves up: at most 14 peaks a span and level, and what they make."""
    level_of = lambda level: nodes.filter(F.col("peak") & (F.col("level") == level)).select("group", "height", "at", "digest")
    here, runs, roots = level_of(0), [], []
    for level in range(height):
        roots.append(here.filter(F.col("height") == level))
        run = here.filter(F.col("height") > level).groupBy("group", "height", F.shiftright("at", FAN_BITS).alias("run"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        runs.append(written(run.agg(children.alias("children")).withColumn("level", F.lit(level)), f"{name}-runs-{level}"))
        merged = runs[-1].select("group", "height", F.col("run").alias("at"), F.sha2(F.array_join("children", ""), 256).alias("digest"))
        here = level_of(level + 1).unionByName(merged)
    roots.append(here.filter(F.col("height") == height))
    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    none = nodes.select("group", "level", F.col("at").alias("run"), F.array("digest").alias("children")).limit(0)
    return union([none, *[r.select("group", "level", "run", "children") for r in runs]]), union(roots).select("group", F.col("digest").alias("root"))


def node_records(forest: Forest) -> DataFrame:
    """All nodes of the trees, leaves left out: (group, level, at, digest)."""
    carried = forest.nodes.filter("level > 0").select("group", "level", "at", "digest")
    merged = forest.runs.select("group", (F.col("level") + 1).alias("level"), F.col("run").alias("at"), F.sha2(F.array_join("children", ""), 256).alias("digest"))
    return carried.unionByName(merged)


def steps_of(forest: Forest) -> DataFrame:
    """Of each span the runs that its ends belong to, as far as they were merged: (group, part, start, height, runs)."""
    ends = [F.col("start"), F.col("start") + F.col("rows") - 1]
    numbers = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda level: F.array(*[F.struct(level.alias("level"), F.call_function("shiftright", end, level * FAN_BITS + FAN_BITS).alias("run")) for end in ends]))
    wanted = forest.spans.filter("height > 0").select("group", "part", F.explode(F.array_distinct(F.flatten(numbers))).alias("x")).select("group", "part", "x.level", "x.run")
    found = wanted.join(forest.runs, ["group", "level", "run"]).groupBy("group", "part").agg(F.collect_list(F.struct("level", "run", "children")).alias("runs"))
    return forest.spans.join(found, ["group", "part"], "left").select("group", "part", "start", "height", "runs")


def paths(rows: pa.Table, span: dict) -> Iterator[list[tuple[str, str]]]:
    """Of each row of a span, in order, what stands left and right of its node in each run up to the root."""
    runs, _ = climb(rows.column("leaf").to_pylist(), span["start"])
    runs |= {(x["level"], x["run"]): x["children"] for x in span["runs"] or []}
    for at in range(span["start"], span["start"] + rows.num_rows):
        path = []
        for level in range(span["height"]):
            here = at >> FAN_BITS * level
            run, i = runs[level, here >> FAN_BITS], here % FAN
            path.append(("".join(run[:i]), "".join(run[i + 1 :])))
        yield path


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest((left, leaf, right))
    return leaf


def _tops(key, rows: pa.Table, spans: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    tops = [[{"left": a, "right": b} for a, b in path] for path in paths(rows, spans.to_pylist()[0])]
    return pa.table({"group": rows.column("order"), "tops": pa.array(tops, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})


def _proofs(key, rows: pa.Table, spans: pa.Table) -> pa.Table:
    rows, span = rows.sort_by("place"), spans.to_pylist()[0]
    tops = [(x["left"], x["right"]) for x in span["tops"]]
    proofs, folded = [], []
    for leaf, changed, path in zip(rows.column("leaf").to_pylist(), rows.column("other").to_pylist(), paths(rows, span), strict=True):
        proofs.append(digest(left + right for left, right in path + tops))
        folded.append(fold(leaf if changed is None else changed, path + tops))
    same = lambda value: pa.array([value] * len(rows))
    return pa.table({"doc_id": rows.column("order"), "leaf": rows.column("leaf"), "subroot": same(span["subroot"]), "root": same(span["root"]), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == span["root"] for f in folded])})


def prove(leaves: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """For each of (group, order, leaf, other): doc_id (the order), leaf, subroot of its group, root of all, the digest of its
    path's siblings, the root recomputed from `other` (the leaf, if that is null) with these siblings, and whether it is the root."""
    forest = grow(leaves, "manifest", span_rows)
    upper = grow(forest.roots.select(F.lit("").alias("group"), F.col("group").alias("order"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other")), "manifest-roots", span_rows)
    grouped = lambda f, spans: f.rows.groupBy("group", "part").cogroup(spans.groupBy("group", "part"))
    tops = grouped(upper, steps_of(upper)).applyInArrow(_tops, "group string, tops array<struct<left string, right string>>")
    # one root at most
    ends = forest.roots.withColumnRenamed("root", "subroot").join(tops, "group").join(F.broadcast(upper.roots.select("root")))
    spans = steps_of(forest).join(ends, "group")
    return grouped(forest, spans).applyInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of `documents`, by language; `other` is the leaf after tampering, where a row is tampered with."""
    rows = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) == 0), leaf_of([*values, F.translate("text", UPPER, LOWER)]))
    return rows.select(group_key(F.col("lang")).alias("group"), F.col("doc_id").alias("order"), leaf_of([*values, F.col("text")]).alias("leaf"), tampered.alias("other"))


def document_proofs(docs: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    return prove(document_leaves(docs), span_rows)


#: DuckDB SQL of the table that crc32 goes by, made by its rule.
CRC_TABLE_SQL = "[list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for i in range(256)]"


def crc32_sql(hexed: str, table: str) -> str:
    """DuckDB SQL for the crc32 of the bytes that a column holds in hex, with CRC_TABLE_SQL in another."""
    byte = f"list_transform(range(0, length({hexed})::bigint, 2), lambda p: ('0x' || substr({hexed}, (p + 1)::int, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {byte}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _levels_sql(base: str, prefix: str, part: str, levels: int) -> str:
    """CTEs of the nodes of `base` (part, pos, d) level by level, with what stands left and right of each in its run."""
    out, before = [], base
    for k in range(levels):
        run = f"(partition by {part}, pos // 8 order by pos rows between"
        out.append(
            f"{prefix}{k} as (select {part}, pos, d, count(*) over (partition by {part}) as size, coalesce(string_agg(d, '') over {run} unbounded preceding and 1 preceding), '') as lft, "
            f"coalesce(string_agg(d, '') over {run} 1 following and unbounded following), '') as rgt from {before})"
        )
        out.append(f"{prefix}{k}u as (select {part}, pos // 8 as pos, case when max(size) = 1 then max(d) else sha256(string_agg(d, '' order by pos)) end as d from {prefix}{k} group by {part}, pos // 8)")
        before = f"{prefix}{k}u"
    return ",\n".join(out)


#: Levels that the SQL writes out: up to 8^7 rows a language and 8^3 languages.
_ROW_LEVELS, _TOP_LEVELS = 7, 3
_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0} end"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
_NODES = [(f"n{k}", 8**k) for k in range(_ROW_LEVELS)] + [(f"t{k}", 8**k) for k in range(_TOP_LEVELS)]


def _folds_sql() -> str:
    """The fold as one CTE a level, each a join with that level's nodes."""
    out, before = [], "d"
    for i, (name, step) in enumerate(_NODES):
        on = f"{name}.g is not distinct from x.g and {name}.pos = x.pos // {step}" if name[0] == "n" else f"{name}.pos = x.top // {step}"
        out.append(f"f{i} as (select x.* exclude (folded, proof), x.proof || {name}.lft || {name}.rgt as proof, case when {name}.size = 1 then x.folded else sha256({name}.lft || x.folded || {name}.rgt) end as folded from {before} x join {name} on {on})")
        before = f"f{i}"
    return ",\n".join(out)


PROOF_SQL = f"""
with ids as (select doc_id, hex(doc_id::varchar) as h from (select distinct doc_id from documents)),
crc_table as (select {CRC_TABLE_SQL} as crc_of),
crcs as (select doc_id, {crc32_sql("h", "crc_of")} as crc from ids, crc_table),
l as (
  select doc_id, lang as g, sha256({_HEAD} || {_FIELD.format("text")}) as d,
    case when crc % 3 = 0 then sha256({_HEAD} || {_FIELD.format(_LOW)}) end as tampered
  from documents left join crcs using (doc_id)
), n as (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 as pos from l),
{_levels_sql("n", "n", "g", _ROW_LEVELS)},
r as (select 0 as one, g, d, row_number() over (order by g nulls first) - 1 as pos from n{_ROW_LEVELS - 1}u),
{_levels_sql("r", "t", "one", _TOP_LEVELS)},
d as (select n.*, r.pos as top, r.d as subroot, coalesce(tampered, n.d) as folded, '' as proof from n join r on n.g is not distinct from r.g),
{_folds_sql()}
select doc_id, x.d as leaf, subroot, e.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = e.d as verified
from f{len(_NODES) - 1} x, t{_TOP_LEVELS - 1}u e"""
