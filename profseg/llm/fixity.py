"""Merkle fixity audit of WARC replicas.

A record is the WARC response of a page; its leaf is the page's slot in key order. The records of a slot are hashed with
their number of copies into four XOR lanes, so that a slot is a sum that combines before the shuffle, however many rows
share an id. Sixteen neighbouring slots form a node, sixteen nodes the next, up to one root. A node's digest is that
of its contents. Its seal, which replicas are compared by, also covers its slot, and the slot, begin and size of each child's range. Two replicas are compared from the root down: only the children of nodes whose hashes differ are
looked at, so intact branches cost nothing below the node that proves them.

Null ids count as id -1, null urls and bodies as empty. Repeated rows are copies that a replica must hold as often.
Without rows there is no tree and no result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, written

#: log2 of the children of a node; the levels that 64 bits need at most.
FAN_BITS, MOST_LEVELS = 4, 16
LANES, LANE_DIGITS = 4, 15


def record_of(url: Column, body: Column) -> Column:
    """The bytes of a page's WARC record, as text."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(node, records, bytes, digest) by slot from (page_id, url, html)."""
    rows = pick(pages, page_id="long", url="string", html="string")
    record = record_of(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    hashed = rows.select(F.coalesce("page_id", F.lit(-1)).alias("node"), record.alias("record")).select("node", F.sha2("record", 256).alias("record_digest"), F.octet_length("record").cast("long").alias("size"))
    copies = hashed.groupBy("node", "record_digest", "size").agg(F.count("*").alias("copies"))
    counted = copies.withColumn("h", F.sha2(F.concat_ws(":", "record_digest", F.col("copies").cast("string")), 256))
    lanes = [F.bit_xor(F.conv(F.substring("h", 1 + i * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("long")).alias(f"lane{i}") for i in range(LANES)]
    slots = counted.groupBy("node").agg(*lanes, F.sum("copies").alias("records"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))
    digest = F.sha2(F.concat_ws(",", *[F.col(f"lane{i}").cast("string") for i in range(LANES)], F.col("records").cast("string")), 256)
    return slots.select("node", "records", "bytes", digest.alias("digest")).withColumn("seal", F.sha2(F.concat_ws(":", "node", "bytes", "digest"), 256))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: a group is the at most sixteen children of a node."""
    child = F.array_sort(F.collect_list(F.struct("node", "digest", "bytes", "seal")))
    grouped = nodes.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(child.alias("children"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    # each child's slot, begin of its range in the parent's, size and seal
    start = lambda i: F.aggregate(F.slice("children", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
    sealed = F.concat_ws(",", F.transform("children", lambda c, i: F.concat_ws(":", c["node"], start(i), c["bytes"], c["seal"])))
    digest = F.sha2(F.concat_ws("", F.transform("children", lambda c: c["digest"])), 256)
    return grouped.select("node", "records", "bytes", digest.alias("digest"), F.sha2(sealed, 256).alias("seal"))


def levels_over(*leaf_tables: DataFrame) -> int:
    """How many levels lie over the leaves until each tree has a single node, or MOST_LEVELS."""
    ends = [t.agg(F.min("node").alias("low"), F.max("node").alias("high")).first() for t in leaf_tables]
    lows, highs = [e.low for e in ends if e.low is not None], [e.high for e in ends if e.high is not None]
    if not lows:
        return 0
    low, high, n = min(lows), max(highs), 0
    while low != high and n < MOST_LEVELS:
        low, high, n = low >> FAN_BITS, high >> FAN_BITS, n + 1
    return n


def tree(pages: DataFrame, name: str) -> list[DataFrame]:
    """The leaves of a replica, written to the shared folder; build() adds the levels above."""
    return [written(leaves(pages), f"fixity-{name}-0")]


def build(levels: list[DataFrame], height: int, name: str) -> list[DataFrame]:
    """All levels, leaves first. Each is a sixteenth of the one below and is written, since several steps read it."""
    while len(levels) <= height:
        levels = [*levels, written(parents(levels[-1]), f"fixity-{name}-{len(levels)}")]
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes whose seals differ or that one replica lacks: node and both seals."""
    both = ours.select("node", F.col("seal").alias("ours")).join(theirs.select("node", F.col("seal").alias("theirs")), "node", "full_outer")
    return both.filter(~F.equal_null("ours", "theirs"))


def descend(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """The slots that differ, found by following the differing branches down from the root."""
    found = written(differing(ours[-1], theirs[-1]), "fixity-found")
    for level in range(len(ours) - 2, -1, -1):  # each level's finding is written: both replicas of the next read it
        suspect = found.select(F.col("node").alias("parent"))
        below = [t.withColumn("parent", F.shiftright("node", FAN_BITS)).join(suspect, "parent", "left_semi") for t in (ours[level], theirs[level])]
        found = written(differing(*below), "fixity-found")
    return found


def offsets(levels: list[DataFrame]) -> DataFrame:
    """Where the range of each slot begins: sums over at most sixteen siblings on each level, added from the root down."""
    above = levels[-1].select("node", F.sum("bytes").over(Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    start = above.select("node", F.coalesce("before", F.lit(0)).alias("start"))
    siblings = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    for nodes in reversed(levels[:-1]):
        own = nodes.withColumn("parent", F.shiftright("node", FAN_BITS)).withColumn("before", F.coalesce(F.sum("bytes").over(siblings), F.lit(0)))
        start = own.join(start.select(F.col("node").alias("parent"), F.col("start").alias("parent_start")), "parent").select("node", (F.col("parent_start") + F.col("before")).alias("start"))
    return start


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per slot of either replica: page_id, records, start_offset and n_bytes of its range in ours, digest, the digest
    of its node one level up (its own if the tree is one slot) and status: intact, altered, missing (theirs lacks it)
    or extra (ours lacks it)."""
    a, b = tree(ours, "ours"), tree(theirs, "theirs")
    height = levels_over(a[0], b[0])
    a, b = build(a, height, "ours"), build(b, height, "theirs")
    bad = descend(a, b)
    status = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("altered")
    verdicts = bad.select("node", status.alias("status"))
    kept = a[0].join(offsets(a), "node").join(verdicts.filter("status <> 'extra'"), "node", "left")
    upper = a[min(1, height)].select(F.col("node").alias("parent"), F.col("digest").alias("node_digest"))
    kept = kept.withColumn("parent", F.shiftright("node", FAN_BITS) if height else F.col("node")).join(upper, "parent")
    rows = kept.select(F.col("node").alias("page_id"), "records", F.col("start").alias("start_offset"), F.col("bytes").alias("n_bytes"), "digest", "node_digest", F.coalesce("status", F.lit("intact")).alias("status"))
    extra = verdicts.filter("status = 'extra'").select(F.col("node").alias("page_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("records", "long"), ("start_offset", "long"), ("n_bytes", "long"), ("digest", "string"), ("node_digest", "string"))], "status")
    return rows.unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage for the registered query: a changed body in some pages, others lost."""
    rows = pick(pages, page_id="long", url="string", html="string").filter(~F.coalesce(F.pmod("page_id", F.lit(97)) == 5, F.lit(False)))
    return rows.withColumn("html", F.when(F.pmod("page_id", F.lit(53)) == 7, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")))


#: Both replicas are built and compared slot by slot; no tree is descended.
AUDIT_SQL = """
with rec as (
  select 0 as replica, coalesce(page_id, -1) as node, coalesce(url, '') as url, coalesce(html, '') as html from pages
  union all
  select 1, coalesce(page_id, -1), coalesce(url, ''), coalesce(html, '') || case when page_id % 53 = 7 then '!' else '' end from pages where not coalesce(page_id % 97 = 5, false)
), bodies as (
  select replica, node, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) as record from rec
), copies as (
  select replica, node, sha256(record) as d, strlen(record) as size, count(*) as copies from bodies group by all
), lanes as (
  select replica, node, sha256(d || ':' || copies) as h, copies, size * copies as bytes from copies
), slots as (
  select replica, node, sha256(concat_ws(',', bit_xor(('0x' || substr(h, 1, 15))::bigint), bit_xor(('0x' || substr(h, 16, 15))::bigint),
    bit_xor(('0x' || substr(h, 31, 15))::bigint), bit_xor(('0x' || substr(h, 46, 15))::bigint), sum(copies)::bigint)) as digest,
    sum(copies)::bigint as records, sum(bytes)::bigint as bytes
  from lanes group by replica, node
), ours as (
  select *, coalesce(sum(bytes) over (order by node rows between unbounded preceding and 1 preceding), 0)::bigint as start_offset from slots where replica = 0
), theirs as (select * from slots where replica = 1),
nodes as (
  select node >> 4 as parent, sha256(string_agg(digest, '' order by node)) as node_digest from ours group by 1
)
select ours.node as page_id, ours.records, start_offset, ours.bytes as n_bytes, ours.digest, node_digest,
  case when theirs.node is null then 'missing' when (theirs.digest, theirs.bytes) <> (ours.digest, ours.bytes) then 'altered' else 'intact' end as status
from ours join nodes on ours.node >> 4 = parent left join theirs on theirs.node = ours.node
union all select theirs.node, null, null, null, null, null, 'extra' from theirs where not exists (select 1 from ours where ours.node = theirs.node)"""
