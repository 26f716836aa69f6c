"""What several operators of this package share: column picking, fold remainders, the shared folder, filters of keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lowered: what stands between the blanks 0x20 and 0x09 to 0x0D. For bytes, lower()
    and split() mean just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns of the input never reach an operator."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in types.items()])


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo `modulus`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only where all run on one machine may it be
    a temporary one: elsewhere each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"profseg-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Spark's setting that the shuffle files of a query go when it ends. Nobody reads them once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing but a reread. The
    shuffle files that made it are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/profseg-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/profseg-" in path:
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def keep_rows(docs: DataFrame, reads: list[str], masks: Callable[[], Callable[..., np.ndarray]]) -> DataFrame:
    """The rows of `docs` whose mask is true, with all their columns, whatever their names; nothing is shuffled. `masks` makes
    a function in each task, from a batch's arrays of the columns `reads` to its mask."""

    at = [docs.columns.index(c) for c in reads]
    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # names may hold dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = masks()
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                yield part.filter(pa.array(mask(*[part.column(i) for i in at]), pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


#: A row's identity among those of its table: 128 bits of its id and text. Rows alike in both are repeats of one row.
ROW_ID = ("_row_a", "_row_b")


def row_id(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    both = [F.col(doc_id).cast("long"), F.col(text).cast("string")]
    return [F.xxhash64(F.lit(salt), *both, *[x.isNull() for x in both]).alias(name) for salt, name in zip((17, 71), ROW_ID, strict=True)]


class Filter:
    """A Bloom filter of 64-bit hashes, of 16 to 32 bits a key, but never more than MOST_BITS: beyond that it lets more pass,
    which costs time and no results. False is certain."""

    LEAST_BITS, MOST_BITS, PROBES = 1 << 20, 1 << 30, 4

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    @staticmethod
    def probes(key: Column, size: int) -> Column:
        """The bits of a key; size is a power of two."""
        low, step = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1).cast("long"))
        return F.array(*[(low + step * F.lit(i)).bitwiseAND(F.lit(size - 1).cast("long")) for i in range(Filter.PROBES)])

    @classmethod
    def of(cls, keys: DataFrame, most_bits: int = MOST_BITS) -> Filter:
        """Of the `key` column (long) of a table; its bits are put together in the executors, a bucket a row."""
        size = 1 << min(max(16 * keys.count(), cls.LEAST_BITS) - 1, most_bits // 2).bit_length()
        bit = keys.select(F.explode(cls.probes(F.col("key"), size)).alias("bit"))
        rows = bit.select(F.shiftright("bit", 15).alias("bucket"), F.col("bit").bitwiseAND(F.lit(32767)).alias("bit"))
        bits = np.zeros(max(4096, size // 8), np.uint8)
        for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
            bits[r.bucket * 4096 : r.bucket * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
        return cls(size, bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (int64) may be one of the filter's."""
        out = np.ones(len(keys), bool)
        at = np.arange(len(keys))
        low, step = keys & 0xFFFFFFFF, keys >> 32 & 0xFFFFFFFF | 1
        for i in range(self.PROBES):  # each probe for those that are left
            bit = low[at] + i * step[at] & self.size - 1
            there = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            out[at[~there]] = False
            at = at[there]
        return out


def broadcast_filter(keys: DataFrame, most_bits: int = Filter.MOST_BITS) -> Broadcast:
    return keys.sparkSession.sparkContext.broadcast(Filter.of(keys, most_bits))


#: Rows of ROW_ID that are broadcast as they are, about 100 bytes each; of more, a filter is, and the rest are joined.
BROADCAST_ROWS = 300_000


def standing_for(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of `docs` (with ROW_ID) that are among `rows`, with the columns of both. No text of other rows is shuffled."""
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(rows), list(ROW_ID))
    return _maybe(docs, rows, True).join(rows, list(ROW_ID))


def _maybe(docs: DataFrame, rows: DataFrame, inside: bool) -> DataFrame:
    """Rows of `docs` (with ROW_ID) that may be among `rows`, or are certainly not."""
    shared = broadcast_filter(rows.select(F.col(ROW_ID[0]).alias("key")))
    return keep_rows(docs, [ROW_ID[0]], lambda: lambda keys: shared.value.passes(np.asarray(keys)) == inside)


def parted(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` in two parts: rows that are certainly not among `rows` (of ROW_ID), and the few others, these with their ROW_ID. Only
    the others need a join, so that no text of the first part is shuffled."""
    named = docs.select("*", *row_id())
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(rows.select(*ROW_ID).distinct())
        return named.join(ids, list(ROW_ID), "left_anti").select(*own_columns(docs)), named.join(ids, list(ROW_ID), "left_semi")
    return _maybe(named, rows, False).drop(*ROW_ID), _maybe(named, rows, True)
