"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last keep the columns of `docs`.

In every stage: a null text counts as empty, a null id is an id like any other, columns beside doc_id and text pass through
whatever their names, an empty table gives an empty one. Repeated rows are judged alike; only near_duplicates makes one of
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, quality, setsketch
from .common import ROW_ID, own_columns, parted, pick, read, written
from .queries import bpe_files

#: A language is taken for known from this score on.
LEAST_LANGUAGE_SCORE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from all labels, doesn't reject. Empty texts are scored like others."""
    model = quality.train(pick(docs, doc_id="long", text="string"), read(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep(docs, model)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus: not `und` (as texts without letters are), and with a sure enough
    score."""
    return langid.keep(docs, langid.train(langid.documents_of(docs), F.lit(True)), LEAST_LANGUAGE_SCORE)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id (null last), then by a hash of id and text.

    Rows that share an id, or have none, are one only if their texts are near-duplicates. Texts without a word are in no
    group and all stay. Most rows are kept: a filter tells those that surely are, and only the others are joined.
    """
    found = written(setsketch.grouped(docs).filter("label is not null").select("label", "doc_id", *ROW_ID), "pipeline-near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_ID)
    first = found.groupBy("label").agg(F.min(order).alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in ROW_ID], F.lit(True).alias("_stays"))
    # rows that may go: those that aren't the first of their group, and repeats of one that is
    copies = found.groupBy(*ROW_ID).agg(F.count("*").alias("copies")).join(first, list(ROW_ID), "left")
    open_ = written(copies.filter("_stays is null or copies > 1").select(*ROW_ID, F.coalesce("_stays", F.lit(False)).alias("_stays")), "pipeline-open")
    kept, maybe = parted(docs, open_)
    left = maybe.join(open_, list(ROW_ID), "left").filter("_stays is null or _stays")
    left = left.withColumn("_one", F.when(F.col("_stays").isNull(), F.monotonically_increasing_id()))
    return kept.unionByName(left.dropDuplicates([*ROW_ID, "_one"]).select(*own_columns(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; empty ones contain none."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"), split=True, most_items=0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every whole text: doc_id, n_tokens, digests and ids. An empty text has no ids."""
    return bpe.encode_documents(docs, *bpe_files(), with_ids=True)
