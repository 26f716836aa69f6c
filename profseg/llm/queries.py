"""The registered queries of this package, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fixity, langid, lm, manifest, pieces, quality, setsketch, topk, toxicity, variants
from .common import pick, read, remainder

Query = Callable[[SparkSession, str], DataFrame]


def bpe_files() -> tuple[str, str]:
    """The rank file and the pattern of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def piece_model() -> str:
    """The model file of the public vocabulary of pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), *bpe_files())


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lm.documents_of(read(spark, sf_dir, "documents"))
    held_out = remainder(F.col("doc_id"), 7) == 2
    return lm.train_and_score(docs, ~held_out, held_out)


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = pick(read(spark, sf_dir, "conversations"), **columns)
    return chat.conversation_digests(rows.unionByName(chat.planted_conversation(spark)))


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.documents_of(read(spark, sf_dir, "documents"))
    model = langid.train(docs, remainder(F.col("doc_id"), 3) != 1)
    found = langid.predict(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), split=True, most_items=0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.document_proofs(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(read(spark, sf_dir, "documents"))


def op13_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents"), piece_model())


_ALL = (op1_warc_fixity, op2_byte_bpe, op3_suffix_tree_lm, op4_setsketch_dedup, op5_chat_format, op6_impact_topk, op7_quality_rules, op8_toxicity_automata, op9_language_backoff, op10_template_decontamination, op11_merkle_manifest, op12_spelling_variants, op13_piece_chunks)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
_HAS_CONTROL = " or ".join(f"contains(text, '{c}')" for c in chat.CONTROLS)

ORACLE_SQL: dict[str, str] = {
    "op1_warc_fixity": fixity.AUDIT_SQL,
    "op4_setsketch_dedup": setsketch.NEAR_SQL,
    "op6_impact_topk": topk.TOPK_SQL,
    "op11_merkle_manifest": manifest.PROOF_SQL,
    "op12_spelling_variants": variants.VARIANTS_SQL,
    "op5_chat_format": f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, 3 + length(role) + 1 + 5
    + case role when 'user' then 15 when 'system' then 15 else 0 end
    + case when {_HAS_CONTROL} then 1 + length({_ESCAPED}) else length(text) end as chars
  from turns
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id""",
}
