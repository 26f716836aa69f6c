"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers and what follows up to the next marker. Where no piece of the model holds a marker
behind another character, merges never cross chunks, so that a text's ids are those of its chunks, one after the other.
Each distinct chunk that the corpus holds twice is segmented once, into a table of its ids. The most frequent, HEAD_CHUNKS at
most, are broadcast from it; every other place of a text is joined with the table and its ids come back by position. A
chunk that occurs once is segmented where it stands, which is once as well; a filter of bounded size tells that it isn't
in the table. Chunks of more than LONG_BYTES, which hardly ever repeat, are segmented there too, so that no long key is shuffled.

Nulls count as empty texts,
which have the end id alone. Repeated rows give repeated results, a null id is kept, extra columns are ignored, an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, broadcast_filter, drop_written, pick, row_id, written

MARK = "▁"
#: Chunks whose ids every task holds, some 40 bytes each.
HEAD_CHUNKS = 1 << 19
LONG_BYTES = 200
#: Bits of the filter at most.
FILTER_BITS = 1 << 27
#: Texts that are looked up at a time, and distinct chunks that a counting task holds.
SLICE_BYTES, COUNTED = 4 << 20, 400_000


def read_model(path: str) -> bytes:
    """The model of a file, if chunks can be segmented apart by it."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        raw = file.read()
    model = proto.ModelProto.FromString(raw)
    normaliser = model.normalizer_spec
    if normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or not (normaliser.add_dummy_prefix and normaliser.escape_whitespaces):
        raise ValueError("the normaliser must be the identity, with a marker put first and blanks turned into markers")
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with markers before words is needed")
    if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
        raise ValueError("a piece crosses a whitespace marker")
    return raw


def marked_model(raw: bytes) -> bytes:
    """The same model for texts that have their markers already."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto.FromString(raw)
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def processor(raw: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=raw)


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, without their first marker and with blanks for their others, and how many each text has."""
    texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
    full = np.asarray(pc.binary_length(texts)) > 0
    counts = np.zeros(len(texts), np.int64)
    lists = pc.split_pattern(texts.filter(pa.array(full)), " ")
    ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
    parts = lists.flatten()
    kept = np.asarray(pc.binary_length(parts)) > 0  # an empty part is one more blank before the next
    kept[ends - 1] = True
    at = np.flatnonzero(kept)
    blanks = np.diff(at, prepend=-1) - 1
    keys = parts.filter(pa.array(kept))
    counts[full] = np.diff(np.searchsorted(at, ends), prepend=0)
    if blanks.any():
        more = pa.array(blanks > 0)
        spaced = pc.binary_join_element_wise(pc.binary_repeat(pa.array([" "] * int((blanks > 0).sum())), pa.array(blanks[blanks > 0])), keys.filter(more), "")
        keys = pc.replace_with_mask(keys, more, spaced)
    return keys, counts


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES of text, a row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def is_long(keys: pa.Array) -> np.ndarray:
    return np.asarray(pc.binary_length(keys)) > LONG_BYTES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    waiting = 0

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")])
        return table.rename_columns(["chunk", "n"])

    for batch in batches:
        for part in slices(batch, 0):
            keys, _ = chunks(part.column(0))
            found = pc.value_counts(keys.filter(pa.array(~is_long(keys))))
            held.append(pa.table({"chunk": found.field("values"), "n": found.field("counts")}))
            waiting += len(found)
            if waiting > COUNTED:
                held[:] = [merged()]
                waiting = held[0].num_rows
                if waiting > COUNTED // 2:
                    yield from held.pop().to_batches(65536)
                    waiting = 0
    if held:
        yield from merged().to_batches(65536)


def segmented(own, keys: pa.Array) -> list[list[int]]:
    return own.encode([MARK + key.replace(" ", MARK) for key in keys.to_pylist()])


def chunk_table(docs: DataFrame, model: bytes) -> DataFrame:
    """(chunk, n, ids) of each distinct chunk that all texts together hold twice, written. Counts add up in the tasks before
    the shuffle."""
    counted = docs.select("text").mapInArrow(_count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    marked = marked_model(model)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(marked)
        for batch in batches:
            ids = segmented(own, batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["chunk", "n", "ids"])

    return written(counted.mapInArrow(segment, "chunk string, n long, ids array<int>"), "pieces-chunks")


class Head(NamedTuple):
    """The chunks that tasks hold: chunk i has the ids flat[offsets[i]:offsets[i + 1]]."""

    chunks: pa.Array
    offsets: np.ndarray
    flat: np.ndarray

    def find(self, keys: pa.Array) -> np.ndarray:
        """The place of each key, or -1."""
        return np.asarray(pc.index_in(keys, value_set=self.chunks).fill_null(-1))


def head_of(table: DataFrame, most: int) -> tuple[Head, DataFrame]:
    """The most frequent chunks, `most` at most: all from some count on, found by the numbers of chunks of like count; and the
    rest of the table."""
    like = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in sorted(table.groupBy(like.alias("like")).agg(F.count("*").alias("chunks")).collect(), key=lambda r: -r.like):
        left -= row.chunks
        if left < 0:
            break
        least = row.like
    inside = like >= least if least is not None else F.lit(False)
    found = table.filter(inside).select("chunk", "ids").toArrow().combine_chunks()
    words, ids = (found.column(i).combine_chunks() for i in range(2))
    head = Head(words, np.asarray(ids.offsets).astype(np.int64) - (ids.offsets[0].as_py() if len(ids.offsets) else 0), np.asarray(ids.flatten()))
    return head, table.filter(~inside).select("chunk", "ids")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s:s + n] of all starts and lengths, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(lengths.sum()) - np.repeat(before - starts, lengths)]


def _looked_up(docs: DataFrame, shared: tuple, make: Callable, schema: str) -> DataFrame:
    """`make` of each slice's rows: its columns, keys, chunks a text, places in the head, and which chunks to ask the table for
    and to segment there."""
    head, rest = shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, inside = head.value, rest.value
        use = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                keys, counts = chunks(part.column(part.num_columns - 1))
                at = held.find(keys)
                ask = at < 0
                ask[ask] = ~is_long(keys.filter(pa.array(ask)))
                hashes = np.array([xxhash.xxh64_intdigest(key, 42) for key in keys.filter(pa.array(ask)).to_pylist()], np.uint64)  # as Spark's xxhash64
                ask[ask] = inside.passes(hashes.view(np.int64))
                yield use(part, keys, counts, at, ask, (at < 0) & ~ask)

    return docs.mapInArrow(run, schema)


def _asked(docs: DataFrame, shared: tuple) -> DataFrame:
    """(ROW_ID, place, chunk): the chunks of a text that the table is asked for, numbered."""

    def make():
        def use(part, keys, counts, at, ask, alone):
            text = np.repeat(np.arange(part.num_rows), counts)[ask]
            place = np.arange(len(text)) - np.searchsorted(text, text)
            rows = pa.array(text)
            return pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(place.astype(np.int32)), keys.filter(pa.array(ask))], [*ROW_ID, "place", "chunk"])

        return use

    return _looked_up(docs.select(*ROW_ID, "text"), shared, make, "_row_a long, _row_b long, place int, chunk string")


def _answered(asked: DataFrame, table: DataFrame, model: bytes) -> DataFrame:
    """(ROW_ID, place, ids). What the filter let pass though the table lacks it is segmented here."""
    marked = marked_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(marked)
        for batch in batches:
            *keys, chunk, ids = batch.columns
            lacks = np.asarray(ids.is_null())
            if lacks.any():
                at = np.where(lacks, len(ids) + np.cumsum(lacks) - 1, np.arange(len(ids)))
                ids = pa.concat_arrays([ids, pa.array(segmented(own, chunk.filter(pa.array(lacks))), ids.type)]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*keys, ids], [*ROW_ID, "place", "ids"])

    joined = asked.join(table, "chunk", "left").select(*ROW_ID, "place", "chunk", "ids")
    return joined.mapInArrow(run, "_row_a long, _row_b long, place int, ids array<int>")


def _known(docs: DataFrame, shared: tuple, model: bytes) -> DataFrame:
    """(doc_id, ROW_ID, known): the ids of a text as bytes, with the number of pieces for each chunk that the table is asked for."""
    marked = marked_model(model)

    def make():
        held, own = shared[0].value, processor(marked)
        hole = own.get_piece_size()
        kind = np.uint16 if hole < 1 << 16 else np.int32

        def use(part, keys, counts, at, ask, alone):
            more = segmented(own, keys.filter(pa.array(alone)))
            flat = np.concatenate([held.flat, [hole], *more]).astype(kind)
            sizes = np.array([len(x) for x in more], np.int64)
            starts, lengths = np.full(len(at), len(held.flat)), np.ones(len(at), np.int64)
            there = at >= 0
            starts[there], lengths[there] = held.offsets[at[there]], np.diff(held.offsets)[at[there]]
            starts[alone], lengths[alone] = len(held.flat) + 1 + np.cumsum(sizes) - sizes, sizes
            ids = gather(flat, starts, lengths)
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)] * ids.itemsize
            known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), known.cast(pa.binary())], ["doc_id", *ROW_ID, "known"])

        return use

    return _looked_up(docs.select("doc_id", *ROW_ID, "text"), shared, make, "doc_id long, _row_a long, _row_b long, known binary")


def _filled(model: bytes, with_ids: bool) -> Callable:
    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        hole, end = own.get_piece_size(), own.eos_id()
        kind = np.uint16 if hole < 1 << 16 else np.int32
        names = list(map(str, range(hole)))
        for batch in batches:
            out = [[] for _ in fields]
            for doc_id, known, place, sizes, brought in zip(*batch.columns, strict=True):
                ids = np.frombuffer(known.as_py(), kind)
                holes = np.flatnonzero(ids == hole)
                if len(holes):
                    long_gaps = np.asarray(place.values)
                    if len(long_gaps) != len(holes) or (np.diff(long_gaps) <= 0).any():
                        raise ValueError("a chunk of a text has no ids")
                    lengths = np.ones(len(ids), np.int64)
                    lengths[holes] = np.asarray(sizes.values)
                    filled = np.repeat(ids.astype(np.int32), lengths)
                    filled[np.repeat(ids == hole, lengths)] = np.asarray(brought.values)
                    ids = filled
                ids = [*ids.tolist(), end]
                row = [doc_id.as_py(), len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest(), ids]
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], fields)

    return run


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False, head_chunks: int = HEAD_CHUNKS) -> DataFrame:
    """Ids of every whole text with the end id behind, and what decoding them gives, as digests; `with_ids` adds the ids.

    Texts are never shuffled: what meets the ids of rarer chunks are the ids that are known of a text, two bytes each. The
    model's file bounds what is read on the driver.
    """
    model = read_model(model_path)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", *row_id(), "text")
    table = chunk_table(rows, model)
    head, rest = head_of(table, head_chunks)
    shared = docs.sparkSession.sparkContext.broadcast(head), broadcast_filter(rest.select(F.xxhash64("chunk").alias("key")), FILTER_BITS)
    # a set, since repeated rows ask for the same
    brought = _answered(_asked(rows, shared), rest, model).groupBy(*ROW_ID).agg(F.array_sort(F.collect_set(F.struct("place", "ids"))).alias("brought"))
    brought = brought.select(*ROW_ID, F.transform("brought", lambda x: x["place"]).alias("place"), F.transform("brought", lambda x: F.size(x["ids"])).alias("sizes"), F.flatten(F.transform("brought", lambda x: x["ids"])).alias("ids"))
    brought = written(brought, "pieces-brought")
    drop_written(table)
    both = _known(rows, shared, model).join(brought, list(ROW_ID), "left").select("doc_id", "known", "place", "sizes", "ids")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return both.mapInArrow(_filled(model, with_ids), schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text) by the library. Null ids give an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = processor(model)
        for batch in batches:
            out = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")
