"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Every vocabulary entry becomes a piece whose bytes are mapped to printable characters, scored by its negative rank,
under the identity normaliser; sentencepiece then merges in rank order. A text is cut into pre-tokens first and each is
encoded separately; decoding maps ids back to bytes. Nulls count as empty texts, which have no ids. Extra columns are
ignored, repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: Distinct pre-tokens that a worker remembers; beyond it the memory is emptied, which changes no result.
CACHE_ENTRIES = 100_000
#: Pre-tokens of more characters aren't remembered.
CACHE_CHARS = 40
#: Texts whose ids a worker holds at once, and so many ids beyond which it gives them out earlier.
SLICE_ROWS, SLICE_IDS = 256, 200_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints it, else the next free one from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary by rank. The file has a base64 entry and its rank on each line."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is vocabulary entry i; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    alphabet = byte_alphabet()
    model = proto.ModelProto()
    for rank, entry in enumerate(vocabulary):
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(alphabet[b] for b in entry), -float(rank), proto.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", -float(len(vocabulary)), proto.ModelProto.SentencePiece.UNKNOWN
    trainer, normaliser = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id = proto.TrainerSpec.BPE, len(model.pieces), len(vocabulary)
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    normaliser.name = "identity"
    normaliser.add_dummy_prefix = normaliser.remove_extra_whitespaces = normaliser.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: list[bytes], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.vocabulary = vocabulary
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model or serialise(vocabulary))
        self.whole = {entry: (rank,) for rank, entry in enumerate(vocabulary)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        ids = self.whole.get(raw)
        if ids is None:
            ids = tuple(self.processor.encode(raw.decode("latin-1").translate(self.alphabet)))
        if len(token) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for token in self.split(text):
            ids += known.get(token) or self._piece(token)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def _codec_batches(vocabulary: list[bytes], pattern: str, with_ids: bool):
    model = serialise(vocabulary)

    fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern, model)
        names = list(map(str, range(len(vocabulary))))
        keys, counts, digests, back, buffers = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(buffers))))
            for held in (keys, counts, digests, back, buffers):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, fields)

        waiting = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = codec.encode(text.as_py() or "")
                keys.append(key.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    buffers.append(np.array(ids, np.int32))
                waiting += len(ids)
                if len(keys) >= SLICE_ROWS or waiting >= SLICE_IDS:
                    yield flush()
                    waiting = 0
        if keys:
            yield flush()

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text, and what decoding them gives, as digests; `with_ids` adds the ids themselves.

    The vocabulary (its file's size bounds it) is read on the driver and sent to the workers with the function. No
    shuffle: a lost task re-encodes its own split. A worker holds one input batch, the ids of a slice of it and one bounded
    cache.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return pick(docs, doc_id="long", text="string").mapInArrow(_codec_batches(read_ranks(ranks_path), pattern, with_ids), schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes): the inverse mapping. Null ids give no bytes."""
    vocabulary = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(map(vocabulary.__getitem__, ids.as_py() or [])) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, bytes binary")
