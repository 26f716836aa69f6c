"""Pieces by distinct chunks, against the sentencepiece library itself."""

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from profseg.llm import common, pieces
from profseg.llm.queries import QUERIES, piece_model

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def odd_texts():
    rnd = random.Random(5)
    fixed = [None, "", " ", "  ", "   a", "a ", "a  ", "▁", "a▁b", " ▁ x", "\n\n x\t y", "<s> </s> <unk> <0x41>", "\U0001f600 中文 \x00 z", "x" * 3000, "y " * 500, " " * 700, "é" * 150 + " " + "z" * 300]
    return fixed + ["".join(rnd.choice("ab ▁\né中<s>") for _ in range(rnd.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize("head", [0, 5, 1 << 20])
def test_ids_and_texts_are_the_librarys(spark, library, head):
    rows = [(i % 50 if i % 7 else None, text) for i, text in enumerate(odd_texts())]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), piece_model(), head_chunks=head).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(key, *expected(library, text)) for key, text in rows], key=str)


def test_filter_that_lets_all_pass(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "FILTER_BITS", 2)
    monkeypatch.setattr(common.Filter, "LEAST_BITS", 1)
    rows = [(i, text) for i, text in enumerate(odd_texts())]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), piece_model(), head_chunks=0).collect()
    assert sorted(map(tuple, got)) == [(key, *expected(library, text)) for key, text in rows]


def test_repeats_clashing_columns_and_empty_tables(spark, library):
    rows = [(1, "one word and one more", 5, b"x", "y")] * 3 + [(None, "one word", 6, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, known binary, chunk string")
    got = pieces.encode_documents(df, piece_model(), with_ids=True, head_chunks=1)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == sorted([(r[0], *expected(library, r[1])) for r in rows], key=str)
    back = {r.doc_id: r.text for r in pieces.decode_documents(got, piece_model()).collect()}
    assert back == {1: "one word and one more", None: "one word"}
    assert pieces.encode_documents(df.limit(0), piece_model()).collect() == []


def test_chunks_join_to_the_text():
    texts = [t for t in odd_texts() if t is not None]
    keys, counts = pieces.chunks(pa.array(texts))
    keys, at = keys.to_pylist(), 0
    for text, n in zip(texts, counts, strict=True):
        whole = "".join("▁" + k.replace(" ", "▁") for k in keys[at : at + n])
        assert whole == ("▁" + text.replace(" ", "▁") if text else "")
        at += n
    assert at == len(keys)


def test_models_that_cross_markers_are_refused(tmp_path):
    model = proto.ModelProto.FromString(open(piece_model(), "rb").read())
    model.pieces[300].piece = "a▁b"
    path = tmp_path / "crossing.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="crosses"):
        pieces.read_model(str(path))


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_piece_chunks"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *expected(library, r.text)) for r in docs)
