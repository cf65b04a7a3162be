"""Piece encoding against the library, round trips, heap order against rounds, odd inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tabwright.llm import piece_merges, piece_model, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "b", "e", "t", "h", " ", "  ", "the", "▁", "日本", "中", "\n", "\t", "0", "é", "𝄞", "ा", "в", "ing",
    "<s>", "<0x41>", "\x00", "�", "==", " " * 9, "----",
]


@pytest.fixture(scope="module")
def model():
    return piece_model.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(model):
    draw = random.Random(11)
    found = ["", " ", "\x00", "a" * 5000, " " * 5000, "▁" * 7, "= " * 300, "-" * 3001, "ab " * 2000, "日" * 3000]
    found += ["".join(draw.choices(PARTS, k=draw.randint(1, 60))) for _ in range(800)]
    found += ["".join(draw.choices(PARTS[:7], k=draw.randint(1, 400))) for _ in range(100)]
    letters = [chr(c) for c in model.alphabet]
    found += ["".join(draw.choices(letters, k=draw.randint(1, 200))) for _ in range(100)]
    found += ["".join(draw.choice("=-*#_ ") * draw.randint(1, 50) for _ in range(5)) for _ in range(100)]
    return found


def test_ids_and_texts_are_the_library_s(model, library):
    given = texts(model)
    found = piece_merges.Encoder(model).encode(given)
    expected = library.encode(given, add_bos=True, add_eos=True)
    assert [f.tolist() for f in found] == expected
    assert [piece_merges.decode_ids(f, model) for f in found] == library.decode(expected)
    plain = piece_merges.Encoder(model).encode(given[:50], ends=False)
    assert [f.tolist() for f in plain] == library.encode(given[:50])


def test_long_texts_in_parts(model, library, monkeypatch):
    monkeypatch.setattr(piece_merges, "SLICE_POINTS", 40)
    given = texts(model)[:300]
    found = piece_merges.Encoder(model).encode(given)
    assert [f.tolist() for f in found] == library.encode(given, add_bos=True, add_eos=True)


def test_any_ids_decode_alike(model, library):
    draw = random.Random(12)
    for _ in range(1500):
        ids = [draw.randrange(32_000) if draw.random() < 0.5 else draw.randrange(259) for _ in range(draw.randint(0, 12))]
        assert piece_merges.decode_ids(np.array(ids, dtype=np.int64), model) == library.decode(ids)


def test_heap_order_equals_rounds(model, monkeypatch):
    given = [t for t in texts(model) if t]
    by_rounds = piece_merges.Encoder(model).encode(given)
    monkeypatch.setattr(piece_merges, "LONG_TIE", 1)
    assert all(np.array_equal(a, b) for a, b in zip(by_rounds, piece_merges.Encoder(model).encode(given), strict=True))


def test_frames(spark, model, library):
    rows = [(1, None, "x", 5), (2, "", "y", 6), (2, "two words", None, 7), (2, "two words", None, 7), (None, "w" * 3_000_000, "z", 8)]
    schema = "doc_id long, text string, ids string, `a b` int"
    frame = spark.createDataFrame(rows, schema)
    found = piece_merges.encode(frame, model)
    assert found.columns == ["doc_id", "text", "a b", "ids", "n_tokens"]
    back = piece_merges.decode(found, model).collect()
    assert sorted((r["a b"], r.doc_id, r.decoded) for r in back) == sorted((r[3], r[0], r[1] or "") for r in rows)
    for row in back:
        expected = library.encode(row.text or "", add_bos=True, add_eos=True)
        assert row.n_tokens == len(expected) and bytes(row.ids) == np.array(expected, dtype="<u4").tobytes()
    assert piece_merges.decode(piece_merges.encode(frame.where("false"), model), model).count() == 0
    packed = spark.createDataFrame([(None, 1), (b"", 2), (b"\x01\x00\x00\x00\x05", 3)], "ids binary, decoded int")
    assert [r.decoded for r in piece_merges.decode(packed, model).collect()] == [None, "", ""]


def test_query(spark, sf, library):
    found = {r.doc_id: r for r in queries.QUERIES["op11_piece_merges"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    for row in docs:
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        own = found[row.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    other = tmp_path / "other.model"
    other.write_bytes(data + b"\x1a\x02\x20\x01")  # a normalizer that drops repeated spaces
    with pytest.raises(ValueError):
        piece_model.load(str(other))
