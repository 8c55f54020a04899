import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import pieces as p
from strandlake.llm.queries import op8_piece_viterbi
from tests.llm.helpers import awkward_documents

P = pytest.importorskip("public_tokenizers")
S = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")

TEXT = st.lists(st.sampled_from(["the", "ing", "rrr", "$$$", " ", " ", "  ", "\n", "é", "日本", "🙂", "a", "aa", "llll", "%%%", "<s>", "<0x41>", "\x00", "x"]), max_size=25).map("".join)


@settings(deadline=None, max_examples=300)
@given(TEXT)
def test_bpe_ids_are_the_librarys(text):
    library = S.SentencePieceProcessor(model_file=PATH)
    made = p.load(PATH)
    ids = made.encode(text).tolist()
    assert ids == library.encode(text)
    assert made.decode(ids) == text == library.decode(ids)


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _model(kind, rows, byte_fallback=False):
    """A model file of (piece, score, kind) rows."""
    out = b""
    for piece, score, k in rows:
        out += _message(1, _message(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(k))
    trainer = _varint(3 << 3) + _varint(kind) + _varint(35 << 3) + _varint(int(byte_fallback))
    normalizer = _message(1, b"identity") + _varint(3 << 3) + b"\x01" + _varint(4 << 3) + b"\x00" + _varint(5 << 3) + b"\x01"
    return out + _message(2, trainer) + _message(3, normalizer)


UNI = _model(
    1,
    [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    + [(w, s, 1) for w, s in [("▁", -3.1), ("a", -2.3), ("b", -4.7), ("c", -5.2), ("ab", -4.9), ("abc", -7.85), ("bc", -6.3), ("▁a", -3.4), ("▁ab", -5.05), ("ca", -6.15), ("aa", -4.45), ("▁▁", -5.55)]],
)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="abc xé", max_size=30))
def test_unigram_paths_are_the_librarys(text):
    library = S.SentencePieceProcessor(model_proto=UNI)
    made = p.Pieces(p.Model(UNI))
    ids, other = made.encode(text).tolist(), library.encode(text)
    total = lambda path: sum(made.model.scores[i] for i in path)
    assert ids == other or total(ids) == pytest.approx(total(other), abs=1e-5) and ids.count(0) == other.count(0)  # pieces of one path in another order


def test_models_with_a_mapping_normalizer_are_refused():
    data = UNI + _message(3, _message(2, b"map"))
    with pytest.raises(ValueError):
        p.Model(data)


def test_query_against_the_library(spark, sf):
    library = S.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_piece_viterbi(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.round_trip and r.n_pieces == len(r.ids)


def test_awkward_rows(spark):
    docs = awkward_documents(spark).withColumn("ids", F.lit("mine")).withColumn("n_pieces", F.lit(0))
    out = p.encoded(docs, PATH)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    back = out.withColumn("back", p.decode(out, PATH)).collect()
    texts = sorted((r.text or "") for r in docs.collect())
    assert sorted(r.back for r in back) == texts
    assert p.encoded(docs.limit(0), PATH).count() == 0


def test_long_runs_of_spaces_take_time_in_proportion():
    library = S.SentencePieceProcessor(model_file=PATH)
    made = p.load(PATH)
    for text in (" " * 50_000 + "word", "  word" * 2000 + " " * 777):
        assert made.encode(text).tolist() == library.encode(text)
    assert len(made.encode(" " * 1_000_000)) > 0
