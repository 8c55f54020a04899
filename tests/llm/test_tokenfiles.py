import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import tokenfiles as t
from strandlake.llm.queries import op3_token_files
from tests.llm.helpers import awkward_documents

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 500), max_size=200))
def test_elias_fano_round_trip(gaps):
    ends = np.cumsum(np.array(gaps, np.int64)) if gaps else np.zeros(0, np.int64)
    universe = int(ends[-1]) if gaps else 0
    data = b"xx" + t.ef_encode(ends, universe) + b"tail"
    ef = t.EliasFano(data, 2, len(ends), universe)
    assert data[ef.end :] == b"tail"
    assert ef.select_range(0, len(ends)).tolist() == ends.tolist() == [ef.select(i) for i in range(len(ends))]
    for lo in range(0, len(ends), 37):
        assert ef.select_range(lo, lo + min(50, len(ends) - lo)).tolist() == ends[lo : lo + 50].tolist()
    with pytest.raises(IndexError):
        ef.select(len(ends))


def test_elias_fano_is_small():
    ends = np.arange(1, 100_001) * 1000
    assert len(t.ef_encode(ends, int(ends[-1]))) * 8 < 100_000 * (2 + 10 + 0.1)


def test_block_round_trip():
    ids = np.arange(10, dtype="<u2").tobytes()
    data = t.pack_block(3, 4, [None, 5, 7], [1, 4, 5], ids, 2) + b"\n"
    b = t.Block(data)
    assert b.end == len(data) and t.Block(data + data, b.end).tokens(1).tolist() == [1, 2, 3, 4]
    assert (b.part, b.block, b.n, b.nulls, list(b.doc_ids(0, 3)), list(b.doc_ids(2, 3))) == (3, 4, 3, 1, [pd.NA, 5, 7], [7])
    assert [b.tokens(i).tolist() for i in range(3)] == [[0], [1, 2, 3, 4], [5, 6, 7, 8, 9]]
    with pytest.raises(ValueError):
        t.Block(b"SLTOK1" + bytes(60))


def test_doc_ids_of_any_size():
    known = [-(2**63), -(2**63), -5, 0, 2**63 - 1]
    b = t.Block(t.pack_block(0, 0, [None, None, *known], [0] * 7, b"", 2) + b"\n")
    assert list(b.doc_ids(0, 7)) == [pd.NA, pd.NA, *known] and list(b.doc_ids(3, 6)) == known[1:4]


def test_a_block_is_small():
    """Boundaries and ids of documents take some bits, not 64-bit numbers."""
    data = t.pack_block(0, 0, list(range(0, 400_000, 4)), [250] * 100_000, b"", 2)
    assert len(data) * 8 < 100_000 * (2 + 8 + 2 + 3)


WHITE = st.sampled_from(["a", "b's", "é", "日", " ", " ", "\n", "\t", "\xa0", "\x1c", "\x00", ".", "!'", "12", "_", "<|endoftext|>"])


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(WHITE, max_size=12).map("".join), max_size=8))
def test_parts_give_the_tokenizers_ids(texts):
    encoder, plain = t.Encoder(PATH), Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.texts(pa.array(texts, pa.string()))] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def _expected(rows):
    plain, start, out = Tokenizer.from_file(PATH), 0, []
    made = [(r, plain.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in rows]
    packed = lambda ids: np.array(ids, "<u2").tobytes()
    for r, ids in sorted(made, key=lambda m: (m[0].doc_id is not None, m[0].doc_id or 0, xxhash.xxh64_intdigest(packed(m[1])), packed(m[1]))):
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark, sf):
    got = [tuple(r) for r in op3_token_files(spark, sf).orderBy("doc_id").collect()]
    assert got == _expected(spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.mark.parametrize("block", [5, 2_000_000])
def test_awkward_rows(spark, block):
    docs = awkward_documents(spark).withColumn("start", F.lit("mine")).withColumn("block", F.lit(1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in t.token_offsets(docs, PATH, block_ids=block).collect()), key=key)
    assert got == sorted(_expected(docs.collect()), key=key)
    assert t.token_offsets(docs.limit(0), PATH).count() == 0


def test_special_tokens_become_their_ids(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>", "a\n<|endoftext|>\n b <|end oftext|>"]
    assert plain.token_to_id("<|endoftext|>") in plain.encode(texts[0], add_special_tokens=False).ids
    got = t.token_offsets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_an_id_with_most_rows_is_dealt_to_several_parts(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text number {i % 50}") for i in range(600)] + [(None, f"none {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in t.token_offsets(docs, PATH, path=str(tmp_path / "f"), block_ids=100).collect()))
    want = sorted((d is not None, d or 0, *rest) for d, *rest in _expected(docs.collect()))
    assert got == want
    assert t.read_token_files(spark, str(tmp_path / "f")).where("doc_id = 7").select("part").distinct().count() > 1
