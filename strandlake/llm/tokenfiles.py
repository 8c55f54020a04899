"""Token-id files with Elias-Fano document boundaries.

A file holds a few blocks, each with documents in ascending doc_id order (nulls first, then by a hash of the ids, then by
the ids), little-endian, and each closed by a newline:

    magic "SLTOK2" | version u8 | id width in bytes u8 (2 or 4)
    part u32 | block u32 | documents n u64 | of these with null doc_id z u64 | ids u64
    least doc_id i64 | greatest less least doc_id u64
    Elias-Fano of the n document ends: low bits l u8 | low words u64 x ceil(n*l/64) |
        high words u64 x ceil((n + (u >> l) + 1) / 64), u = ids
    Elias-Fano of the n - z doc_ids less the least one | ids | newline

An Elias-Fano part holds a monotone sequence (ids before each document's end, or doc_ids)
in n * (2 + ceil(log2(u / n))) bits about: the low l bits of each value packed, the high
bits as a unary-coded bitmap; value i is ((select1(i) - i) << l) | low(i). Nothing holds a
64-bit table of offsets. Readers go through ``select_range``: the select counts say which words of the bitmap
hold the values asked for, and only these are looked at, ``DOCS`` documents at a time.

Texts are encoded where they lie; the ids, not the texts, are shuffled, straight to the part whose range of doc_ids is
theirs (bounds by approximate quantiles of doc_id; a doc_id that fills several ranges is dealt to them by the hash). Spark
writes the files (a line of the text writer is one block) and reads them back as binary files, so any file system that Spark
reaches will do. A block closes once it has ``block_ids`` ids, a file once it has ``FILE_BLOCKS`` blocks; a document is never split.

Defined results: a null text is the empty text, whose ids are the end id alone; the vocabulary's special tokens in a text
become their ids, as the tokenizers library gives them; rows of one doc_id are ordered as above; an empty table
gives an empty table and no file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.batches import bound_batches, parts_for
from strandlake.plans.shared import new_path, written

MAGIC = b"SLTOK2"
HEAD = struct.Struct("<6sBBIIQQQqQ")
END_ID = 0
BLOCK_IDS = 2_000_000
CACHE = 300_000
LONGEST = 64
JOIN = 2000
POINTS = ".,;:!?"
# Fixed value: what str.isspace holds of, but for the space.
WHITE = "[\t-\r\x1c-\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SOME = 256
DOCS = 4096
FILE_BLOCKS = 8
PART_BYTES = 64 << 20


# Elias-Fano ---------------------------------------------------------------------------


def ef_encode(ends: np.ndarray, universe: int) -> bytes:
    """The monotone ``ends`` (each at most ``universe``): l, low words, high words."""
    n = len(ends)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    bits = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    high = np.zeros(n + (universe >> low) + 1, np.uint8)
    high[(ends >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    return bytes([low]) + _words(bits) + _words(high)


def _words(bits: np.ndarray) -> bytes:
    packed = np.packbits(bits, bitorder="little").tobytes()
    return packed + b"\0" * (-len(packed) % 8)


class EliasFano:
    """Reads an encoded sequence at ``at``; ``select`` gives values without decoding the others.

    Ones before every eighth 64-bit word of the bitmap are counted once; a select
    bisects these counts and looks at one such run of words.
    """

    def __init__(self, data: bytes, at: int, n: int, universe: int):
        self.n, self.low = n, data[at]
        n_low = -(-n * self.low // 64)
        n_high = -(-(n + (universe >> self.low) + 1) // 64)
        self._low = np.frombuffer(data, np.uint8, n_low * 8, at + 1)
        self._high = np.frombuffer(data, np.uint8, n_high * 8, at + 1 + n_low * 8)
        self.end = at + 1 + 8 * (n_low + n_high)
        ones = np.bitwise_count(self._high).astype(np.int64)
        run = np.add.reduceat(ones, np.arange(0, len(ones), 64)) if len(ones) else ones
        self._before = np.r_[0, np.cumsum(run)]

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1 as unsigned integers; only the words that hold them are read."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self._before, [lo, hi - 1], side="right") - 1
        bits = np.unpackbits(self._high[first * 64 : (last + 1) * 64], bitorder="little")
        place = np.flatnonzero(bits)[lo - self._before[first] : hi - self._before[first]] + first * 512
        at = lo * self.low
        raw = np.unpackbits(self._low[at // 8 : -(-hi * self.low // 8)], bitorder="little")[at % 8 :][: (hi - lo) * self.low].reshape(hi - lo, self.low)
        low = np.zeros(hi - lo, np.uint64)
        for j in range(self.low):
            low |= raw[:, j].astype(np.uint64) << np.uint64(j)
        return (place - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low) | low


# Blocks -------------------------------------------------------------------------------


def pack_block(part: int, block: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A block of documents in order of doc_id, nulls first."""
    ends = np.cumsum(np.array(lengths, np.int64))
    total = int(ends[-1]) if len(ends) else 0
    known = [d for d in doc_ids if d is not None]
    least, span = (known[0], known[-1] - known[0]) if known else (0, 0)
    head = HEAD.pack(MAGIC, 2, width, part, block, len(doc_ids), len(doc_ids) - len(known), total, least, span)
    above = np.array(known, np.int64).view(np.uint64) - np.array(least, np.int64).view(np.uint64)
    return head + ef_encode(ends, total) + ef_encode(above, span) + ids


class Block:
    """A block as read at ``at``; documents are found by select on the boundaries. ``end`` is where the next block begins."""

    def __init__(self, data: bytes, at: int = 0):
        magic, version, self.width, self.part, self.block, self.n, self.nulls, self.total, self._least, span = HEAD.unpack_from(data, at)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token block")
        self.bounds = EliasFano(data, at + HEAD.size, self.n, self.total)
        self._names = EliasFano(data, self.bounds.end, self.n - self.nulls, span)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.total, self._names.end)
        self.end = self._names.end + self.total * self.width + 1

    def doc_ids(self, lo: int, hi: int) -> pd.array:
        """doc_ids of documents lo to hi - 1, with nulls."""
        out = pd.array(np.zeros(hi - lo, np.int64), dtype="Int64")
        none = max(0, min(self.nulls, hi) - lo)
        above = self._names.select_range(lo + none - self.nulls, hi - self.nulls) if hi > self.nulls else np.zeros(0, np.uint64)
        out[none:] = (above + np.array(self._least, np.int64).view(np.uint64)).view(np.int64)
        out[:none] = pd.NA
        return out

    def edges(self, lo: int, hi: int) -> np.ndarray:
        """Where documents lo to hi - 1 begin, and the end of the last."""
        known = self.bounds.select_range(max(lo - 1, 0), hi).astype(np.int64)
        return known if lo else np.r_[0, known]

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.edges(i, i + 1)
        return self.ids[start:end]


# Encoding -----------------------------------------------------------------------------


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as bytes.

    The vocabulary's pattern never joins text across the start of a run of spaces or newlines, so
    a text is cut there and the parts seen before come from a bounded cache. Nor does it join a letter and a point or
    comma after it, so a new part that ends so takes its word's ids. New words of a batch are joined to one string
    for the tokenizer; the ids' lengths in bytes, which a byte-level vocabulary fixes, tell them apart again.
    Arrow does all but the tokenizer's work: parts are numbered, looked up and put together in columns.
    """

    def __init__(self, path: str):
        self._made = _tokenizer(path)
        size = self._made.get_vocab_size()
        self.width = self.width_of(path)
        self._kind = f"<u{self.width}"
        self._keys, self._codes = pa.array([], pa.string()), pa.array([], pa.binary())
        # A byte-level vocabulary writes each byte as one character.
        self._lengths = np.array([len(self._made.id_to_token(i) or "") for i in range(size)], np.int64)
        # Special tokens, and what lies between them, are found in whole texts only.
        self._special = [t.content for t in self._made.get_added_tokens_decoder().values()]
        self._points = pa.array([c for c in POINTS], pa.string())
        self._point_codes = pa.array([self.alone(c) for c in POINTS], pa.binary())

    @staticmethod
    def width_of(path: str) -> int:
        """Bytes of an id."""
        return 2 if _tokenizer(path).get_vocab_size() <= 1 << 16 else 4

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._made.encode_batch_fast([text], add_special_tokens=False)[0].ids, self._kind)

    def alone(self, text: str) -> bytes:
        """Ids of one text by the tokenizer itself."""
        return self._ids(text).tobytes() if text else b""

    def _in_line(self, keys: pa.StringArray) -> pa.BinaryArray:
        """Ids of words after a space, or after the newline that they begin with."""
        spaced = pc.if_else(pc.starts_with(keys, "\n"), keys, pc.binary_join_element_wise("", keys, " "))
        sizes = pc.binary_length(spaced).to_numpy()
        raw, ends, at = [], [np.zeros(1, np.int64)], 0
        for lo in range(0, len(keys), JOIN):
            some = spaced.slice(lo, JOIN)
            ids = self._ids("".join(some.to_pylist()))
            stop = np.searchsorted(np.cumsum(self._lengths[ids]), np.cumsum(sizes[lo : lo + len(some)], dtype=np.int64), side="left") + 1
            raw.append(ids.tobytes())
            ends.append(at + stop * self.width)
            at += len(raw[-1])
        offsets = np.concatenate(ends).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(raw))])

    def _learn(self, keys: pa.StringArray) -> pa.BinaryArray:
        """Ids of parts: a word for itself after a space, newline and word, NUL and word for the word itself.

        A part without a word, or with other white space or a special token in it, has none (null): such texts are encoded whole.
        """
        first, after_line = pc.starts_with(keys, "\0"), pc.starts_with(keys, "\n")
        bare = pc.if_else(pc.or_(first, after_line), pc.utf8_slice_codeunits(keys, 1), keys)
        bad = pc.or_(pc.equal(bare, ""), pc.match_substring_regex(bare, WHITE))
        for token in self._special:
            bad = pc.or_(bad, pc.match_substring(bare, token))
        pointed = pc.and_(pc.match_substring_regex(bare, f"\\pL[{POINTS}]$"), pc.invert(pc.or_(first, bad)))
        base = pc.if_else(pc.or_(first, bad), None, pc.if_else(pointed, pc.utf8_slice_codeunits(keys, 0, -1), keys))
        words = pc.unique(base.drop_null())
        fresh = words.filter(pc.is_null(pc.index_in(words, self._keys)))
        known, codes = pa.concat_arrays([self._keys, fresh]), pa.concat_arrays([self._codes, self._in_line(fresh)])
        out = codes.take(pc.index_in(base, known, skip_nulls=True))
        end = self._point_codes.take(pc.index_in(pc.utf8_slice_codeunits(keys, -1), self._points))
        out = pc.if_else(pointed, pc.binary_join_element_wise(out, pc.fill_null(end, b""), b""), out)
        own = pc.and_(first, pc.invert(bad))
        if pc.any(own).as_py():
            made = pa.array([self.alone(w) for w in bare.filter(own).to_pylist()], pa.binary())
            out = pc.replace_with_mask(out, own, made)
        return out

    def texts(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for odd in ("\0", *self._special):
            whole |= pc.match_substring(texts, odd).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        edges = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())].astype(np.int32)
        coded = pc.list_flatten(cut).dictionary_encode()
        keys, part = coded.dictionary, coded.indices
        del cut, coded
        at = pc.index_in(keys, self._keys)
        made = self._codes.take(at)
        new = pc.is_null(at)
        if pc.any(new).as_py():
            made = pc.replace_with_mask(made, new, self._learn(keys.filter(new)))
        none = pc.is_null(made).to_numpy(zero_copy_only=False)
        if none.any():
            whole[np.searchsorted(edges, np.flatnonzero(none[part.to_numpy()]), side="right") - 1] = True
        keep = pc.and_(pc.is_valid(made), pc.less_equal(pc.binary_length(keys), LONGEST))
        old = pc.is_null(pc.index_in(self._keys, keys))  # what this batch did not use is the first to go
        self._keys = pa.concat_arrays([keys.filter(keep), self._keys.filter(old)]).slice(0, CACHE)
        self._codes = pa.concat_arrays([made.filter(keep), self._codes.filter(old)]).slice(0, CACHE)
        out = pc.binary_join(pa.ListArray.from_arrays(edges, pc.fill_null(made, b"").take(part)), b"").to_pylist()
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.alone(texts[i].as_py())
        return out


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, whose cache serves all tasks that the worker runs."""
    return Encoder(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, bounds: list[int]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, h, ids) of each text; h is a hash of the ids as an unsigned number's signed twin."""
    encoder, edges = encoder_of(path), np.array(bounds, np.int64)
    end = np.array([END_ID], f"<u{encoder.width}").tobytes()
    for batch in batches:
        doc = pc.fill_null(batch["doc_id"], np.iinfo(np.int64).min).to_numpy()
        first, last = np.searchsorted(edges, doc, side="left"), np.searchsorted(edges, doc, side="right")
        made = iter(encoder.texts(batch["text"]))
        for lo in range(0, batch.num_rows, SOME):
            ids = [raw + end for raw in islice(made, SOME)]
            hi = lo + len(ids)
            h = np.fromiter((xxhash.xxh64_intdigest(raw) for raw in ids), np.uint64, len(ids))
            part = first[lo:hi] + ((h >> np.uint64(40)).astype(np.int64) * (last[lo:hi] - first[lo:hi]) >> 24)
            order = (h ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch["doc_id"].slice(lo, len(ids)), pa.array(order), pa.array(ids, pa.binary())], ["part", "doc_id", "h", "ids"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one part, which come in order."""
    block = part = total = 0
    ids, docs, lengths = [], [], []

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack_block(part, block, docs, lengths, b"".join(ids), width)], pa.binary())], ["block"])

    for batch in batches:
        for part, doc, raw in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            ids.append(raw)
            docs.append(doc)
            lengths.append(len(raw) // width)
            total += lengths[-1]
            if total >= block_ids:
                yield close()
                ids, docs, lengths, total, block = [], [], [], 0, block + 1
    if docs:
        yield close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write its files to the folder ``path``."""
    spark = docs.sparkSession
    bound_batches(spark, "6m")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts_for(rows, PART_BYTES)
    known = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first()["q"]
    bounds = (known or [])[: n - 1]
    # A part's number is the partition's, so that files follow the order of doc_ids.
    ids = rows.mapInArrow(lambda b: _encoded(b, tokenizer, bounds), "part int, doc_id long, h long, ids binary").repartitionById(n, F.col("part"))
    ids = ids.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "ids")
    width = Encoder.width_of(tokenizer)
    blocks = ids.mapInArrow(lambda b: _blocks(b, width, block_ids), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, doc_id, begin, n_tokens, ids_crc32) of every document, from the files alone; begin counts within the block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                at = 0
                while at < len(data):  # Spark's writer leaves an empty file for an empty table
                    b = Block(data, at)
                    at = b.end
                    for lo in range(0, b.n, DOCS):
                        hi = min(lo + DOCS, b.n)
                        edges = b.edges(lo, hi)
                        wide = memoryview(b.ids[edges[0] : edges[-1]].astype("<u4").tobytes())
                        inner = (4 * (edges - edges[0])).tolist()
                        crc = [zlib.crc32(wide[s:e]) for s, e in zip(inner, inner[1:], strict=False)]
                        yield pd.DataFrame({"part": b.part, "block": b.block, "doc_id": b.doc_ids(lo, hi), "begin": edges[:-1], "n_tokens": np.diff(edges), "ids_crc32": crc})

    bound_batches(spark, "8m")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, "part long, block long, doc_id long, begin long, n_tokens long, ids_crc32 long")


def token_offsets(docs: DataFrame, tokenizer: str, *, path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the files, read them back and return (doc_id, start, n_tokens, ids_crc32).

    A block's first id is found from the ids of the parts before it (one number a part, a
    bounded number of parts) and of the blocks before it in its part.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    own = path is None
    path = path or new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, block_ids=block_ids)
    read = written(read_token_files(spark, path), "token-docs")
    if own:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    blocks = read.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("of_part"))
    before_part = F.coalesce(F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_block = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before_part.alias("before"))
    offsets = blocks.withColumn("inner", before_block).join(parts, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("first"))
    offsets = written(offsets, "block-offsets")
    out = read.join(offsets, ["part", "block"]).select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
    return out
