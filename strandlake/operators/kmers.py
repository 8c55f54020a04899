"""k-mers: tokenising, selection, the index as a plain table, and matching by equi-join.

A k-mer's code is big-endian in the alphabet's radix. An index is a DataFrame (kmer,
ref_id, pos), partitioned by k-mer whenever it is joined; Spark splits hot k-mers of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import let, symbols

SLICE = 1 << 16
SOME = 64


def informative(k: int, spacing: str | None = None) -> list[int]:
    """Offsets that count: 0 to k-1, or those of the ones of a spacing such as '1101'."""
    if spacing is None:
        return list(range(k))
    at = [i for i, c in enumerate(spacing) if c == "1"]
    if len(at) != k:
        raise ValueError(f"spacing {spacing!r} has {len(at)} informative positions, not {k}")
    return at


def kmers(seq: Column, alphabet: str, k: int, spacing: str | None = None, masked: str = "") -> Column:
    """Array of k-mer codes by start position; a sequence shorter than the k-mer has none.

    k-mers with a symbol of ``masked`` at an informative position are null.
    """
    at = informative(k, spacing)
    span, n = at[-1] + 1, len(alphabet)

    def code(codes: Column) -> Column:
        """Codes of symbols are looked up once; a k-mer then costs k array reads, wherever it is."""
        places = F.when(F.size(codes) >= span, F.sequence(F.lit(0), F.size(codes) - span)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: sum((F.get(codes, i + o) * F.lit(n ** (k - 1 - j)).cast("long") for j, o in enumerate(at)), F.lit(0).cast("long")))

    def number(symbol: Column) -> Column:
        at = (F.instr(F.lit(alphabet), symbol) - 1).cast("long")
        return F.when(~symbol.isin(*masked), at) if masked else at

    return let(F.transform(symbols(seq), number), code)


def explode_kmers(sequences: DataFrame, alphabet: str, k: int, *, key: str = "seq_id", seq: str = "seq", spacing: str | None = None, masked: str = "") -> DataFrame:
    """(kmer, ref_id, pos): the index of sequences, without k-mers that hold a masked symbol."""
    rows = sequences.select(F.col(key).alias("ref_id"), F.posexplode(kmers(F.col(seq), alphabet, k, spacing, masked)).alias("pos", "kmer")).select("kmer", "ref_id", "pos")
    return rows.where("kmer IS NOT NULL") if masked else rows


def without_masked(index: DataFrame, masks: DataFrame, k: int, spacing: str | None = None) -> DataFrame:
    """``index`` without k-mers of which any informative position is in ``masks`` (ref_id, pos)."""
    at = informative(k, spacing)
    hit = masks.select("ref_id", F.explode(F.array(*[F.col("pos") - o for o in at])).alias("pos")).distinct()
    return index.join(hit, ["ref_id", "pos"], "left_anti").select("kmer", "ref_id", "pos")


def _div(code: Column, by: int) -> Column:
    return F.call_function("div", code, F.lit(by).cast("long"))


def fuse(codes: Column, n: int) -> Column:
    """The code of a k-mer from its symbols' codes."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * n + c)


def split_code(kmer: Column, n: int, k: int) -> Column:
    return F.array(*[_div(kmer, n ** (k - 1 - i)) % n for i in range(k)])


def decode_kmer(kmer: Column, alphabet: str, k: int) -> Column:
    n = len(alphabet)
    table = F.split(F.lit(alphabet), "")
    return F.concat(*[F.get(table, (_div(kmer, n ** (k - 1 - i)) % n).cast("int")) for i in range(k)])


def count_kmers(index: DataFrame) -> DataFrame:
    """(kmer, n), combined on the map side before the shuffle."""
    return index.groupBy("kmer").agg(F.count("*").alias("n"))


def spectrum(index: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return count_kmers(index).groupBy("n").agg(F.count("*").alias("kmers"))


def match(query: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, query_pos, ref_id, ref_pos) of equal k-mers."""
    left = query.select("kmer", F.col("ref_id").alias("query_id"), F.col("pos").alias("query_pos"))
    return left.join(index.select("kmer", "ref_id", F.col("pos").alias("ref_pos")), "kmer").drop("kmer")


def match_runs(query: DataFrame, ref: DataFrame, alphabet: str, k: int, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(query_id, query_pos, ref_id, ref_pos): of each run of equal k-mers along a diagonal the first.

    Each k-mer is read with the symbol before it, or a mark of the sequence's start that equals no other.
    """
    marked = alphabet + "^$"
    code = len(marked) ** k
    sides = []
    for rows, mark in ((query, "^"), (ref, "$")):
        index = explode_kmers(rows.select(key, F.concat(F.lit(mark), F.col(seq)).alias(seq)), marked, k + 1, key=key, seq=seq)
        sides.append(index.select("ref_id", "pos", (F.col("kmer") % code).alias("kmer"), _div(F.col("kmer"), code).alias("before")))
    left = sides[0].select("kmer", F.col("ref_id").alias("query_id"), F.col("pos").alias("query_pos"), F.col("before").alias("_b"))
    right = sides[1].select("kmer", "ref_id", F.col("pos").alias("ref_pos"), "before")
    return left.join(right, "kmer").where("_b <> before").select("query_id", "query_pos", "ref_id", "ref_pos")


def match_counts(query: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, ref_id, matches): position pairs of equal k-mers, counted without making them.

    Both sides are counted by (id, k-mer) first, so repeats within a sequence cost one row.
    """
    left = query.groupBy("kmer", F.col("ref_id").alias("query_id")).agg(F.count("*").alias("_q"))
    right = index.groupBy("kmer", "ref_id").agg(F.count("*").alias("_r"))
    return left.join(right, "kmer").groupBy("query_id", "ref_id").agg(F.sum(F.col("_q") * F.col("_r")).alias("matches"))


def similar_kmers(alphabet: str, k: int, scores: DataFrame, threshold: int) -> DataFrame:
    """(kmer, similar): pairs of all k-mers whose total score reaches the threshold.

    ``scores`` is (code1, code2, score). Symbols are added one at a time, and a prefix that cannot
    reach the threshold even with the best remaining scores is dropped (branch and bound).
    """
    n = len(alphabet)
    top = scores.agg(F.max("score")).first()[0] or 0
    pairs = scores.select(F.col("code1").cast("long").alias("c"), F.col("code2").cast("long").alias("d"), "score")
    out = pairs.select(F.col("c").alias("kmer"), F.col("d").alias("similar"), F.col("score").alias("total")).where(F.col("total") + top * (k - 1) >= threshold)
    for left in range(k - 2, -1, -1):
        grown = out.crossJoin(F.broadcast(pairs)).select((F.col("kmer") * n + F.col("c")).alias("kmer"), (F.col("similar") * n + F.col("d")).alias("similar"), (F.col("total") + F.col("score")).alias("total"))
        out = grown.where(F.col("total") + top * left >= threshold)
    return out.select("kmer", "similar")


def match_similar(query: DataFrame, index: DataFrame, similar: DataFrame) -> DataFrame:
    """As ``match`` through a table of similar k-mers."""
    wide = query.join(similar, "kmer").select(F.col("similar").alias("kmer"), "ref_id", "pos")
    return match(wide, index)


# Orders and selectors -------------------------------------------------------------------


def random_order(kmer: Column) -> Column:
    """A fixed pseudo-random order: a hash of the code."""
    return F.xxhash64(kmer)


def frequency_order(counts: DataFrame, codes: int) -> DataFrame:
    """(kmer, rank): rare k-mers first, equal ones by code; k-mers that do not occur rank among the rarest."""
    every = counts.sparkSession.range(codes).withColumnRenamed("id", "kmer")
    full = every.join(counts, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))
    # The rank is made without one global sort: k-mers before those of a count, then place within it.
    classes = full.groupBy("n").agg(F.count("*").alias("_size"))
    before = classes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = full.withColumn("_in", F.row_number().over(Window.partitionBy("n").orderBy("kmer")) - 1)
    return placed.join(F.broadcast(before.select("n", "_before")), "n").select("kmer", (F.col("_before") + F.col("_in")).alias("rank"))


def minimizers(index: DataFrame, window: int, order: Column | None = None) -> DataFrame:
    """(ref_id, pos, kmer): the least k-mer of each window of ``window`` k-mers, the leftmost of equals, each once."""
    rank = F.col("kmer") if order is None else order
    by = Window.partitionBy("ref_id").orderBy("pos")
    frame = by.rowsBetween(0, window - 1)
    best = index.withColumn("_best", F.min(F.struct(rank.alias("r"), F.col("pos").alias("p"), F.col("kmer").alias("k"))).over(frame)).withColumn("_full", F.count("*").over(frame))
    return best.where(F.col("_full") == window).select("ref_id", F.col("_best.p").alias("pos"), F.col("_best.k").alias("kmer")).distinct()


def _codes(seq: str | None, alphabet: str, k: int) -> np.ndarray:
    """Codes of a sequence's k-mers."""
    table = np.full(128, -1, np.int64)
    table[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    raw = np.frombuffer((seq or "").encode("utf-32-le"), np.uint32)
    one = np.where(raw < 128, table[np.minimum(raw, 127)], -1)
    out = np.zeros(max(len(one) - k + 1, 0), np.int64)
    for j in range(k):
        out = out * len(alphabet) + one[j : j + len(out)]
    return out


def _least(rank: np.ndarray, window: int) -> np.ndarray:
    """Position of the least value of each window, the leftmost of equals."""
    n = max(len(rank) - window + 1, 0)
    out = np.zeros(n, np.int64)
    for lo in range(0, n, SLICE):
        hi = min(lo + SLICE, n)
        out[lo:hi] = np.lib.stride_tricks.sliding_window_view(rank[lo : hi + window - 1], window).argmin(axis=1) + np.arange(lo, hi)
    return out


def _chosen(sequences: DataFrame, key: str, seq: str, choose: Callable[[str | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(ref_id, pos, kmer) from (positions, codes) of each sequence: a row is read whole, so nothing is shuffled."""
    kind = dict(sequences.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SOME):
                part = batch.slice(lo, SOME)
                got = [choose(t) for t in part["seq"].to_pylist()]
                at = np.repeat(np.arange(len(got)), [len(p) for p, _ in got])
                pos, kmer = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part["ref_id"].take(pa.array(at)), pa.array(pos.astype(np.int32)), pa.array(kmer.astype(np.int64))], ["ref_id", "pos", "kmer"])

    return sequences.select(F.col(key).alias("ref_id"), F.col(seq).alias("seq")).mapInArrow(run, f"ref_id {kind}, pos int, kmer long")


def row_minimizers(sequences: DataFrame, alphabet: str, k: int, window: int, *, order: Callable[[np.ndarray], np.ndarray] | None = None, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """As ``minimizers`` for sequences that are one row each: no shuffle. ``order`` gives the ranks of codes."""

    def choose(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        codes = _codes(text, alphabet, k)
        at = np.unique(_least(codes if order is None else order(codes), window))
        return at, codes[at]

    return _chosen(sequences, key, seq, choose)


def syncmers(sequences: DataFrame, alphabet: str, k: int, s: int, *, offsets: tuple[int, ...] = (0,), key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(ref_id, pos, kmer): k-mers whose least s-mer, the leftmost of equals, starts at one of the offsets. No shuffle."""
    width = k - s + 1
    wanted = [o + width if o < 0 else o for o in offsets]

    def choose(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        least = _least(_codes(text, alphabet, s), width)
        at = np.flatnonzero(np.isin(least - np.arange(len(least)), wanted))
        return at, _codes(text, alphabet, k)[at]

    return _chosen(sequences, key, seq, choose)


def mincode(index: DataFrame, codes: int, compression: float) -> DataFrame:
    """The k-mers whose code lies in the lowest 1/compression of all codes."""
    return index.where(F.col("kmer") < codes / compression).select("ref_id", "pos", "kmer")


def diagonals(matches: DataFrame) -> DataFrame:
    """(query_id, ref_id, diagonal, hits) with diagonal = ref_pos - query_pos."""
    return matches.groupBy("query_id", "ref_id", (F.col("ref_pos") - F.col("query_pos")).alias("diagonal")).agg(F.count("*").alias("hits"))
