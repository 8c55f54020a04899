"""Alignment operators: Arrow kernels over pairs of sequences, and alignment algebra in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import kernels


def _table(match: int, mismatch: int, matrix: dict[tuple[str, str], int] | None) -> np.ndarray:
    table = kernels.score_table(match, mismatch)
    for (a, b), v in (matrix or {}).items():
        table[ord(a) % 128, ord(b) % 128] = v
    return table


def align_score(a: Column, b: Column, *, match: int = 1, mismatch: int = -1, matrix: dict | None = None, gap: tuple[int, int] | int = -1, local: bool = False, terminal: bool = True, band: tuple[int, int] | None = None) -> Column:
    """The optimal score of each pair: global or local, linear or affine gaps, within a band or not."""
    table = _table(match, mismatch, matrix)

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kernels.best_score(kernels.codes(p), kernels.codes(q), table, gap, local=local, terminal=terminal, band=band) for p, q in zip(x, y, strict=True)], dtype="int64")

    return run(a, b)


ALIGNED = "score long, traces array<array<struct<a:int,b:int>>>, cigar string, identity double"


def align(a: Column, b: Column, *, match: int = 1, mismatch: int = -1, matrix: dict | None = None, gap: tuple[int, int] | int = -1, local: bool = False, terminal: bool = True, band: tuple[int, int] | None = None, most: int = 1) -> Column:
    """Struct (score, traces, cigar, identity) of each pair, with at most ``most`` co-optimal traces; cigar and identity are the first one's."""
    table = _table(match, mismatch, matrix)

    @F.pandas_udf(ALIGNED)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q in zip(x, y, strict=True):
            p, q = kernels.codes(p), kernels.codes(q)
            score, traces = kernels.traceback(p, q, table, gap, local=local, terminal=terminal, band=band, most=most)
            t = traces[0]
            paired = len(t) and (t >= 0).all(axis=1).any()
            rows.append((score, [[{"a": int(i), "b": int(j)} for i, j in t] for t in traces], kernels.cigar(t), kernels.identity(t, [p, q], "all") if paired else None))
        return pd.DataFrame(rows, columns=["score", "traces", "cigar", "identity"])

    return run(a, b)


def extend_ungapped(a: Column, b: Column, i: Column, j: Column, *, match: int = 1, mismatch: int = -1, matrix: dict | None = None, threshold: int) -> Column:
    """Struct (score, start1, start2, length) of the X-drop extension of a seed pair."""
    table = _table(match, mismatch, matrix)

    @F.pandas_udf("score long, start1 long, start2 long, length long")
    def run(x: pd.Series, y: pd.Series, si: pd.Series, sj: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q, u, v in zip(x, y, si, sj, strict=True):
            score, before, after = kernels.extend(kernels.codes(p), kernels.codes(q), int(u), int(v), table, threshold)
            rows.append((score, u - before, v - before, before + after))
        return pd.DataFrame(rows, columns=["score", "start1", "start2", "length"])

    return run(a, b, i, j)


def extend_best(a: Column, b: Column, seeds: Column, *, match: int = 1, mismatch: int = -1, matrix: dict | None = None, threshold: int) -> Column:
    """Struct (score, start1, start2, length) of the best X-drop extension of an array of seed pairs; of equals the first in both sequences."""
    table = _table(match, mismatch, matrix)

    @F.pandas_udf("score long, start1 long, start2 long, length long")
    def run(x: pd.Series, y: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        rows = []
        for p, q, at in zip(x, y, pairs, strict=True):
            p, q = kernels.codes(p), kernels.codes(q)
            best = None
            for u, v in at:
                score, before, after = kernels.extend(p, q, int(u), int(v), table, threshold)
                made = (-score, int(u) - before, int(v) - before, before + after)
                best = made if best is None else min(best, made)
            rows.append((-best[0], *best[1:]))
        return pd.DataFrame(rows, columns=["score", "start1", "start2", "length"])

    return run(a, b, seeds)


def identical_columns(a: Column, b: Column) -> Column:
    """How many positions of two equally long strings hold the same symbol."""
    both = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.size(F.filter(both, lambda p: p["x"] == p["y"]))


def columns_of(gapped: DataFrame, *, key: str = "aln_id", row: str = "seq_idx", seq: str = "seq", gap: str = "-") -> DataFrame:
    """(key, row, col, pos): the trace of gapped strings, -1 for a gap."""
    rows = gapped.select(key, row, F.posexplode(F.split(F.col(seq), "")).alias("col", "_c"))
    seen = F.sum((F.col("_c") != gap).cast("int")).over(Window.partitionBy(key, row).orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, row, "col", F.when(F.col("_c") == gap, -1).otherwise(seen - 1).alias("pos"))


def terminal_range(columns: DataFrame, *, key: str = "aln_id", row: str = "seq_idx") -> DataFrame:
    """(key, start, stop): columns between which no row has a terminal gap; stop is exclusive."""
    each = columns.where("pos >= 0").groupBy(key, row).agg(F.min("col").alias("a"), F.max("col").alias("b"))
    return each.groupBy(key).agg(F.max("a").alias("start"), (F.min("b") + 1).alias("stop"))


def remove_terminal_gaps(columns: DataFrame, *, key: str = "aln_id", row: str = "seq_idx") -> DataFrame:
    return columns.join(terminal_range(columns, key=key, row=row), key).where("col >= start AND col < stop").drop("start", "stop")


def remove_gaps(columns: DataFrame, *, key: str = "aln_id") -> DataFrame:
    """Without the columns that have a gap in any row."""
    gapped = columns.where("pos < 0").select(key, "col").distinct()
    return columns.join(gapped, [key, "col"], "left_anti")


def run_lengths(rows: DataFrame, *, key: str, symbol: str, pos: str = "pos", shown: str | None = None) -> DataFrame:
    """(key, cigar): run lengths and symbols of each key's rows by position."""
    shown = shown or symbol
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key, symbol).orderBy(pos))
    runs = rows.withColumn("_island", island).groupBy(key, symbol, shown, "_island") if shown != symbol else rows.withColumn("_island", island).groupBy(key, symbol, "_island")
    runs = runs.agg(F.min(pos).alias("_first"), F.count("*").alias("_n"))
    part = F.concat(F.col("_n").cast("string"), F.col(shown))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", part.alias("_p")))), lambda x: x["_p"]), "").alias("cigar"))


def log_evalue(score: Column, m: Column, n: Column, *, lam: float, k: float) -> Column:
    """log10 of the expected number of chance hits."""
    return F.log10(F.lit(k) * m * n) - F.lit(lam) * score / F.lit(math.log(10))


def estimate_evalue_parameters(scores: DataFrame, length: int, *, column: str = "score") -> tuple[float, float]:
    """(lambda, K) of random alignments' scores by the method of moments."""
    row = scores.agg(F.avg(column).alias("mean"), F.var_pop(column).alias("var")).first()
    lam = math.pi / math.sqrt(6 * row["var"])
    return lam, math.exp(lam * row["mean"] - 0.5772156649015329) / length**2


def cigar_trace(cigar: Column, position: Column) -> Column:
    """The trace array<struct<a,b>> of a CIGAR string, a the reference, b the segment."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def run(c: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([[{"a": int(i), "b": int(j)} for i, j in kernels.trace_of_cigar(t, int(at))] for t, at in zip(c, p, strict=True)])

    return run(cigar, position)


def alignment_score(columns: DataFrame, symbols: DataFrame, *, match: int, mismatch: int, gap: tuple[int, int] | int, terminal: bool = True, key: str = "aln_id") -> DataFrame:
    """(key, score) of alignments of any number of rows.

    Pairs of symbols in a column are scored for all row pairs, from counts of symbols by column; then each row's
    gaps. ``symbols`` is (key, seq_idx, pos, symbol).
    """
    opening, extend = (gap, gap) if isinstance(gap, int) else gap
    counts = columns.join(symbols, [key, "seq_idx", "pos"]).groupBy(key, "col", "symbol").agg(F.count("*").alias("n"))
    cols = counts.groupBy(key, "col").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("same"), F.sum("n").alias("n"))
    pairs = cols.groupBy(key).agg(F.sum(F.col("same") * match + (F.expr("n * (n - 1) / 2") - F.col("same")) * mismatch).alias("pairs"))
    by = Window.partitionBy(key, "seq_idx").orderBy("col")
    rows = columns if terminal else remove_terminal_gaps(columns, key=key)
    gaps = rows.withColumn("_before", F.lag("pos").over(by)).where("pos < 0")
    cost = gaps.groupBy(key).agg(F.sum(F.when(F.coalesce(F.col("_before") < 0, F.lit(False)), extend).otherwise(opening)).alias("gaps"))
    return pairs.join(cost, key, "left").select(key, (F.col("pairs") + F.coalesce("gaps", F.lit(0))).cast("long").alias("score"))
