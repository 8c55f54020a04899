"""Segments of ordered rows (residues, chains): gaps and islands by window functions.

Every table has an explicit order column. A segment begins at the first row, where a category of ``equal`` changes,
or where a category of ``rising`` decreases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESIDUE = (("chain_id", "res_id", "ins_code"), ())
CHAIN = (("chain_id",), ("res_id",))


def with_starts(rows: DataFrame, by: Sequence[str], order: Sequence[str], equal: Sequence[str], rising: Sequence[str] = (), name: str = "is_start") -> DataFrame:
    """Adds a flag: does a segment begin here?"""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.row_number().over(w) == 1
    for c in equal:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    for c in rising:
        change = change | F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    return rows.withColumn(name, change)


def with_positions(rows: DataFrame, by: Sequence[str], order: Sequence[str], equal: Sequence[str], rising: Sequence[str] = (), name: str = "segment") -> DataFrame:
    """Adds each row's 0-based segment number."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = with_starts(rows, by, order, equal, rising, "_start")
    return flagged.withColumn(name, F.sum(F.col("_start").cast("long")).over(w) - 1).drop("_start")


def apply(rows: DataFrame, by: Sequence[str], *aggregates: Column, segment: str = "segment") -> DataFrame:
    """One row a segment with the given aggregates."""
    return rows.groupBy(*by, segment).agg(*aggregates)


def spread(rows: DataFrame, values: DataFrame, by: Sequence[str], segment: str = "segment") -> DataFrame:
    """Each segment's values on all of its rows."""
    return rows.join(values, [*by, segment])


def starts(rows: DataFrame, by: Sequence[str], order: str, segment: str = "segment", *, exclusive_stop: bool = False) -> DataFrame:
    """(by…, segment, start) and, if asked for, the exclusive stop of each segment."""
    out = rows.groupBy(*by, segment).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"))
    return out if exclusive_stop else out.drop("stop")


def members(rows: DataFrame, queries: DataFrame, by: Sequence[str], order: str, segment: str = "segment") -> DataFrame:
    """Masks as rows: for each query row (by…, order) the rows of its segment, as (by…, query, order)."""
    asked = queries.select(*by, F.col(order).alias("query"))
    of = asked.join(rows.select(*by, F.col(order).alias("query"), segment), [*by, "query"])
    return of.join(rows.select(*by, segment, order), [*by, segment]).select(*by, "query", order)


def continuous_ids(rows: DataFrame, by: Sequence[str], order: Sequence[str], restart: Sequence[str], equal: Sequence[str], name: str = "new_id") -> DataFrame:
    """1-based running numbers of segments, restarted with each change of ``restart``."""
    out = with_positions(rows, by, order, restart, (), "_outer")
    out = with_positions(out, [*by, "_outer"], order, equal, (), "_inner")
    return out.withColumn(name, F.col("_inner") + 1).drop("_outer", "_inner")
