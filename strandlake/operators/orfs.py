"""Open reading frames of nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import STANDARD_STARTS, codon_table


def orf_scan(sequences: DataFrame, *, key: str = "seq_id", seq: str = "seq", table: dict[str, str] | None = None, starts: tuple[str, ...] = STANDARD_STARTS) -> DataFrame:
    """(key, start, stop, protein) of the three forward frames, 0-based, stop exclusive.

    Each start codon opens a frame that runs to the first stop codon, which is part of it, or to the frame's end.
    Each sequence is one row's work; nothing is shuffled.
    """
    table = table or codon_table()
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    frames = sequences.select(key, F.col(seq).alias("_s"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_f")).where(F.length("_s") - F.col("_f") >= 3)
    rest = F.substring(F.col("_s"), F.col("_f") + 1, F.length("_s"))
    frames = frames.withColumn("_c", F.regexp_extract_all(rest, F.lit("(?s).{3}"), F.lit(0)))
    frames = frames.withColumn("_p", F.array_join(F.transform("_c", lambda c: F.try_element_at(lookup, c)), ""))
    opened = frames.select(key, "_f", "_p", F.posexplode("_c").alias("_i", "_codon")).where(F.col("_codon").isin(*starts))
    rest = F.substring(F.col("_p"), F.col("_i") + 1, F.length("_p"))
    size = F.when(F.instr(rest, "*") > 0, F.instr(rest, "*")).otherwise(F.length(rest))
    start = F.col("_f") + 3 * F.col("_i")
    return opened.select(key, start.alias("start"), (start + 3 * size).alias("stop"), F.substring(rest, F.lit(1), size).alias("protein"))
