"""Sequence profiles: counts of symbols by alignment column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import IUPAC, symbols

GAP = "-"


def counts(gapped: DataFrame, alphabet: str, *, seq: str = "seq") -> DataFrame:
    """(col, symbol, n, gaps) of equally long gapped strings, with a row for each symbol of the alphabet.

    Counts combine on the map side: the shuffle carries one row a column and symbol from each task.
    """
    rows = gapped.select(F.posexplode(symbols(F.col(seq))).alias("col", "symbol"))
    found = rows.groupBy("col", "symbol").agg(F.count("*").alias("n"))
    cols = found.groupBy("col").agg(F.sum(F.when(F.col("symbol") == GAP, F.col("n")).otherwise(0)).alias("gaps"))
    grid = cols.withColumn("symbol", F.explode(F.array(*[F.lit(c) for c in alphabet])))
    return grid.join(found, ["col", "symbol"], "left").select("col", "symbol", F.coalesce("n", F.lit(0)).alias("n"), "gaps")


def probabilities(profile: DataFrame, alphabet: str, *, pseudocount: int = 0) -> DataFrame:
    """Adds p = (n + pseudocount / size) / (column sum + pseudocount)."""
    sums = profile.groupBy("col").agg(F.sum("n").alias("_sum"))
    out = profile.join(sums, "col").withColumn("p", (F.col("n") + pseudocount / len(alphabet)) / (F.col("_sum") + pseudocount))
    return out.drop("_sum")


def log_odds(profile: DataFrame, alphabet: str, *, background: dict[str, float] | None = None) -> DataFrame:
    """Adds log_odds = log2(p / background); a p of zero gives minus infinity."""
    flat = 1 / len(alphabet)
    ground = F.create_map(*[x for a in alphabet for x in (F.lit(a), F.lit((background or {}).get(a, flat)))])
    return profile.withColumn("log_odds", F.when(F.col("p") == 0, F.lit(float("-inf"))).otherwise(F.log2(F.col("p") / F.element_at(ground, F.col("symbol")))))


def consensus(profile: DataFrame, *, protein: bool = False) -> DataFrame:
    """One row: the consensus string. Nucleotides: the code of the symbols with the highest count; proteins: the first of them, X for none."""
    best = profile.groupBy("col").agg(F.max("n").alias("_top"))
    tied = profile.join(best, "col").where("n = _top").groupBy("col").agg(F.max("_top").alias("_top"), F.array_join(F.array_sort(F.collect_set("symbol")), "").alias("_set"))
    if protein:
        letter = F.when(F.col("_top") == 0, "X").otherwise(F.substring("_set", 1, 1))
    else:
        table = F.create_map(*[F.lit(x) for code, letters in IUPAC.items() for x in ("".join(sorted(letters)), code)])
        letter = F.when(F.col("_top") == 0, F.raise_error(F.lit("empty column")).cast("string")).otherwise(F.try_element_at(table, F.when(F.col("_set") == "ACGT", "ACGT").otherwise(F.col("_set"))))
    rows = tied.select(F.struct("col", letter.alias("s")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("consensus"))


def sequence_score(sequences: DataFrame, profile: DataFrame, *, key: str = "seq_id", seq: str = "seq", value: str = "log_odds") -> DataFrame:
    """(key, score): the sum of a profile's values along each sequence (for probabilities, take the logarithm first)."""
    rows = sequences.select(key, F.posexplode(symbols(F.col(seq))).alias("col", "symbol"))
    return rows.join(profile.select("col", "symbol", value), ["col", "symbol"]).groupBy(key).agg(F.sum(value).alias("score"))
