"""Annotations: features with 1-based inclusive locations, as rows (…, first, last, strand, defect)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import reverse_complement

#: Fixed values of a location's defect bits.
MISS_LEFT, MISS_RIGHT, BEYOND_LEFT, BEYOND_RIGHT, UNK_LOC, BETWEEN = 1, 2, 4, 8, 16, 32
FORWARD, REVERSE = 1, -1


def cut(features: DataFrame, start: int | Column | None, stop: int | Column | None) -> DataFrame:
    """Locations that overlap [start, stop), clipped to it; defects note what was cut off."""
    first, last = F.col("first"), F.col("last")
    low = F.lit(None).cast("long") if start is None else F.lit(start).cast("long")
    high = F.lit(None).cast("long") if stop is None else F.lit(stop).cast("long") - 1
    defect = F.col("defect") if "defect" in features.columns else F.lit(0)
    inside = F.coalesce(first <= high, F.lit(True)) & F.coalesce(last >= low, F.lit(True))
    lost = F.when(first < low, MISS_LEFT).otherwise(0).bitwiseOR(F.when(last > high, MISS_RIGHT).otherwise(0)).bitwiseOR(defect)
    out = features.where(inside).withColumn("defect", lost)
    return out.withColumn("first", F.greatest(first, low)).withColumn("last", F.least(last, high))


def location_range(features: DataFrame, *by: str) -> DataFrame:
    """(by…, first, last): the whole range of the features' locations."""
    return features.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, *, width: int = 1024) -> DataFrame:
    """Pairs of locations of one ``key`` that overlap; right's columns get the prefix r_.

    An interval join by bins of ``width`` positions: each interval goes to the bins that it touches, equal
    bins meet, and a pair is kept in the bin where its overlap begins, so it appears once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    a = left.withColumn("_bin", bins(F.col("first"), F.col("last")))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rbin", bins(F.col("r_first"), F.col("r_last")))
    meet = (a[key] == b[f"r_{key}"]) & (F.col("_bin") == F.col("_rbin")) & (F.col("first") <= F.col("r_last")) & (F.col("r_first") <= F.col("last"))
    own = F.col("_bin") == F.floor(F.greatest("first", "r_first") / width)
    return a.join(b, meet & own).drop("_bin", "_rbin")


def overlap_counts(features: DataFrame, *, key: str, width: int = 1024) -> DataFrame:
    """(key, feature_id, overlaps): how many other features each one overlaps, where any."""
    rows = features.select(key, "feature_id", "first", "last")
    pairs = overlap_join(rows, rows, key, width=width).where("feature_id <> r_feature_id")
    return pairs.groupBy(key, "feature_id").agg(F.count("*").alias("overlaps"))


def subsequence(features: DataFrame, sequences: DataFrame, *, key: str = "seq_id", start: int = 1) -> DataFrame:
    """(key, feature_id, seq): each feature's part of its sequence.

    Forward locations join by first; reverse ones by last, descending, each reverse-complemented.
    A feature on both strands is an error.
    """
    part = F.substring("seq", F.col("first") - start + 1, F.col("last") - F.col("first") + 1)
    rows = features.join(sequences, key)
    forward = F.col("strand") == FORWARD
    made = rows.select(key, "feature_id", "strand", F.when(forward, F.col("first")).otherwise(-F.col("last")).alias("_o"), F.when(forward, part).otherwise(reverse_complement(part)).alias("_p"))
    joined = made.groupBy(key, "feature_id").agg(F.count_distinct("strand").alias("_n"), F.array_sort(F.collect_list(F.struct("_o", "_p"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["_p"]), "")
    return joined.select(key, "feature_id", F.when(F.col("_n") == 1, text).otherwise(F.raise_error(F.lit("feature on both strands")).cast("string")).alias("seq"))


def reverse_complement_features(features: DataFrame, length: Column | int) -> DataFrame:
    """The locations on the reverse complement of a sequence of ``length`` symbols: mirrored, strands and left/right defects swapped."""
    n = F.lit(length) if isinstance(length, int) else length
    defect = F.col("defect") if "defect" in features.columns else F.lit(0)
    swapped = defect.bitwiseAND(UNK_LOC | BETWEEN)
    for a, b in ((MISS_LEFT, MISS_RIGHT), (BEYOND_LEFT, BEYOND_RIGHT)):
        swapped = swapped.bitwiseOR(F.when(defect.bitwiseAND(a) != 0, b).otherwise(0)).bitwiseOR(F.when(defect.bitwiseAND(b) != 0, a).otherwise(0))
    out = features.withColumn("_f", n - F.col("last") + 1).withColumn("last", n - F.col("first") + 1).withColumn("first", F.col("_f")).drop("_f")
    out = out.withColumn("defect", swapped)
    return out.withColumn("strand", -F.col("strand")) if "strand" in features.columns else out
