"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Each source gets a target in words. A document's certain part is ``floor(target / source
size)`` whole copies. The rest of the target is drawn by Pareto order sampling: each
document has the rank value (u / (1 - u)) / (p / (1 - p)), random odds over inclusion
odds, and the documents of the lowest rank values are taken until the words that are
still wanted are reached. Inclusion odds are unequal: those of the source's sampling
fraction, times size / (size + 64), so that scraps are drawn less often. The random number is
a hash of the seed and the document's id, so reruns and retries agree.

The cut is found without sorting a source: words are summed by source and 1 of 4096 bins
of the rank value, a running sum over the bins finds the one that crosses the target,
and only that bin's documents, and the next 256, are put in order. These 256 are then offered
in rank order and taken while they fit, so a long document at the cut does not leave a gap.

Defined results: null texts have size 0; documents of size 0 get the certain copies only
and count no words; the null source is a source, last in order; rows of one doc_id and
size rank alike and are taken together; an empty table gives an empty table; with null
doc_id a digest of the text stands for the id. Other columns pass through; names that
begin with ``_mix_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.shared import discard, null_safe_join, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS = 4096
TAIL = 256
HALF_ODDS_WORDS = 64.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(doc_id: Column, text: Column) -> Column:
    """What stands for a document in the random draw."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code point order, null last, take ``weights`` in turn. With caps ``most *
    source_size`` the targets are min(cap, level * weight); the level that makes them sum
    to the whole is the largest of (whole - caps before) / (weights from here on) with
    sources in order of cap / weight. One row a source makes the only unpartitioned windows safe.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = (
        totals.withColumn("_rank", rank)
        .withColumn("_w", F.get(turn, (F.col("_rank") - 1) % len(weights)))
        .withColumn("_cap", (F.lit(most) * F.col("source_size")).cast("double"))
        .withColumn("_whole", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(order), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(order), F.lit(0.0)))
        .withColumn("_level", F.max((F.col("_whole") - F.col("_caps")) / F.col("_left")).over(everything))
    )
    return table.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _rank_value(seed: str) -> Column:
    """Pareto rank value mapped to (0, 1) by q / (1 + q), which keeps the order."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mix_key")).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    f = F.col("_mix_rest") / F.col("source_size")
    odds = f / (1.0 - f) * (F.col("size") / (F.col("size") + HALF_ODDS_WORDS))
    q = u / (1.0 - u) / odds
    return F.when((F.col("_mix_rest") > 0) & (F.col("size") > 0), q / (1.0 + q))


def _ranked(sized: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    out = null_safe_join(sized, table, "source")
    out = out.withColumn("_mix_x", _rank_value(seed))
    return out.withColumn("_mix_bin", F.least(F.floor(F.col("_mix_x") * BINS), F.lit(BINS - 1)).cast("int"))


def mix_plan(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """One row a source: target, whole copies, and which rank values are drawn besides.

    ``sized`` has source, size and _mix_key. The table has one row a source, with at most
    ``TAIL`` picked rank values each.
    """
    table = targets(sized, weights, most).withColumn(
        "_mix_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    table = written(table.withColumn("_mix_rest", F.col("target") - F.col("_mix_whole") * F.col("source_size")), "mix-targets")
    ranked = _ranked(sized, table, seed).where(F.col("_mix_x").isNotNull())

    by_bin = Window.partitionBy("source").orderBy("_mix_bin")
    bins = ranked.groupBy("source", "_mix_bin", "_mix_rest").agg(F.sum("size").alias("_words"), F.count("*").alias("_docs"))
    bins = bins.withColumn("_sum", F.sum("_words").over(by_bin)).withColumn("_seen", F.sum("_docs").over(by_bin))
    cut = bins.groupBy("source").agg(
        F.min(F.when(F.col("_sum") >= F.col("_mix_rest"), F.col("_mix_bin"))).alias("_cut"),
        F.min(F.when(F.col("_sum") >= F.col("_mix_rest"), F.col("_seen"))).alias("_cut_seen"),
        F.sort_array(F.collect_list(F.struct("_mix_bin", "_seen", "_sum"))).alias("_bins"),
    )
    cut = cut.where(F.col("_cut").isNotNull()).select(
        "source",
        "_cut",
        F.coalesce(F.array_max(F.transform(F.filter("_bins", lambda b: b["_mix_bin"] < F.col("_cut")), lambda b: b["_sum"])), F.lit(0)).alias("_before"),
        F.coalesce(
            F.array_min(F.transform(F.filter("_bins", lambda b: b["_seen"] >= F.col("_cut_seen") + TAIL), lambda b: b["_mix_bin"])), F.lit(BINS)
        ).alias("_last"),
    )
    cut = written(cut, "mix-cuts")

    near = null_safe_join(ranked, cut, "source").where((F.col("_mix_bin") >= F.col("_cut")) & (F.col("_mix_bin") <= F.col("_last")))
    near = near.groupBy("source", "_mix_x", "_mix_rest", "_before").agg(F.sum("size").alias("_words"))
    by_x = Window.partitionBy("source").orderBy("_mix_x")
    near = near.withColumn("_sum", F.col("_before") + F.sum("_words").over(by_x)).withColumn("_in", F.col("_sum") <= F.col("_mix_rest"))
    near = near.withColumn("_after", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(by_x)).where(F.col("_in") | (F.col("_after") <= TAIL))
    tails = near.groupBy("source", "_mix_rest").agg(
        F.max(F.when(F.col("_in"), F.col("_mix_x"))).alias("_mix_upto"),
        F.coalesce(F.max(F.when(F.col("_in"), F.col("_sum"))), F.max("_before")).alias("_got"),
        F.array_sort(F.collect_list(F.when(~F.col("_in"), F.struct("_mix_x", "_words")))).alias("_tail"),
    )
    empty = F.array().cast("array<double>")
    picks = F.aggregate(
        "_tail",
        F.struct((F.col("_mix_rest") - F.col("_got")).alias("room"), empty.alias("picks")),
        lambda a, d: F.when(
            d["_words"] <= a["room"], F.struct((a["room"] - d["_words"]).alias("room"), F.array_append(a["picks"], d["_mix_x"]).alias("picks"))
        ).otherwise(a),
    )
    tails = tails.select("source", F.coalesce("_mix_upto", F.lit(-1.0)).alias("_mix_upto"), picks["picks"].alias("_mix_picks"))
    plan = null_safe_join(null_safe_join(table, cut.select("source", "_cut"), "source"), tails, "source")
    plan = written(plan.withColumnRenamed("_cut", "_mix_cut"), "mix-plan")
    discard(table, cut)
    return plan


def apply_plan(docs: DataFrame, plan: DataFrame, *, seed: str = SEED) -> DataFrame:
    """``docs`` (with size and _mix_key) with source_size, target and copies: no shuffle of rows."""
    out = _ranked(docs, plan, seed)
    drawn = F.col("_mix_x").isNotNull() & (
        F.col("_mix_cut").isNull()
        | (F.col("_mix_bin") < F.col("_mix_cut"))
        | (F.col("_mix_x") <= F.col("_mix_upto"))
        | F.coalesce(F.array_contains("_mix_picks", F.col("_mix_x")), F.lit(False))
    )
    out = out.withColumn("copies", F.col("_mix_whole") + F.when(drawn, 1).otherwise(0))
    return out.drop("_mix_whole", "_mix_rest", "_mix_cut", "_mix_upto", "_mix_picks", "_mix_x", "_mix_bin")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns as in ``docs``."""
    seed = options.get("seed", SEED)
    keep = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in keep])
    marked = docs.select(whole.alias("_mix_row"), F.col("source"), word_count(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text")).alias("_mix_key"))
    sized = written(marked.drop("_mix_row"), "mix-sizes")
    plan = mix_plan(sized, **options)
    discard(sized)
    taken = apply_plan(marked, plan, seed=seed).where(F.col("copies") > 0)
    return taken.withColumn("_mix_n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_mix_row.*")
