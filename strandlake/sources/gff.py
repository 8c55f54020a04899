"""GFF3: lines are rows, parsed by expressions; large files split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def _decoded(text: Column) -> Column:
    """Percent-decoding; a plus sign stays."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _encoded(text: Column, also: str = "") -> Column:
    out = text
    for c in "%\t\n" + also:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds the nine columns to entry lines; comments and directives are left out, as is all after ##FASTA on the same path."""
    rows = lines.where((F.length(F.trim(F.col(text))) > 0) & ~F.startswith(F.col(text), F.lit("#")))
    cell = F.split(F.col(text), "\t")
    none = lambda i: F.when(F.get(cell, F.lit(i)) == ".", None).otherwise(F.get(cell, F.lit(i)))
    pairs = F.transform(F.filter(F.split(F.get(cell, F.lit(8)), ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(_decoded(F.trim(F.substring_index(x, "=", 1))).alias("k"), _decoded(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))
    columns = {
        "seqid": _decoded(F.get(cell, F.lit(0))), "source": _decoded(none(1)), "type": _decoded(none(2)), "start": F.get(cell, F.lit(3)).cast("long"), "end": F.get(cell, F.lit(4)).cast("long"),
        "score": none(5).cast("double"), "strand": F.when(F.get(cell, F.lit(6)) == "+", 1).when(F.get(cell, F.lit(6)) == "-", -1), "phase": none(7).cast("int"), "attributes": last,
    }
    return rows.select(*[c for c in lines.columns if c != text], *[v.alias(k) for k, v in columns.items()])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their path and place (partition and row ids rise in the order of lines)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    return parse(lines)


def directives(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, directive) of lines that begin with ##."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value")
    return lines.where(F.startswith("value", F.lit("##"))).select("path", "line", F.substring(F.col("value"), F.lit(3), F.length("value")).alias("directive"))


def features(entries: DataFrame, by: str = "path", order: str = "line") -> DataFrame:
    """One feature a run of consecutive entries with one ID: key and attributes of the first, locations of all."""
    w = Window.partitionBy(by).orderBy(order)
    id_ = F.try_element_at("attributes", F.lit("ID"))
    new = ~F.coalesce(id_ == F.lag(id_).over(w), F.lit(False))
    rows = entries.withColumn("_f", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    loc = F.struct(F.col("start").alias("first"), F.col("end").alias("last"), F.coalesce("strand", F.lit(1)).alias("strand"))
    return rows.groupBy(by, F.col("_f").alias("feature_id")).agg(F.min_by("seqid", order).alias("seqid"), F.min_by("type", order).alias("key"), F.min_by(F.col("attributes"), F.col(order)).alias("qual"), F.collect_set(loc).alias("locs"))


def with_phase(locations: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Adds the phase of coding locations: in the strand's order, what is left of a codon at each start."""
    size = F.col("last") - F.col("first") + 1
    order = F.when(F.col("strand") == -1, -F.col("last")).otherwise(F.col("first"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(feature).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return locations.withColumn("phase", F.when(F.col("key") == "CDS", F.pmod(-before, F.lit(3)).cast("int")))


def gff_line() -> Column:
    """The text of an entry's nine columns."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    attrs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(_encoded(e["key"], ";=&,"), F.lit("="), _encoded(e["value"], ";=&,"))), ";")
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")
    cells = [_encoded(F.col("seqid"), ">"), dot(_encoded(F.col("source"))), dot(_encoded(F.col("type"))), F.col("start").cast("string"), F.col("end").cast("string"), dot(F.col("score").cast("string")), strand, dot(F.col("phase").cast("string")), F.when(F.length(attrs) > 0, attrs).otherwise(".")]
    return F.concat_ws("\t", *cells)


def write_gff(entries: DataFrame, path: str) -> None:
    entries.select(gff_line().alias("value")).write.text(path)
