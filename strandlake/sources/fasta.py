"""FASTA, A3M and Clustal: records as rows. Reading splits large files at record borders, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import NUCLEOTIDE, NUCLEOTIDE_AMBIGUOUS, PROTEIN


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, seq): blank lines and lines that begin with ; are ignored, a sequence's lines joined."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("v"))
    lines = F.filter(F.transform(F.split("v", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~F.startswith(x, F.lit(";")))
    rows = rows.withColumn("l", lines).where(F.size("l") > 0)
    first = F.element_at("l", 1)
    return rows.select("path", F.trim(F.regexp_replace(first, "^>", "")).alias("header"), F.array_join(F.slice("l", F.lit(2), F.size("l")), "").alias("seq"))


def last_of_header(records: DataFrame, order: str) -> DataFrame:
    """One record a header, the last by ``order``."""
    return records.groupBy("header").agg(F.max_by("seq", order).alias("seq"))


def typed(seq: Column) -> Column:
    """Struct (type, seq): nucleotide after U to T and X to N if that fits its alphabet, else protein after U to C and O to K; else an error."""
    up = F.upper(seq)
    nuc, prot = F.translate(up, "UX", "TN"), F.translate(up, "UO", "CK")
    fits = lambda s, a: F.length(F.translate(s, a, "")) == 0
    kind = F.when(fits(nuc, NUCLEOTIDE), "nucleotide").when(fits(nuc, NUCLEOTIDE_AMBIGUOUS), "ambiguous nucleotide").when(fits(prot, PROTEIN), "protein").otherwise(F.raise_error(F.lit("neither nucleotide nor protein")).cast("string"))
    return F.struct(kind.alias("type"), F.when(fits(nuc, NUCLEOTIDE_AMBIGUOUS), nuc).otherwise(prot).alias("seq"))


def fasta_text(header: Column, seq: Column, width: int = 80) -> Column:
    """One record's text, wrapped."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(records: DataFrame, path: str, *, width: int = 80, as_rna: bool = False) -> None:
    seq = F.translate("seq", "T", "U") if as_rna else F.col("seq")
    records.select(fasta_text(F.col("header"), seq, width).alias("value")).write.text(path)


def aligned(records: DataFrame, other_gaps: str = "_") -> DataFrame:
    """Gapped records with every gap written as a dash."""
    return records.withColumn("seq", F.translate("seq", other_gaps, "-" * len(other_gaps)))


def a3m_pairs(records: DataFrame, order: str) -> DataFrame:
    """(header, query, target): gapped pairs of each file's first record, the query, and the others.

    In a target, a lower-case letter has no partner in the query; a dash has none in the target.
    """
    w = Window.partitionBy("path").orderBy(order)
    rows = records.withColumn("_n", F.row_number().over(w)).withColumn("_q", F.first("seq").over(w)).where("_n > 1")
    symbols = F.split("seq", "")
    place = lambda i: F.length(F.regexp_replace(F.substring(F.col("seq"), F.lit(1), i + 1), "[a-z]", ""))
    query = F.array_join(F.transform(symbols, lambda c, i: F.when(c.rlike("[a-z]"), "-").otherwise(F.substring(F.col("_q"), place(i), F.lit(1)))), "")
    return rows.select("path", "header", query.alias("query"), F.upper("seq").alias("target"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, seq): gapped sequences of Clustal files, blocks joined in order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "v"))
    rows = files.where((F.col("line") > 0) & F.col("v").rlike(r"^\S+\s+\S+")).select("path", "line", F.regexp_extract("v", r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("v", r"^(\S+)\s+(\S+)", 2).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("line", "part")))
    return rows.groupBy("path", "name").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("seq"), F.min("line").alias("line")).select("path", "name", "seq", "line")


def clustal_text(names: list[str], gapped: list[str], width: int = 60) -> str:
    """A Clustal file's text of one alignment."""
    pad = max(map(len, names)) + 4
    out = ["CLUSTAL W (1.81) multiple sequence alignment", "", ""]
    for at in range(0, len(gapped[0]), width):
        out += [n.ljust(pad) + s[at : at + width] for n, s in zip(names, gapped, strict=True)] + ["", ""]
    return "\n".join(out)
