"""Sequences of any format that a file's suffix tells: one schema for all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import fasta, fastq, genbank

FORMATS = {"fasta": "fasta", "fa": "fasta", "mpfa": "fasta", "fna": "fasta", "fsa": "fasta", "faa": "fasta", "fastq": "fastq", "fq": "fastq", "gb": "genbank", "gbk": "genbank", "gp": "genbank"}


def format_of(path: str) -> str:
    """The format by the last suffix of a path, which may be a pattern or, for folders of files, end in one (``reads.fasta/``)."""
    suffix = re.search(r"\.(\w+)/?$", path)
    known = FORMATS.get(suffix[1].lower()) if suffix else None
    if known is None:
        raise ValueError(f"no sequence format is known for {path!r}")
    return known


def load_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, seq) of FASTA, FASTQ, GenBank and GenPept files; a GenBank record's header is its accession."""
    kind = format_of(path)
    if kind == "genbank":
        return genbank.read_genbank(spark, path).select("path", genbank.accession(F.col("record")).alias("header"), genbank.sequence(F.col("record")).alias("seq"))
    read = fasta.read_fasta if kind == "fasta" else fastq.read_fastq
    return read(spark, path).select("path", "header", "seq")


def load_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The one sequence of a file; several or none are an error once rows are read."""
    rows = load_sequences(spark, path).limit(2)
    one = rows.agg(F.count("*").alias("n"), F.first("path").alias("path"), F.first("header").alias("header"), F.first("seq").alias("seq"))
    wrong = F.raise_error(F.lit("the file does not hold one sequence")).cast("string")
    return one.select("path", "header", F.when(F.col("n") == 1, F.col("seq")).otherwise(wrong).alias("seq"))


def save_sequences(records: DataFrame, path: str) -> None:
    """Write (header, seq) as a folder of files in the format of the path's suffix; FASTQ without a column quality gets the best score everywhere."""
    kind = format_of(path)
    if kind == "fasta":
        fasta.write_fasta(records, path)
    elif kind == "fastq":
        best = F.transform(F.split("seq", ""), lambda _: F.lit(40))
        fastq.write_fastq(records if "quality" in records.columns else records.withColumn("quality", F.when(F.length("seq") > 0, best).otherwise(F.array().cast("array<int>"))), path)
    else:
        rows = records.select(F.concat(F.format_string("LOCUS       %s\nACCESSION   %s\nORIGIN\n        1 ", F.col("header"), F.col("header")), F.lower("seq"), F.lit("\n//")).alias("value"))
        rows.write.text(path)


def a3m_text(gapped: list[str]) -> list[str]:
    """Rows of A3M from an alignment whose first row is the query: columns that the query lacks are lower-case or left out."""
    query = gapped[0]
    out = []
    for row in gapped:
        out.append("".join(c if q != "-" else c.lower() for q, c in zip(query, row, strict=True) if q != "-" or c != "-"))
    return out
