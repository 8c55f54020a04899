"""FASTQ: sequences with quality scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fastq(text: str, offset: int = 33) -> Iterator[tuple[str, str, list[int]]]:
    """Records of a text; sequence and scores may take several lines, and score lines may begin with @ or +."""
    lines = [x for x in text.splitlines() if x]
    at = 0
    while at < len(lines):
        if not lines[at].startswith("@"):
            raise ValueError(f"line {at + 1}: a record begins with @")
        name, at, seq, score = lines[at][1:], at + 1, "", ""
        while at < len(lines) and not lines[at].startswith("+"):
            seq, at = seq + lines[at].strip(), at + 1
        at += 1
        while len(score) < len(seq) and at < len(lines):
            score, at = score + lines[at], at + 1
        if len(score) != len(seq):
            raise ValueError(f"{name}: {len(seq)} symbols and {len(score)} scores")
        yield name, seq, [ord(c) - offset for c in score]


def read_fastq(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """(path, header, seq, quality). Files are read whole: a record's border can't be told from inside a file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, text in zip(part["path"], part["content"], strict=True):
                rows = list(parse_fastq(text.decode(), offset))
                yield pd.DataFrame({"path": p, "header": [r[0] for r in rows], "seq": [r[1] for r in rows], "quality": [r[2] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, header string, seq string, quality array<int>")


def scores(text: Column, offset: int = 33) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def score_text(quality: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(quality, lambda q: F.char(q + offset)), "")


def write_fastq(records: DataFrame, path: str, *, offset: int = 33, width: int | None = None) -> None:
    wrap = lambda c: c if width is None else F.regexp_replace(c, f"(.{{{width}}})(?=.)", "$1\n")
    text = F.concat(F.lit("@"), F.col("header"), F.lit("\n"), wrap(F.col("seq")), F.lit("\n+\n"), wrap(score_text(F.col("quality"), offset)))
    records.select(text.alias("value")).write.text(path)
