"""Streaming forms of batch operators: an extension, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlake.operators.kmers import explode_kmers


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, seq) of FASTA files as they arrive in a folder."""
    rows = spark.readStream.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("v"))
    lines = F.filter(F.split("v", "\n"), lambda x: (F.length(F.trim(x)) > 0) & ~F.startswith(x, F.lit(";")))
    rows = rows.withColumn("l", lines).where(F.size("l") > 0)
    return rows.select("path", F.trim(F.regexp_replace(F.element_at("l", 1), "^>", "")).alias("header"), F.array_join(F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: F.trim(x)), "").alias("seq"))


def windowed_kmer_counts(sequences: DataFrame, alphabet: str, k: int, *, time: str = "ts", seq: str = "seq", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kmer, n) by tumbling windows of event time; rows later than the watermark are left out."""
    rows = sequences.withWatermark(time, late).select(time, F.struct(time).alias("_k"), seq)
    made = explode_kmers(rows, alphabet, k, key="_k", seq=seq).select(F.col(f"ref_id.{time}").alias(time), "kmer")
    return made.groupBy(F.window(time, width).alias("w"), "kmer").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kmer", "n")


RUNS = "key long, symbol string, first timestamp, last timestamp, n long"


def _runs(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The runs that end in a batch; the open run is the state, and ends when its key times out."""
    run = list(state.get) if state.exists else None
    out = []
    if state.hasTimedOut:
        state.remove()
        out.append((key[0], *run))
    else:
        rows = pd.concat(list(parts)).sort_values(["ts", "symbol"])
        for ts, symbol in zip(rows["ts"], rows["symbol"], strict=True):
            if run is not None and run[0] == symbol:
                run[2], run[3] = ts, run[3] + 1
            else:
                if run is not None:
                    out.append((key[0], *run))
                run = [symbol, ts, ts, 1]
        state.update(tuple(run))
        deadline = int(pd.Timestamp(run[2]).timestamp() * 1000) + WAIT_MS
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["key", "symbol", "first", "last", "n"])


WAIT_MS = 60_000


def run_lengths(events: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """(key, symbol, first, last, n): runs of equal symbols of each key of a stream (key long, ts, symbol).

    A key's state is one open run. A run is given out when another symbol follows, or when the
    watermark passes its last row by a minute.
    """
    rows = events.withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(_runs, RUNS, "symbol string, first timestamp, last timestamp, n long", "append", GroupStateTimeout.EventTimeTimeout)
