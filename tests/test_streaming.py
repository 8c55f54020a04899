import time

from pyspark.sql import functions as F

from strandlake.streaming import events


def _drain(spark, df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_fasta_stream_and_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">a\nACGT\nAC\n>b\nAAAA\n")
    rows = events.fasta_stream(spark, str(tmp_path / "in"))
    assert sorted((r.header, r.seq) for r in _drain(spark, rows.drop("path"), "fa", "append", str(tmp_path / "c1"))) == [("a", "ACGTAC"), ("b", "AAAA")]
    timed = rows.withColumn("ts", F.lit("2024-01-01 00:03:00").cast("timestamp"))
    got = _drain(spark, events.windowed_kmer_counts(timed, "ACGT", 2), "km", "complete", str(tmp_path / "c2"))
    assert {r.kmer: r.n for r in got} == {0: 3, 1: 2, 6: 1, 11: 1, 12: 1}


def test_run_lengths_keep_state_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        (src / name).write_text("\n".join(f"{k},2024-01-01T{t},{s}" for k, t, s in rows))
        time.sleep(1.1)  # files are taken by age

    put("1.csv", [(1, "00:00:01", "a"), (1, "00:00:02", "a"), (2, "00:00:01", "x")])
    put("2.csv", [(1, "00:00:03", "a"), (1, "00:00:04", "b")])
    put("3.csv", [(1, "00:00:05", "a"), (2, "09:00:00", "y")])
    rows = spark.readStream.schema("key long, ts timestamp, symbol string").option("maxFilesPerTrigger", 1).csv(str(src))
    got = [(r.key, r.symbol, r.n) for r in _drain(spark, events.run_lengths(rows), "rl", "append", str(tmp_path / "c"))]
    assert (1, "a", 3) in got and (1, "b", 1) in got and (2, "x", 1) in got
