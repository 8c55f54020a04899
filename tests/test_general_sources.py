import pytest

from strandlake.sources import general


@pytest.mark.parametrize("suffix", ["fasta", "fa", "fastq", "gb"])
def test_sequences_by_suffix(spark, tmp_path, suffix):
    rows = [("one", "ACGTACGTTT"), ("two", "GGCC" * 30)]
    path = str(tmp_path / f"reads.{suffix}")
    general.save_sequences(spark.createDataFrame(rows, "header string, seq string"), path)
    got = general.load_sequences(spark, path + "/").collect()
    assert sorted((r.header, r.seq) for r in got) == rows


def test_one_sequence(spark, tmp_path):
    frame = spark.createDataFrame([("one", "ACGT"), ("two", "GG")], "header string, seq string")
    general.save_sequences(frame.limit(1), str(tmp_path / "a.fasta"))
    general.save_sequences(frame, str(tmp_path / "b.fasta"))
    assert general.load_sequence(spark, str(tmp_path / "a.fasta")).first().seq == "ACGT"
    with pytest.raises(Exception, match="one sequence"):
        general.load_sequence(spark, str(tmp_path / "b.fasta")).collect()
    with pytest.raises(ValueError):
        general.format_of("reads.txt")


def test_a3m_rows():
    assert general.a3m_text(["AC-GT", "A-TGT", "ACT--"]) == ["ACGT", "A-tGT", "ACt--"]
