"""Profiles and identities over every letter of every sequence."""

import pandas as pd

from strandlake.plans import catalog


def test_no_letter_and_no_item_is_left_out(spark, tmp_path):
    texts = ["ACGT" * 20, "ACG", "", "T" * 35]
    pd.DataFrame({"item_id": range(4), "text": texts}).to_parquet(tmp_path / "benchmark.parquet")
    rows = catalog.QUERIES["profile_counts_whole"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in rows) == sum(map(len, texts)) and len(rows) == 4 * 80
    consensus = catalog.QUERIES["profile_consensus_whole"](spark, str(tmp_path)).first().consensus
    assert len(consensus) == 80 and consensus[:3] == "ACG" and consensus[35:] == ("ACGT" * 20)[35:]
    got = {(r.id1, r.id2): (r.identity, r.score) for r in catalog.QUERIES["ungapped_identity_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[0, 1] == (1.0, 15) and got[0, 2] == (None, 0) and got[0, 3] == (round(8 / 35, 6), 8 * 5 - 27 * 4)
