"""Seed extension against every hit extended in plain Python."""

import random

import pandas as pd

from strandlake.operators import kernels
from strandlake.plans import catalog


def test_every_diagonal_is_extended(spark, tmp_path):
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("ACGT") for _ in range(n))

    refs = {i: text(60) for i in range(4)} | {4: "A" * 30, 5: text(8)}
    chance = refs[0][20:32]
    docs = {
        0: chance + text(200) + refs[0] + text(9),
        1: refs[1][:14] + text(40) + refs[1][30:] + refs[2],
        2: "A" * 50 + refs[3][:25] + "T" + refs[3][26:],
        3: text(5),
        4: refs[2][:20] + text(25) + refs[2][20:40] + refs[2],
    }
    pd.DataFrame({"doc_id": list(docs), "text": list(docs.values())}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": list(refs), "text": list(refs.values())}).to_parquet(tmp_path / "benchmark.parquet")
    table, want = kernels.score_table(1, -1), {}
    for d, p in docs.items():
        for r, q in refs.items():
            for i in range(len(p) - 11):
                for j in range(len(q) - 11):
                    if p[i : i + 12] == q[j : j + 12]:
                        score, before, after = kernels.extend(kernels.codes(p), kernels.codes(q), i, j, table, 20)
                        made = (-score, i - before, j - before, before + after)
                        want[d, r] = min(want.get((d, r), made), made)
    got = catalog.QUERIES["seed_extension"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and want[0, 0][0] <= -60
    assert {(x.query_id, x.ref_id): (-x.score, x.start1, x.start2, x.length) for x in got} == want
