from collections import Counter

import numpy as np

import corpus_pipeline
from strandlake.llm import pieces, quality, secrets, simhash
from tests.llm.helpers import awkward_documents, groups

SF = "/root/testdata/sf0.001"


def test_stages_and_their_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    start, good, single, clean, mixed, ids = seen
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    # 1: what scores below 0.3 goes.
    scores = {r.doc_id: r.score for r in quality.predict(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, s in scores.items() if s >= 0.3)
    # 2: the least of each group of sketches.
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    made = [np.frombuffer(simhash.sketch(r.text, corpus_pipeline.WORDS), np.uint8) for r in rows]
    budget = simhash.sketch_budget(corpus_pipeline.SIMILARITY)
    near = [(i, j) for i in range(len(made)) for j in range(i) if np.bitwise_count(made[i] ^ made[j]).sum() <= budget]
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[c].doc_id for c in groups(len(rows), near)})
    # 3: every document stays, without a base secret.
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect())
    assert all(not r.base_spans for r in secrets.scan(clean).collect())
    # 4: rows repeat at most three times.
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in clean.collect()} and max(times.values()) <= 3
    # 5: ids decode to the texts.
    texts = {r.doc_id: r.text for r in mixed.collect()}
    import public_tokenizers

    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = ids.collect()
    assert Counter(r.doc_id for r in got) == times
    assert all(model.decode(r.ids) == texts[r.doc_id] for r in got)


def test_near_copies_of_a_larger_table(spark):
    """Recall and precision of the stage on the texts of sf 0.01, by exact five-word similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shingles = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + corpus_pipeline.WORDS]) for i in range(max(1, len(w) - corpus_pipeline.WORDS + 1))}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, "").select("doc_id").collect()}
    ids, gone, wrong = sorted(shingles), [], []
    for i, a in enumerate(ids):
        alike = [len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for b in ids[:i]]
        if max(alike, default=0) >= corpus_pipeline.SIMILARITY:
            gone.append(a not in kept)
        all_ = alike + [len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) for b in ids[i + 1 :]]
        if max(all_) < 0.6:
            wrong.append(a not in kept)
    assert len(gone) > 20 and np.mean(gone) > 0.97
    assert len(wrong) > 100 and not any(wrong)


def test_run_gives_the_last_stages_rows(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"]


def test_awkward_rows_pass_all_stages(spark):
    docs = awkward_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    docs.count()
    docs = awkward_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
