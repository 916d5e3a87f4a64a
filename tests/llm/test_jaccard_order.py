"""The order of shingles by which op8 finds candidates: what few sets share must not join unlike texts."""

import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import jaccard_join
from lexloom.llm.shingles import shingle_set


def test_shingles_of_few_sets_come_after_rare_ones(spark):
    """Shingles of two sets are told from rare ones, however few the table of frequent ones holds."""
    own = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(40)]
    passage = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(20)]
    texts = [f"{t} {passage[i // 2]}" for i, t in enumerate(own)]  # each passage stands in two texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(F.col("doc_id").alias("id"), "text")
    order = jaccard_join._order_shingles(docs, 5)
    shared = np.concatenate([shingle_set(p.encode()) for p in passage])
    low = shared[shared < np.uint64(int(jaccard_join.REGION * (1 << 64)))]
    assert len(low) and not np.isin(low, order[0]).any() and order[2].holds(low).all()
    for t in texts:
        h = shingle_set(t.encode())
        assert not np.isin(jaccard_join._prefix(h, len(h) // 4, order), shared).any()


def test_a_full_filter_loses_no_link(spark, monkeypatch):
    """Where all levels overflow, more is compared and the components stay."""
    rng = np.random.default_rng(5)
    words = [[f"w{x}" for x in rng.integers(0, 30, 60)] for _ in range(12)]
    texts = [" ".join(w[:cut]) for w in words for cut in (60, 57, 54, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard_join, "FILTER_BYTES", 64)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 1)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == want
    sets = [set(shingle_set(t.encode()).tolist()) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = min(least[i], least[j])
    assert [c for _, _, c in want] == least
