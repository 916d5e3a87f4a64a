"""Ranked search against scores of every document, with the awkward inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _scored(docs, items, k):
    found = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, all_terms = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(_terms(t))
    out = []
    for item, ws in wanted.items():
        scores = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // all_terms if all_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    common, rare = ["the", "of", "Ärger", "straße", "x1"], [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice((3, 20, 200))))) for i in range(300)]
    docs += [(i + 1000, docs[7][1]) for i in range(120)] + docs[:4] + [(None, docs[7][1]), (None, docs[9][1]), (5000, None), (5001, ""), (5002, "?! -"), (5003, "THE É " * 40_000)]
    items = [(i, " ".join(rng.sample(rare, 6) + rng.sample(common, 3))) for i in range(12)] + [(20, docs[7][1]), (21, None), (22, "unheard"), (20, "w3 w4"), (None, "w5 the"), (23, "the of")]
    return docs, items


def _same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("postings", [2_000_000, 300])
def test_equals_whole_scores(spark, tables, monkeypatch, postings):
    monkeypatch.setattr(R, "BLOCK_POSTINGS", postings)
    docs, items = tables
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score long").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    _same([tuple(r) for r in R.ranked_search(d, q, k=10).collect()], _scored(docs, items, 10))


def test_several_passes(spark, tables, monkeypatch):
    monkeypatch.setattr(R, "PASS_TERMS", 40)
    docs, items = tables
    got = R.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=50)
    _same([tuple(r) for r in got.collect()], _scored(docs, items, 50))


def test_empty_tables(spark, tables):
    docs, items = tables
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(docs[:5], "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string")
    for d, i in ((none, q), (blank, q), (some, q.limit(0)), (none, q.limit(0))):
        got = R.ranked_search(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_stops_early():
    """A rare term decides: the postings of the common term stay unread but for the scores of the best."""
    n = 20_000
    doc = np.concatenate((np.arange(n), np.arange(0, n, 100)))
    term = np.concatenate((np.zeros(n, np.int64), np.ones(n // 100, np.int64)))
    impact = np.concatenate((np.arange(n) % 50 + 1, np.arange(n // 100) * 1000 + 5000))
    order = np.lexsort((term, doc))
    index = R.BlockIndex(np.arange(n), doc[order], term[order], impact[order], 2)
    docs, scores = index.search(np.array([0, 1]), np.array([True, True]), 50, 0)
    top = R._best(docs, np.zeros(len(docs), bool), scores, 50)
    whole = np.bincount(doc, weights=impact, minlength=n).astype(np.int64)
    assert scores[top].tolist() == sorted(whole.tolist(), reverse=True)[:50]
    assert index.postings_read < 1000
