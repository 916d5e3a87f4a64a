"""The fold of byte pairs where places and ranks decide, and what Python workers import."""

import random
import subprocess
import sys

from pyspark.sql import functions as F

from lexloom.llm import bpe


def test_fold_merges_the_leftmost_pair_of_the_least_rank(spark):
    """Pairs of one rank, by other tokens and in one run, and merges that bring a lower rank."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"ba", b"aa", b"aab", b"aba", b"abab", b"bab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 40) for _ in range(6)] + ["a" * 41, "c"]
    got = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>").select("w", bpe.fold_merges(F.col("b"), bpe.RankMap(spark, ranks)).alias("ids")).collect()
    assert [r.ids for r in got] == [bpe.heap_merges(r.w.encode(), ranks) for r in got]


def test_dictionary_counts_travel_in_small_batches(spark, monkeypatch):
    """A task hands its counts on WORDS_AT_ONCE at a time, and begins anew where it remembers too many words."""
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    counts = {}
    docs = spark.createDataFrame([(" ".join(f"w{i % 90}" for i in range(k, k + 40)),) for k in range(50)], "text string")
    for r in bpe.frequent_words(docs, r"\w+", 1000, 20).collect():
        counts[bytes(r.word).decode()] = r.c
    want = {}
    for r in docs.collect():
        for w in r.text.split():
            want[w] = want.get(w, 0) + 1
    assert counts == {w: c for w, c in want.items() if c > 1}


def test_workers_need_no_pandas():
    """Each Python worker of a step imports these modules; pandas would take 27 MB of each."""
    code = "import sys, lexloom.llm.bpe, lexloom.llm.suffix_dedup, lexloom.llm.jaccard_join, lexloom.llm.toxicity, lexloom.llm.language_id; assert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
