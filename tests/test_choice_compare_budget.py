"""Choice of a text, equality of multisets, the running budget."""

import json
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lexloom.operators import choice, compare, state

TEXTS = "law string, article string, lang string, text string, original boolean"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_choose_texts(spark):
    cantonal = spark.createDataFrame([("zh-kv", "1", "de", "Zürich", True), ("bv", "1", "fr", "cantonal first", False)], TEXTS)
    federal = spark.createDataFrame([("bv", "1", "de", "Schweiz", True), ("bv", "1", "fr", "Suisse", False), ("bv", "2", "it", "Solo", False), ("bv", "3", "de", None, True), ("bv", "1", "de", "Z", True)], TEXTS)
    asked = [("zh-kv", "1", "fr"), ("zh-kv", "1", "de"), ("bv", "1", "fr"), ("bv", "1", "en"), ("bv", "1", None), ("bv", "2", "de"), ("bv", "2", "it"), ("bv", "3", "de"), ("bv", "9", "de"), ("bv", "1", "fr")]
    got = choice.choose_texts(spark.createDataFrame(asked, "law string, article string, lang string"), cantonal, federal)
    rows = {(r.law, r.article, r.lang): (r.text, r.text_lang, r.source, r.fallback) for r in got.collect()}
    assert rows == {
        ("zh-kv", "1", "fr"): ("Zürich", "de", 0, True), ("zh-kv", "1", "de"): ("Zürich", "de", 0, False),
        ("bv", "1", "fr"): ("cantonal first", "fr", 0, False), ("bv", "1", "en"): ("Schweiz", "de", 1, True), ("bv", "1", None): ("Schweiz", "de", 1, False),
        ("bv", "2", "de"): (None, None, None, False), ("bv", "2", "it"): ("Solo", "it", 1, False), ("bv", "3", "de"): (None, None, None, False), ("bv", "9", "de"): (None, None, None, False),
    }
    assert got.count() == 9  # equal requests are one
    assert _plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(got)
    assert choice.choose_texts(spark.createDataFrame([], "law string, article string, lang string"), federal).count() == 0


def test_cantonal_files(spark, tmp_path):
    law = {"canton": "ZH", "law_key": "KV", "sr_number": "101", "language": "de", "title": "Verfassung", "lexfind_id": 5, "article_count": 2, "articles": [{"number": 1, "suffix": "", "raw": "1", "title": "A"}, {"number": 2, "suffix": "a", "raw": "2a"}], "article_texts": {"1": [{"num": "1", "text": "Eins"}, {"num": None, "text": "Zwei"}], "2a": []}}
    (tmp_path / "zh-kv.json").write_text(json.dumps(law, indent=2))
    (tmp_path / "note.txt").write_text("x")
    rows = choice.read_cantonal(spark, str(tmp_path)).orderBy("article").collect()
    assert [(r.law, r.article, r.lang, r.text, r.original) for r in rows] == [("zh-kv", "1", "de", "1 Eins\nZwei", True), ("zh-kv", "2a", "de", "", True)]
    assert [(r.raw, r.title) for r in choice.cantonal_article_lists(spark, str(tmp_path)).orderBy("raw").collect()] == [("1", "A"), ("2a", None)]
    slugs = spark.createDataFrame([("BV", None, None), ("KV ZH", "ZH", "KV")], "a string, c string, t string").select(choice.law_slug(F.col("a"), F.col("c"), F.col("t")))
    assert [r[0] for r in slugs.collect()] == ["bv", "zh-kv"]


def test_same_rows_equals_except_all(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.choice(["a", "b", None]), rng.choice([0.5, None, float("nan")])) for _ in range(60)]
    schema = "k int, s string, x double"
    df = lambda rs: spark.createDataFrame(rs, schema).repartition(3)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    cases = [(rows, shuffled, True), (rows, rows[1:], False), (rows, rows[1:] + rows[:1], True), (rows, rows[1:] + [(9, "z", None)], False), ([], [], True), ([], rows, False), (rows[:1] * 2 + rows[2:3], rows[:1] + rows[2:3] * 2, rows[0] == rows[2]), ([(1, None, 1.0)], [(None, "1", 1.0)], False), ([(1, "a", 0.0)], [(1, "a", -0.0)], True)]
    for a, b, same in cases:
        x, y = df(a), df(b)
        assert compare.same_rows(x, y) is same
        assert (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()) is same
        assert compare.multiset_difference(x, y).isEmpty() is same
    got = compare.multiset_difference(df([(1, "a", None)] * 3), df([(1, "a", None), (2, None, None)]))
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 2), (2, -1)]


def test_same_rows_columns(spark):
    a = spark.createDataFrame([(1, "x", [1, None], {"k": 1})], "a int, b string, c array<int>, m map<string,int>")
    assert compare.same_rows(a, a.select("m", "c", "B", "a"))
    other = spark.createDataFrame([(1, "x", [None, 1], {"k": 1})], a.schema)
    assert compare.fingerprint(a) != compare.fingerprint(other)
    with pytest.raises(ValueError, match="different columns"):
        compare.same_rows(a, a.drop("c"))


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_budget_of_all_events(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i * 3, rng.choice(["completed", "failed", "add"]), rng.choice([None, 5, 20])) for i in rng.sample(range(400), 200)]
    ev = spark.createDataFrame(rows, "seq long, event string, cost long").repartition(5)
    got = state.budget_reached(ev, 500, ranges=ranges)
    want = sorted(rows)
    sums = accumulate(c or 0 if e == "completed" else 0 for _, e, c in want)
    assert [(r.seq, r.running_cost, r.exceeded) for r in got.orderBy("seq").collect()] == [(s, t, t > 500) for (s, _, _), t in zip(want, sums)]
    assert (ranges == 1 or "SinglePartition" not in _plan(got)) and got.columns == ["seq", "event", "cost", "running_cost", "exceeded"]


def test_budget_edges(spark):
    schema = "seq long, event string, cost double"
    assert state.budget_reached(spark.createDataFrame([], schema), 1.0).count() == 0
    one = state.budget_reached(spark.createDataFrame([(None, "completed", 2.0), (5, "completed", 1.0), (6, "failed", 9.0)], schema), 2.0).orderBy("seq").collect()
    assert [(r.seq, r.running_cost, r.exceeded) for r in one] == [(None, 2.0, False), (5, 3.0, True), (6, 3.0, True)]
