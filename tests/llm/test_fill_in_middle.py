"""Fill-in-middle against a plain Python version, with the awkward inputs."""

import hashlib
import re

from pyspark.sql import functions as F

from lexloom.llm.fill_in_middle import fill_in_middle, fim_digests, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " \n\t ", "one", "one two", " a  b\n\nc d ", "with <P> inside", "<S", "x <M", "ümläut 日本語 𝒳 word", "word " * 30_000, " nbsp stays　in words"]


def _plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), sha(out), sha(text)


def test_equals_plain_version(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], i) for i in range(20 * len(TEXTS))]
    rows += rows[:30]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")  # n clashes with an output
    got = sorted((tuple(r) for r in fim_digests(docs).collect()), key=str)
    assert got == sorted(((i, *_plain(i, t)) for i, t, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_parts_restore(spark):
    docs = spark.createDataFrame([(i, "alpha beta  gamma\ndelta epsilon ") for i in range(300)], "`a.b` long, `t x` string")
    cut = fill_in_middle(docs, "a.b", "t x").select("*", restore(F.col("output"), F.col("form")).alias("back"))
    rows = cut.collect()
    assert all(r["back"] == r["t x"] for r in rows)
    assert all(r["prefix"] + r["middle"] + r["suffix"] == r["t x"] for r in rows if r["form"] != "plain")
    everything = fill_in_middle(docs, "a.b", "t x", fim_percent=100, spm_percent=0).groupBy("form").count().collect()
    assert [tuple(r) for r in everything] == [("psm", 300)]


def test_null_id_bad_bytes_and_empty(spark):
    bad = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(X'6120FF622063' AS STRING) AS text UNION ALL SELECT 3, CAST(X'6120FF622063' AS STRING)")
    rows = {r.doc_id: r for r in fim_digests(bad).collect()}
    want = hashlib.sha256("a �b c".encode()).hexdigest()
    assert {r.restored_sha256 for r in rows.values()} == {want} and rows[None].n == 3
    assert fim_digests(spark.createDataFrame([], "doc_id long, text string, form string")).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = fim_digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
