"""Sitemap files, reports, prompts that fail, rounds with feedback, small functions."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import validate
from lexloom.plans import prompts, publish
from lexloom.plans.regenerate import regenerate, round_report

NS = {"s": "http://www.sitemaps.org/schemas/sitemap/0.9", "x": "http://www.w3.org/1999/xhtml"}


def _urls(path):
    root = ET.parse(path).getroot()
    return [(u.find("s:loc", NS).text, [x.get("href") for x in u.findall("x:link", NS)]) for u in root.findall("s:url", NS)]


@pytest.mark.parametrize("limit", [7, 50_000])
def test_sitemap_files_hold_the_url_table(spark, tmp_path, limit):
    dirs = spark.createDataFrame([("or", f"art-{i:03d}") for i in range(30)] + [("bv", "art-001a"), ("bgfa", "art-001"), ("bv", "x")], "law_dir string, art_dir string")
    urls = publish.sitemap_urls(dirs)
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "sitemap.xml").write_text("old")
    names = publish.write_sitemap(urls, f"file://{tmp_path}/site", f"file://{tmp_path}/scratch", urls_a_file=limit)
    want = [(r.url, r.alternates) for r in urls.orderBy("lang_pos", "part", "n", "art_dir").collect()]
    parts = [n for n in names if n != "sitemap.xml"] or ["sitemap.xml"]
    got = [_urls(tmp_path / "site" / n) for n in parts]
    assert [u for g in got for u in g] == want and len(want) == 4 * (4 + 8 + 31)
    assert all(len(g) == limit for g in got[:-1]) and 0 < len(got[-1]) <= limit
    if limit == 7:
        index = ET.parse(tmp_path / "site" / "sitemap.xml").getroot()
        assert [x.text for x in index.iter(f"{{{NS['s']}}}loc")] == [f"{publish.SITE}/sitemap-{i + 1}.xml" for i in range(len(parts))]


def test_numbered(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(6)
    got = publish.numbered(rows, ["k"], str(tmp_path / "n"))
    assert got.where("k <> number").count() == 0 and got.count() == 1000
    assert publish.numbered(rows.limit(0), ["k"], str(tmp_path / "e")).count() == 0


def test_report_text(spark):
    key = "law_dir string, art_dir string"
    dirs = spark.createDataFrame([("bv", "art-002"), ("bv", "art-001")], key)
    files = spark.createDataFrame([("bv", "art-001", f"{x}.md") for x in ("summary", "doctrine", "caselaw")], key + ", file string")
    metas = spark.createDataFrame([("bv", "art-001", "BV", {}, [])], key + ", law string, layers map<string,int>, problems array<string>")
    errors = validate.tree_errors(dirs, files, metas)
    assert validate.report_text(dirs, errors) == ("Validated 2 articles\n1 errors:\n  - bv/art-002: missing meta.yaml", 1)
    ok = dirs.where("art_dir = 'art-001'")
    assert validate.report_text(ok, validate.tree_errors(ok, files, metas)) == ("Validated 1 articles\nAll valid.", 0)
    many = validate.report_text(dirs, validate.tree_errors(dirs, files, metas.limit(0)), shown=1)
    assert many[0].endswith("bv/art-001: missing meta.yaml\n  ... and 1 more") and many[1] == 1


def test_guidelines(spark):
    files = spark.createDataFrame([("global", "G"), ("or", "O"), ("summary", "S"), ("doctrine", "D")], "file string, text string")
    ask = lambda *rows: prompts.guidelines(files, spark.createDataFrame(rows, "law string, layer string")).collect()
    got = {(r.law, r.layer): r.system_prompt for r in ask(("OR", "summary"), ("BV", "doctrine"), ("OR", "summary"))}
    assert got == {("OR", "summary"): "G\n\nO\n\nS", ("BV", "doctrine"): "G\n\nD"}
    for bad, message in ((("OR", "poem"), "unknown layer: poem"), (("XX", "summary"), "unknown law: XX"), (("OR", None), "unknown layer: null"), (("OR", "caselaw"), "no guideline: caselaw")):
        with pytest.raises(Exception, match=message):
            ask(("OR", "summary"), bad)


class Models:
    """Passes a request once its feedback has been given `needs` times; keeps what it was asked."""

    def __init__(self):
        self.asked, self.die = [], None

    def generate(self, df):
        if len(self.asked) == self.die:
            raise RuntimeError("stopped")
        self.asked.append(sorted((r.id, r.feedback) for r in df.collect()))
        return df.withColumn("text", F.concat(F.lit("attempt "), F.lit(len(self.asked)))).withColumn("cost", F.lit(1.0))

    def evaluate(self, df):
        said = F.concat(F.coalesce("feedback", F.lit("")), F.lit("x"))
        verdict = F.when(F.col("needs") < 99, F.length(said) > F.col("needs"))
        return df.withColumn("passed", verdict).withColumn("feedback", F.when(F.coalesce(verdict, F.lit(False)), F.lit(None)).otherwise(said))


def test_rounds(spark, tmp_path):
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 5), (4, 99)], "id int, needs int")
    m = Models()
    run = lambda root, **k: regenerate(spark, asked, m.generate, m.evaluate, f"file://{tmp_path}/{root}", **k)
    got = run("a")
    assert {r.id: (r["round"], r.passed, r.text, r.feedback) for r in got.collect()} == {1: (1, True, "attempt 1", None), 2: (2, True, "attempt 2", None), 3: (3, False, "attempt 3", "xxx"), 4: (3, False, "attempt 3", "xxx")}
    assert m.asked == [[(1, None), (2, None), (3, None), (4, None)], [(2, "x"), (3, "x"), (4, "x")], [(3, "xx"), (4, "xx")]]
    assert sorted(map(tuple, round_report(got).collect())) == [(1, 1, 0), (2, 1, 0), (3, 0, 2)]
    assert run("a").count() == 4 and len(m.asked) == 3  # all is kept
    m.asked.clear()
    assert {r["round"] for r in run("b", budget=5.0).collect()} == {1, 2} and len(m.asked) == 2


def test_rounds_go_on_after_a_stop(spark, tmp_path):
    asked = spark.createDataFrame([(1, 0), (2, 1)], "id int, needs int")
    m, root = Models(), f"file://{tmp_path}/r"
    m.die = 1
    with pytest.raises(RuntimeError, match="stopped"):
        regenerate(spark, asked, m.generate, m.evaluate, root)
    m.die = None
    got = regenerate(spark, asked, m.generate, m.evaluate, root)
    assert {r.id: r["round"] for r in got.collect()} == {1: 1, 2: 2} and [len(a) for a in m.asked] == [2, 1]


def test_small_functions(spark):
    one = spark.sql("SELECT map('a','1','b','2') AS m, map('b','3') AS n, CAST(NULL AS map<string,string>) AS z, '0123' AS d, TIMESTAMP'2026-01-01 00:00:00' AS s, TIMESTAMP'2026-01-01 00:00:02.5' AS e, 'https://x.ch/fr/or/art-1' AS u, 'https://x.ch/' AS v")
    r = one.select(T.merged(F.col("m"), F.col("n")).alias("a"), T.merged(F.col("z"), F.col("n")).alias("b"), T.all_digits(F.col("d")).alias("c"), T.all_digits(F.lit("1a")).alias("c2"), T.all_digits(F.lit("")).alias("c3"), T.elapsed_seconds(F.col("s"), F.col("e")).alias("t"), T.url_language(F.col("u")).alias("l"), T.url_path(F.col("u")).alias("p"), T.url_path(F.col("v")).alias("q")).first()
    assert tuple(r) == ({"a": "1", "b": "3"}, {"b": "3"}, True, False, False, 2.5, "fr", "/or/art-1", "/")


def test_totals(spark):
    rows = spark.createDataFrame([("OR",), ("OR",), ("BV",), (None,)], "law string")
    assert {(r.law, r.articles, r.laws) for r in publish.list_totals(rows).collect()} == {("OR", 2, 1), ("BV", 1, 1), (None, 3, 2)}
