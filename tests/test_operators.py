"""Acceptance cases of the corpus operators."""

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import citations, extract, inventory, state, validate
from lexloom.sources import content


def _one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(expr).first()[0]


def test_text(spark):
    assert _one(spark, T.dir_name(F.col("n"), F.col("s")), n=1186, s="a") == "art-1186a"
    assert _one(spark, T.dir_name(F.col("n"), F.col("s")), n=8, s="") == "art-008"
    assert _one(spark, T.slug_of_dir(F.col("d")), d="art-050bis") == "art-50bis"
    assert _one(spark, T.slug_of_dir(F.col("d")), d="art-0123456789012") == "art-123456789012"
    assert _one(spark, T.slug_of_dir(F.col("d")), d="art-000") == "art-0"
    assert _one(spark, T.clean_extracted(F.col("t")), t="Bundes-\nrechts über-\nänderung\n12\nBBl 1999\nend") == "Bundesrechts überänderung\nend"
    assert _one(spark, T.clean_ocr(F.col("t")), t="N.12  x\n\n\n\ny") == "N. 12 x\n\ny"
    assert _one(spark, T.bbl_reference(F.col("t")), t="BBl 1999 IV  4462") == "bbl-1999-IV-4462"
    assert _one(spark, T.key_of_file_name(F.col("t")), t="REF-X-Art-196-Ziff-1-2.pdf") == "196ziff1-2"
    assert _one(spark, T.key_of_file_name(F.col("t")), t="REF-X-1-Abschnitt.pdf") is None
    assert _one(spark, T.article_title(F.col("t")), t="Zweck Fassung gemäss Ziff. I") == "Zweck"
    assert _one(spark, T.article_title(F.col("t")), t="Aufgehoben durch") == ""
    assert _one(spark, T.rfc822(F.to_timestamp_ntz("t")), t="2026-03-17") == "Tue, 17 Mar 2026 00:00:00 GMT"
    assert _one(spark, content.rpc_text(F.col("t")), t='event: m\ndata: {"result":{"content":[{"type":"text","text":"a"},{"type":"x","text":"b"}]}}') == "a"


def test_article_list(spark):
    text = "Header\n- Art. 2 Zweck\n- Art. 1\n- Art. 11 – 13 Range\n- Art. 1 Again\n- Art. 6 a Note\n- Art. x"
    got = inventory.parse_article_lists(spark.createDataFrame([("BV", text)], "law string, text string")).collect()
    assert [(r.raw, r.title) for r in got] == [("1", None), ("2", "Zweck"), ("6a", "Note")]


def test_paragraphs(spark):
    raw = "# Law\n### Art. 1\nIntro\n1 First\nmore\n2 Second"
    got = inventory.article_paragraphs(spark.createDataFrame([("a", raw), ("b", "no body")], "key string, raw string"), ["key"]).orderBy("pos").collect()
    assert [(r.num, r.text) for r in got] == [(None, "Intro"), ("1", "First\nmore"), ("2", "Second")]
    cont = inventory.continued_paragraphs(spark.createDataFrame([("a", "1 One\ngoes on\n2 Two"), ("b", " ")], "key string, text string"), ["key"]).orderBy("pos").collect()
    assert [(r.num, r.text) for r in cont] == [("1", "One goes on"), ("2", "Two")]


def test_scaffold_keeps_what_exists(spark):
    cand = spark.createDataFrame([("BV", 1, "", "Zweck"), ("BV", 2, "", "")], "law string, number int, suffix string, title string")
    metas = spark.createDataFrame([("BV", 1, "", "Art. 1 BV")], "law string, number int, suffix string, title string")
    files = spark.createDataFrame([("BV", 1, "", "summary.md")], "law string, number int, suffix string, file string")
    created, updated, new = inventory.scaffold(cand, metas, files)
    assert [(r.number, r.title) for r in created.collect()] == [(2, "Art. 2 BV")]
    assert updated.first().title == "Zweck" and new.count() == 5
    assert created.first().absatz_count == 1


def test_feed_title_of_an_article_without_one(spark):
    from lexloom.plans import publish

    layers = {"summary": ("2026-01-02", 1)}
    rows = [("bv", ("BV", 8, "a", None, layers)), ("or", ("OR", 41, "", "Haftung", layers))]
    schema = "law_dir string, record struct<law:string,article:int,article_suffix:string,title:string,layers:map<string,struct<last_generated:string,version:int>>>"
    got = publish.feed_entries(spark.createDataFrame(rows, schema)).collect()
    assert [r.title for r in got] == ["Art. 8a BV", "Haftung"]


def test_tree(spark):
    key = "law_dir string, art_dir string"
    dirs = spark.createDataFrame([("bv", "art-001"), ("bv", "art-002"), ("or", "art-003"), (".git", "art-009"), ("bv", "other")], key)
    files = spark.createDataFrame([("bv", "art-001", f"{x}.md") for x in ("summary", "doctrine", "caselaw")], key + ", file string")
    metas = spark.createDataFrame([("bv", "art-001", "BV", {"summary": 1}, []), ("or", "art-003", "BV", {}, [])], key + ", law string, layers map<string,int>, problems array<string>")
    errors = validate.tree_errors(dirs, files, metas)
    assert sorted(r.error.split(": ")[0] for r in errors.collect()) == ["bv/art-002"] + ["or/art-003"] * 4
    assert tuple(validate.tree_report(dirs, errors).first()) == (3, 5, False)


def test_state(spark):
    rows = [(1, "BV", 1, "", "add", None, None), (2, "BV", 1, "", "completed", 2.0, None), (3, "BV", 1, "", "completed", 3.0, None), (4, "BV", 2, "", "add", None, None), (5, "BV", 9, "", "completed", 1.0, None), (6, "BV", 2, "", "failed", None, "x")]
    ev = spark.createDataFrame(rows, "seq long, law string, article_number int, article_suffix string, event string, cost double, error string")
    st = state.replay(ev)
    assert sorted((r.article_number, r.status, r.cost_usd, r.error) for r in st.collect()) == [(1, "completed", 3.0, ""), (2, "failed", 0.0, "x")]
    assert state.total_cost(ev).first()[0] == 5.0 and state.pending(st).count() == 0


def test_decisions(spark):
    text = "1. **BGE 130 III 182** - T\n   Laws: OR Art. 41, OR Art. 42\n\n**2. 5A_1/2026** (2026-04-01) [b] [de]\n   auf Art. 8 BV und Art. fff.__"
    d = citations.parse_decisions(spark.createDataFrame([(text,)], "text string"))
    got = {r.reference: [(a.law, a.article) for a in r.articles] for r in d.collect()}
    assert got == {"BGE 130 III 182": [("OR", 41), ("OR", 42)], "5A_1/2026": [("BV", 8)]}
    assert citations.by_article(d).count() == 3


def test_pages(spark):
    p = spark.createDataFrame([("d", 2, "b\n7"), ("d", 1, "a-\nb")], "doc string, page int, text string")
    assert extract.join_pages(p).first().text == "[Page 1]\nab\n\n[Page 2]\nb"
    assert [r.key for r in extract.split_volume(spark.createDataFrame([("Art. 41\n\nx\n\nArt. 6a\n\ny",)], "text string")).collect()] == ["41", "6a"]
