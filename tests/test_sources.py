"""Sources and small operators that other tests do not reach."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.constants import LAWS
from lexloom.operators import citations, inventory, state
from lexloom.plans import prompts, publish
from lexloom.sinks import yaml_files
from lexloom.sources import article_source, content


@pytest.fixture
def service():
    """A service of article lists that speaks JSON-RPC over HTTP; StGB is not there."""
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            call = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append((call["method"], call["params"], self.headers["Accept"]))
            law = call["params"]["arguments"]["abbreviation"]
            self.send_response(404 if law == "StGB" else 200)
            self.end_headers()
            result = {"result": {"content": [{"type": "text", "text": f"- Art. 1 Zweck von {law}"}, {"type": "image"}]}}
            self.wfile.write(f"event: message\ndata: {json.dumps(result)}\n\n".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", calls
    server.shutdown()


def test_article_lists_over_http(spark, tmp_path, service):
    base, calls = service
    ask = content.rpc_caller(base, "get_law", "abbreviation", timeout=20)
    got, failed = article_source.fetch_article_lists(spark, ask, f"file://{tmp_path}/kept", attempts=1, wait=0)
    assert {(r.law, r.raw, r.title) for r in got.collect()} == {(law, "1", f"Zweck von {law}") for law in LAWS if law != "StGB"}
    assert [(r.law, r.error) for r in failed.collect()] == [("StGB", "HTTPError: HTTP Error 404: Not Found")]
    assert len(calls) == len(LAWS) and calls[0][0] == "tools/call" and calls[0][1]["name"] == "get_law" and "text/event-stream" in calls[0][2]


def test_fetch_texts_tries_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def fetch(row):
        n = len([x for x in log.iterdir() if x.name.startswith(f"{row['k']}-")])
        (log / f"{row['k']}-{n}").touch()
        if row["k"] == 2 or (row["k"] == 1 and n < 2):
            raise OSError("busy")
        return f"text {row['k']}"

    got = content.fetch_texts(spark.range(4).select(F.col("id").alias("k")), fetch, attempts=3, wait=lambda _: None)
    assert {r.k: r.text for r in got.collect()} == {0: "text 0", 1: "text 1", 2: "", 3: "text 3"}
    tries = lambda k: sum(x.name.startswith(f"{k}-") for x in log.iterdir())
    assert [tries(k) for k in range(4)] == [1, 3, 3, 1]


def test_scan_of_a_tree(spark, tmp_path):
    for path, text in (("bv/art-001/meta.yaml", "law: BV\narticle: 1\ntitle: A\nin_force_since: 2026-01-01\n"), ("bv/art-002/meta.yaml", "law: [broken"), (".git/art-003/meta.yaml", "law: BV"), ("or/art-004/summary.md", "x"), ("or/art-005/x.txt", "x")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "or/art-006").mkdir()
    rows = {r.art_dir: r.record for r in content.scan_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"art-001", "art-002"} and rows["art-002"] is None and rows["art-001"].in_force_since == "2026-01-01"
    assert sorted(r.file for r in content.scan_files(spark, str(tmp_path)).where("law_dir = 'or'").collect()) == ["summary.md"]
    assert {r.art_dir for r in content.list_directories(spark, str(tmp_path)).where("law_dir = 'or'").collect()} == {"art-004", "art-005", "art-006"}


def test_state_file(spark, tmp_path):
    path = tmp_path / "state.json"
    assert state.load_state(spark, str(path)).count() == 0
    one = {"law": "OR", "article_number": 1, "article_suffix": "", "status": "pending", "cost_usd": 0.0, "error": ""}
    path.write_text(json.dumps({"articles": [one, one | {"article_number": 2}, one | {"status": "completed", "cost_usd": 2.0}], "total_cost": 2.0}, indent=2))
    got = state.load_state(spark, str(path))
    assert sorted((r.article_number, r.status) for r in got.collect()) == [(1, "completed"), (2, "pending")]
    more = state.register(got, spark.createDataFrame([("OR", 2, ""), ("OR", 3, "")], "law string, article_number int, article_suffix string"))
    assert sorted((r.article_number, r.status) for r in more.collect()) == [(1, "completed"), (2, "pending"), (3, "pending")]


def test_legislation(spark):
    text = "**LexFind ID:** 12\n**In force since:** 2000-01-01\n**In force since:** 2001-01-01\n- [DE] https://a\n- [DE PDF] https://b\nother"
    got = inventory.legislation_metadata(spark.createDataFrame([("OR", text), ("BV", "**LexFind ID:** none")], "law string, text string"))
    rows = {r.law: r.asDict() for r in got.collect()}
    assert rows["OR"] == {"law": "OR", "lexfind_id": 12, "in_force_since": "2001-01-01", "fedlex_url": "https://a", "lexfind_url": "https://b", "sr_number": "220"}
    assert rows["BV"]["lexfind_id"] is None and rows["BV"]["sr_number"] == "101"


def test_affairs(spark):
    ref = {"title": "t", "publication": {"source": "BBl", "url": "u", "year": "2001", "page": "4202"}}
    full = {"id": 7, "shortId": "01.023", "drafts": [{"references": [ref], "consultation": {"resolutions": [{"council": {"name": "N"}, "date": "d"}]}}, {"consultation": {"resolutions": [{"council": {"name": "S"}}]}}]}
    flat = citations.affairs(spark.createDataFrame([(json.dumps(full),), (json.dumps({"id": 8}),)], "json string"))
    rows = {r.id: r for r in flat.collect()}
    assert [b.bbl_ref_normalized for b in rows["7"].botschaften] == ["bbl-2001-4202"] and [r.council for r in rows["7"].resolutions] == ["N", "S"]
    assert sorted(map(tuple, citations.affair_counts(flat).collect())) == [("7", 1, 2), ("8", 0, 0)]


def test_leading_cases(spark):
    rows = [("A", [("OR", 41, "")]), ("A", [("OR", 41, ""), ("OR", 42, "")]), ("B", [("OR", 41, "")]), ("C", [("BV", 8, "")]), ("C", [("BV", 8, "")]), ("C", [("BV", 9, "")])]
    d = spark.createDataFrame(rows, "reference string, articles array<struct<law:string,article:int,suffix:string>>")
    found = lambda **k: [tuple(r) for r in citations.leading_cases(d, **k).collect()]
    assert found() == [("C", 3), ("A", 2), ("B", 1)] and found(limit=1) == [("C", 3)]
    assert found(law="OR", article=41) == [("A", 2), ("B", 1)] and found(article=9) == [("C", 1)] and found(law="XX") == []


def test_seeds(spark):
    seeds = {law: ["19990027"] for law in LAWS}
    assert content.seed_affairs(spark, seeds | {"OR": ["1", "2", "1"]}).where("law = 'OR'").count() == 2
    for bad in ({}, seeds | {"OR": []}, seeds | {"OR": ["1a"]}, seeds | {"XX": ["1"]}, seeds | {"OR": ["²"]}):
        with pytest.raises(ValueError, match="laws without an affair"):
            content.seed_affairs(spark, bad)


def test_text_files(spark, tmp_path):
    layers = spark.createDataFrame([("OR", 41, "a", "summary", "Haftung"), ("BV", 8, "", "doctrine", None)], "law string, article int, suffix string, layer string, content string")
    yaml_files.write_layer_files(layers, str(tmp_path))
    assert (tmp_path / "or/art-041a/summary.md").read_text() == "Haftung" and not (tmp_path / "bv").exists()
    for bad in ("../x", "a//b", ".hidden", None, ""):
        with pytest.raises(Exception, match="no name of a directory or file"):
            yaml_files.write_texts(spark.createDataFrame([("ok", "1"), (bad, "x")], "path string, text string"), str(tmp_path))
    assert not (tmp_path / "ok").exists()


def test_cantonal_and_list_documents(spark, tmp_path):
    law = [("ZH", "KV", "101", "de", None, [(1, "", "1", "A")], {"1": [("1", "Eins")]})]
    yaml_files.write_cantonal(spark.createDataFrame(law, "canton string, law_key string, sr_number string, language string, title string, articles array<struct<number:int,suffix:string,raw:string,title:string>>, article_texts map<string,array<struct<num:string,text:string>>>"), str(tmp_path))
    got = json.loads((tmp_path / "zh-kv.json").read_text())
    assert got["article_count"] == 1 and got["article_texts"] == {"1": [{"num": "1", "text": "Eins"}]} and "title" not in got
    lists = spark.createDataFrame([("OR", "220", 2, "", "2", None), ("OR", "220", 1, "a", "1a", "T")], article_source.ARTICLES)
    yaml_files.write_article_documents(lists, f"{tmp_path}/lists")
    assert [r.raw for r in content.read_article_lists(spark, f"{tmp_path}/lists/or.json").collect()] == ["1a", "2"]
    assert json.loads((tmp_path / "lists/or.json").read_text())["OR"]["article_count"] == 2


def test_scaffold_records_are_written_and_valid(spark, tmp_path):
    from lexloom.operators.validate import article_problems

    cand = spark.createDataFrame([("OR", 41, "", "Haftung"), ("BV", 8, "a", "")], "law string, number int, suffix string, title string")
    none = spark.createDataFrame([], "law string, number int, suffix string, title string")
    created, _, _ = inventory.scaffold(cand, none, spark.createDataFrame([], "law string, number int, suffix string, file string"))
    yaml_files.write_records(inventory.scaffold_records(created), str(tmp_path))
    back = content.scan_records(spark, str(tmp_path)).select("art_dir", "record.*", )
    rows = {r.art_dir: r for r in back.withColumn("problems", article_problems()).collect()}
    assert set(rows) == {"art-041", "art-008a"} and all(r.problems == [] for r in rows.values())
    assert rows["art-008a"].title == "Art. 8a BV" and rows["art-041"].layers == {} and rows["art-041"].sr_number == "220"
    assert "layers: {}" in (tmp_path / "or/art-041/meta.yaml").read_text()


def test_prompts(spark):
    key = "law string, number int, suffix string"
    asked = spark.createDataFrame([("OR", 41, "", "doctrine", "too long"), ("OR", 41, "", "caselaw", None)], f"{key}, layer string, feedback string")
    texts = spark.createDataFrame([("OR", 41, "", "Wer haftet")], f"{key}, article_text string")
    refs = spark.createDataFrame([("OR", 41, "", "REFS")], f"{key}, refs string")
    mats = spark.createDataFrame([("OR", 41, "", "MATERIALS")], f"{key}, materials string")
    rows = {r.layer: r for r in prompts.generation(prompts.enrich(asked, texts, refs, mats)).collect()}
    assert all(x in rows["doctrine"].prompt for x in ("Wer haftet", "REFS", "MATERIALS", "too long", "content/or/art-041"))
    assert "REFS" not in rows["caselaw"].prompt and "MATERIALS" not in rows["caselaw"].prompt and "rejected" not in rows["caselaw"].prompt
    assert rows["doctrine"].model == "opus-thinking"
    one = prompts.translation(asked.drop("feedback").withColumn("target_lang", F.lit("fr"))).where("layer = 'doctrine'").first()
    assert one.target_layer == "doctrine.fr" and "French" in one.prompt
    for bad in (lambda: prompts.translation(asked.withColumn("target_lang", F.lit("de"))).collect(), lambda: prompts.generation(prompts.enrich(asked.withColumn("layer", F.lit("x")), texts, refs, mats)).collect()):
        with pytest.raises(Exception, match="unknown"):
            bad()


def test_variants(spark):
    rows = [("a", "base", "publish", 1.0, 10.0, {"precision": 0.9}), ("a", "think", "reject", 3.0, 30.0, {"precision": 0.7, "concision": 0.5}), ("b", "base", "publish", 2.0, 20.0, {"precision": 0.7})]
    r = spark.createDataFrame(rows, "article string, variant string, verdict string, cost double, seconds double, scores map<string,double>")
    one = {x.article: x for x in prompts.compare_variants(r, ["base", "think"]).collect()}
    assert one["a"].base_verdict == "publish" and one["a"].think_scores == {"precision": 0.7, "concision": 0.5} and one["b"].think_cost is None
    assert {x.variant: (x.runs, x.published, x.cost, round(x.mean_scores["precision"], 3)) for x in prompts.variant_summary(r).collect()} == {"base": (2, 2, 3.0, 0.8), "think": (1, 0, 3.0, 0.7)}


def test_pages(spark):
    row = spark.createDataFrame([(["Home", "OR", "Art. 1"], "Titel", None, "fr")], "trail array<string>, t string, n string, lang string")
    got = row.select(publish.breadcrumb(F.col("trail")).alias("b"), publish.page_title(F.col("t"), "Site").alias("t"), publish.page_title(F.col("n"), "Site").alias("n"), publish.locale(F.col("lang")).alias("l"), publish.locale(F.lit("xx")).alias("x"), T.lang_base(F.col("lang"), "/base//").alias("base")).first()
    assert [(b["item"], b.linked) for b in got.b] == [("Home", True), ("OR", True), ("Art. 1", False)]
    assert (got.t, got.n, got.l, got.x, got.base) == ("Titel — Site", "Site", "fr_CH", "de_CH", "/base/fr")
    concepts = spark.createDataFrame([("c", "C", ["or/art-041", "bv/art-008a"], "settled"), ("d", "D", [], "odd")], "slug string, title string, provisions array<string>, confidence string")
    pages = publish.concept_pages(concepts).where("lang = 'de'").orderBy("slug").collect()
    assert [(p.provision_count, p.confidence_label) for p in pages] == [(2, "concepts.settled"), (0, None)]
    assert [(x.href, x.label) for x in pages[0].links] == [("/de/or/art-41", "Art. 41 OR"), ("/de/bv/art-8a", "Art. 8a BV")]


def test_feed_document(spark):
    import xml.etree.ElementTree as ET

    rows = [("or", ("OR", i, "", f"T & {i}", {"summary": (f"2026-01-{i:02d}", 0), "doctrine": ("", 1)})) for i in range(1, 6)]
    schema = "law_dir string, record struct<law:string,article:int,article_suffix:string,title:string,layers:map<string,struct<last_generated:string,version:int>>>"
    items = publish.feed_items(publish.feed_entries(spark.createDataFrame(rows, schema), limit=3))
    doc = ET.fromstring(publish.feed_xml(items, "Feed", "All").first().value)
    assert [(i.find("title").text, i.find("guid").text, i.find("pubDate").text) for i in doc.iter("item")][0] == ("Art. 5 OR — T & 5 (Overview v1)", f"{publish.SITE}/de/or/art-5#summary-v1", "Mon, 05 Jan 2026 00:00:00 GMT")
    assert len(list(doc.iter("item"))) == 3
