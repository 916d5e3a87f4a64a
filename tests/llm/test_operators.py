"""Each operator against brute force, an exact round trip or held-out rows, with the awkward inputs."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import bpe, html_blocks, image_copies, jaccard_join, language_id, license_scan, mixing, mtree, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in was for that with this from court article federal commentary liability contract".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = _text(rng, 120).split()
    texts = [" ".join(base), " ".join(base), " ".join(base[:118] + ["x", "y"]), " ".join(base[:60]), "one two three", "One  TWO\nthree", "", None, "  \n", "!!! 123", _text(rng, 3000)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", score double, k long")


def _links(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())

    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_join(docs, empty):
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == _links(docs.collect())
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_split_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 150)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == _links(docs.collect())


def test_jaccard_join_hashes_of_regular_words(spark):
    """Words of one length whose letters follow the Thue-Morse sequence meet in any polynomial hash modulo 2^64."""
    w = "".join("xy"[bin(i).count("1") % 2] for i in range(4096))
    v = w.translate(str.maketrans("xy", "yx"))
    rows = [(1, f"{w} q w e r"), (2, f"{v} q w e r"), (3, f"{w} q w e r {v} q w e r"), (4, f"{w} Q w e r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect()) == _links(docs.collect())


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(0, 25)))) for _ in range(rng.randint(1, 14))]
        need = rng.randint(1, 10)
        docs, hits = jaccard_join.divide_skip(lists, need)
        count = {d: sum(d in x for x in lists) for d in range(30)}
        assert dict(zip(docs.tolist(), hits.tolist(), strict=True)) == {d: c for d, c in count.items() if c >= need}


def test_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    spark = docs.sparkSession
    odd = spark.createDataFrame([(1, "a" * 900), (2, "naïve 　 x\r\n\n  <|endoftext|> ½ \U0001f600\U0001f600"), (3, " \t "), (None, "don't we'LL"), (4, None)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = bpe.encode(odd, path, P.PATTERN).collect()
    want = sorted((str(r.doc_id), np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in odd.collect())
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_bpe_of_bad_bytes(spark):
    import public_tokenizers as P

    docs = spark.sql("SELECT 1L AS doc_id, cast(x'6162ff20ce' AS string) AS text UNION ALL SELECT 2L, 'ab\ufffd \ufffd'")
    a, b = sorted(bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect(), key=lambda r: r.doc_id)
    assert a.ids == b.ids and bytes(a.decoded).decode() == "ab\ufffd \ufffd"


def test_heap_merges():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 60)))
        assert bpe.heap_merges(w.encode(), ranks) == enc.encode_ordinary(w)


def test_licenses(docs, empty):
    spark = docs.sparkSession
    rows = [(1, "Released under the MIT License. under the mit license"), (2, "Apache License, Version 2.0"), (3, "CC BY-NC 4.0 by nc"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, None), (None, "under the MIT"), (1, "")]
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[1, 9].n_base, got[1, 9].first_word, got[1, 9].last_word, got[1, 9].base_labels) == (2, 1, 5, "mit")
    assert got[2, 5].base_labels == "apache-2" and got[3, 7].base_labels == "cc-by-nc"
    assert got[4, 12].n_base == 0 and got[4, 12].labels == "gpl-3" and got[5, 0].labels == "" and got[5, 0].first_word is None
    assert license_scan.scan_licenses(empty).count() == 0


def test_licenses_in_standard_and_altered_notices(spark):
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cc = "This work is licensed under {} Creative Commons Attribution-{} License."
    notices = {
        gnu.format("program", "", "3"): "gpl,gpl-3",
        gnu.format("program", "", "2"): "gpl",
        gnu.format("library", "Lesser ", "3"): "lgpl,lgpl-3",
        gnu.format("library", "Lesser ", "2.1"): "lgpl",
        gnu.format("program", "Affero ", "3"): "agpl,agpl-3",
        gnu.format("tool", "Affero ", "3").replace("modify", "change"): "agpl,agpl-3",
        cc.format("a", "ShareAlike 4.0 International"): "cc-by-sa",
        cc.format("the", "NonCommercial 4.0 International"): "cc-by-nc",
        cc.format("a", "NonCommercial-ShareAlike 3.0 Unported"): "cc-by-nc-sa",
        "This text is dedicated to the public domain": "public-domain",
        "This work is hereby dedicated to the public domain": "public-domain",
        "This work is dedicated to a friend": "",
        "licensed under the new GNU Lesser General Public License version 3": "lgpl-3",
        "licensed under the GNU Lesser General Public License version 2": "",
    }
    rows = list(enumerate(notices))
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == notices


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header>Top</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies here</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four<p>Five<!-- no --></article><div id=comments><p>Nice read of the day it was</p></div><form>Name</form><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain < text"), (1, "u", page)]
    got = html_blocks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got][:3] == ["A & B One two three four Five", "", ""] and got[3].text == "plain < text" and len(got) == 5
    assert got[0].n_chars == len(got[0].text)


def test_html_names_that_only_hold_a_boilerplate_word():
    tree, long = html_blocks.train_tree(), " ".join(["word"] * 30)
    text = lambda body, mark="": html_blocks.main_text(f"<html{mark}><body{mark}>{body}</body></html>", tree)
    assert text(f"<article><p>{long}</p></article>", " class='has-sidebar with-ads'") == long
    for part in (f"<h2 id='related-work'>Title here</h2><p>{long}</p>", f"<section id='search-algorithms'><p>{long}</p></section>", "<div class='entry-header'><h1>Title here</h1></div>", f"<p id='how-to-share-data'>{long}</p>", f"<section id='copyright'><p>{long}</p></section>", f"<h2 class='header'>Title here</h2><p>{long}</p>"):
        page = f"<article><p>{long}</p>{part}</article>"
        assert text(page) == long + " " + " ".join(html_blocks.re.sub("<[^>]*>", " ", part).split())
    for part in ("<div class='share-links'>Tell them now</div>", f"<div id='comments'><p>{long}</p></div>", f"<article class='comment-body'><p>{long}</p></article>", f"<div class='ad'>{long}</div>", "<div class='more-related-stories'><a href=/x>Other one</a></div>", f"<div class='site-footer'>{long}</div>"):
        assert text(f"<article><p>{long}</p>{part}</article>") == long


HELD_OUT = """
<body><div id=header>-4</div><ul class=menu><li><a>-1</a><li><a>-3</a></ul><div><h1>+7</h1><p>+33<p>+4<p>+71 <a>6</a><p>+2</div><div class=footer>-11</div>
<body><nav><a>-2</a> <a>1</a></nav><main><h1>+3</h1><p>+55<blockquote>+16</blockquote><p>+8</main><p>-5<footer>-3</footer>
<body><p><a>-3</a><p>+90<p>+1<p>+27 <a>9</a><p><a>-2</a> <a>4</a>
<body><article><h1>+5</h1><p>+1<p>+2<section class=comments><p>-40<p>-9</section></article><article><p>+17</article><div>-30</div>
<body><table><tr><td><a>-2</a><td><a>-6</a></table><table><tr><td>+41<td>+2<tr><td>+12</table>
<body><h1>+6</h1><div class=cookies>-20</div><p>+19 <a>11</a><p>+19<aside><p>-60</aside><p>+3<p>1 <a>-7</a><form>-3<label>-2</label></form>
<body><h3>+2</h3><p>+5
<body><div class=topbar><a>-1</a></div><p>+12<p>+65<p><a>-6</a><p>+7 <a>1</a>
<body><div role=navigation><p>-14</div><div role=main><p>+5<p>+140<p><a>+3</a></div><div role=contentinfo>-25</div>
"""


def test_html_tree_on_held_out_pages():
    tree, right, n = html_blocks.train_tree(), 0, 0
    for page, main in html_blocks.labelled_pages(HELD_OUT):
        got = tree.predict(html_blocks.features(html_blocks.blocks(page))).tolist()
        assert len(got) == len(main)
        right, n = right + sum(a == b for a, b in zip(got, main, strict=True)), n + len(main)
    assert n >= 50 and right / n >= 0.95


def test_html_parsing():
    tree, long = html_blocks.train_tree(), " ".join(["word"] * 20)
    text = lambda page: html_blocks.main_text(page, tree)
    assert text(f"<body><h1>Title</h1><p>{long}</p><p>Short end.</p>") == f"Title {long} Short end."
    assert text("<body><p>A short paragraph here.</p></body>") == "A short paragraph here."
    kept = "<p title='the hidden cost'>One</p><p data-id='comments'>two</p><p data-role=navigation>three</p>"
    assert text(f"<article>{kept}</article>") == "One two three"
    for part in ("<div class=newsletter-signup-inline>Join us</div>", "<div class=recommended>Other</div>", "<div class=cookiebar>We</div>", "<label>Mail</label>", "<p>Advertisement</p>", "<p hidden>No</p>", "<div class=ad><span><p>No</p></span></div>"):
        assert text(f"<article><p>{long}</p>{part}</article>") == long
    assert text("<article><p>One<span class=ad>No</span> two <span class=share>No<p>three</article>") == "One two three"
    assert text("<p>&am<b>p;</b> &amp;lt;") == "&amp; &lt;"
    assert text("<ul><li><p>a<li>b</ul><table><tr><td>c<tr><td>d</table>") == "a b c d"
    # Open elements that no end tag meets aren't searched again for each tag.
    n = 100_000
    for page in ("<b>" * n + "x" + "</i>" * n, "<i><div>" + "<b>" * n + "x" + "</i>" * n, "<b>" * n + "x" + "<p>" * n):
        assert text(page) == "x"


def test_warc(spark):
    rows = [(1, "u", "a<b>é"), (2, "u2", "a<b>é"), (3, None, None), (4, "", ""), (5, "x", "only"), (5, "x", "only"), (6, "y", "q" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_warc(pages, roll=300)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).drop("payload", "url").collect())
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got[0] == (1, 6, d("a<b>é"), "revisit", 2) and got[1] == (2, 6, d("a<b>é"), "response", None)
    assert got[2] == (3, 0, d(""), "revisit", 4) and got[3][3] == "response"
    assert [g[3] for g in got[4:6]] == ["response", "revisit"] and got[5][4] == 5
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0
    sums = lambda p: sorted(tuple(r) for r in spark.read.parquet(p + "/manifest").collect())
    assert sums(path) == sums(warc.write_warc(pages, roll=300))


def test_warc_revisits_name_the_record_of_their_payload(spark):
    rows = [(1, "u", "B"), (5, "u", "A"), (5, "u", "B"), (5, "v", "B"), (7, "u", "A")]
    path = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    payload_of, revisits = {}, []
    for r in spark.read.parquet(path + "/manifest").collect():
        with open(f"{path.removeprefix('file:')}/{r.file}", "rb") as f:
            for h, block in warc.parse_records(iter([f.read()])):
                assert h["WARC-Record-ID"] not in payload_of
                if h["WARC-Type"] == "response":
                    payload_of[h["WARC-Record-ID"]] = block[-1:]
                elif h["WARC-Type"] == "revisit":
                    revisits.append((h["WARC-Refers-To"], h["WARC-Payload-Digest"]))
                    payload_of[h["WARC-Record-ID"]] = None
    assert len(revisits) == 3
    assert all("sha1:" + warc.payload_digest(payload_of[to]) == digest for to, digest in revisits)


def test_warc_shards_and_manifest(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    rng = random.Random(9)
    rows = [(rng.randrange(-(1 << 40), 1 << 40) if i % 50 else None, f"u{i}", _text(rng, rng.randrange(40))) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sums = lambda p: sorted(tuple(r) for r in spark.read.parquet(p + "/manifest").collect())
    path = warc.write_warc(pages.repartition(2), str(tmp_path / "a"))
    first = sums(path)
    assert len(first) >= 8 and max(r[1] for r in first) < 600 and sum(r[1] for r in first) == len(rows)
    assert first == sums(warc.write_warc(pages.repartition(7, "url"), str(tmp_path / "b")))
    assert sorted(f.name for f in (tmp_path / "a").iterdir()) == sorted(["manifest", *(r[0] for r in first)])
    assert warc.read_warc(spark, path).count() == len(rows)
    # An archive that lost its last record is no longer the manifest's.
    shard = tmp_path / "a" / first[0][0]
    data = shard.read_bytes()
    shard.write_bytes(data[: data.rindex(b"\x1f\x8b\x08")])
    with pytest.raises(Exception, match="is not the file of the manifest"):
        warc.read_warc(spark, path).count()


def test_mtree(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate((rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 80, 0)))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8)]
    got = mtree.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.floor(1024 * v).astype(np.int64)
    want = []
    for q in range(0, len(v), 100):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:10]
        want += [(q, n + 1, i, s[i]) for n, i in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_toxicity_and_language(spark):
    rng = random.Random(4)
    syllables = {"en": "th an er on in re".split(), "de": "sch ein ung lich tz".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        lang, bad = rng.choice(["en", "de"]), int(rng.random() < 0.2)
        ws = [word(lang) for _ in range(60)]
        if bad:
            for _ in range(5):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grobian", "nincompoop", "blockhead"]))
        rows.append((i, " ".join(ws), lang, "s", 1))
        labels.append((i, 1, bad))
    d = spark.createDataFrame([*rows, (9000, None, None, "s", 0), (9001, "", "en", "s", 0), (9002, "123 !!", "en", "s", 0)], DOCS)
    model = toxicity.fit_toxicity(d, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert sum((score[i] >= 0.3) == bool(b) for i, _, b in labels[400:]) >= 190
    assert score[9000] == score[9001] and 0 <= score[9000] < 0.3
    lm = language_id.fit_languages(d.where("doc_id < 400"))
    found = {r.doc_id: r for r in language_id.identify(d, lm).collect()}
    assert sum(found[i].lang_pred == r[2] for i, r in enumerate(rows)) >= 590
    assert {found[i].lang_pred for i in (9000, 9001, 9002)} == {"und"}


def test_pipeline_drops_what_the_operator_calls_toxic(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lexloom.llm import pipeline_stages

    docs = spark.createDataFrame([(i, x) for i, x in enumerate((0.1, 0.29, 0.3, 0.45, 0.5, 0.9))], "doc_id long, s double")
    monkeypatch.setattr(pipeline_stages, "fit_toxicity", lambda docs, labels: None)
    monkeypatch.setattr(pipeline_stages, "score_toxicity", lambda docs, model, keep, score: docs.withColumn(score, F.col("s")))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: None)
    assert [r.doc_id for r in pipeline_stages.drop_toxic(spark, docs, "").collect()] == [0, 1]


def test_language_of_long_texts_alone_is_learnt(spark):
    de, en = "und der die das nicht schön größer ".split(" "), "and the that which does not greater ".split(" ")
    rng = random.Random(4)
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(de, 6000) if i % 2 else some(en, 30), "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit_languages(docs), ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_ppm_is_a_distribution():
    m = language_id.fit_counts({"a": [b"abracadabra abracad"], "b": [b"the other one"]})
    assert np.allclose(np.exp(-m.bits.reshape(-1, m.symbols, 2)).sum(1), 1, atol=1e-3)


def test_mixing(docs, empty):
    import pandas as pd

    cells = pd.DataFrame({"source": ["a", "a", "b", "b"], "lang": ["x", "y", "x", "y"], "tokens": [10.0, 30.0, 40.0, 20.0]})
    w = mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}})
    t = w * cells["tokens"]
    assert abs(t[:2].sum() / t.sum() - 0.5) < 1e-6 and abs(t[[0, 2]].sum() / t.sum() - 0.3) < 1e-6
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.probability == 0 for r in got if not (r.text or "").strip())
    assert mixing.mix(empty).count() == 0


def _sources(spark):
    """Documents of 9 sources, their sizes far apart, with more cells than some limits below."""
    rng = random.Random(8)
    rows = [(100 * s + i, _text(rng, 3 + s), "en" if i % (s + 2) else "de", f"s{s}", 1) for s in range(9) for i in range(2 + 3 * s)]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_tail_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    got = mixing.mix(_sources(spark)).collect()
    assert all(r.probability > 0 for r in got) and len({r.source for r in got}) == 9


def test_mixing_as_tables(spark, monkeypatch):
    docs = _sources(spark)
    given = {"source": {"s0": 0.5, "s8": 0.2, "s3": 0.3, "none": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"none": 1.0}}
    whole = mixing.mix(docs, keep=0.9).collect()
    assert abs(sum(r.probability * r.n_tokens for r in whole) / sum(r.n_tokens for r in whole) - 0.9) < 1e-6
    assert max(r.probability for r in whole) == 1
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    for targets, keep in ((None, 0.9), (given, 0.3)):
        rows = []
        for limit in (200_000, 3):
            monkeypatch.setattr(mixing, "DRIVER_CELLS", limit)
            rows.append(sorted((r.doc_id, r.weight, r.probability, r.sampled, r.n_tokens) for r in mixing.mix(docs, targets, keep=keep).collect()))
        assert len(rows[0]) == len(rows[1]) and np.allclose(np.array(rows[0], float), np.array(rows[1], float), rtol=1e-6, atol=1e-9)


def test_mixing_meets_what_the_tokens_allow():
    """Sampled margins: targets that are attainable are met, a value that asks for too much is taken whole."""
    import pandas as pd

    rng = np.random.default_rng(6)
    cells = pd.DataFrame([(s, lang, rng.integers(50, 150) * (1 if s else 20)) for s in range(4) for lang in "xyz"], columns=["source", "lang", "tokens"])
    total, keep = cells["tokens"].sum(), 0.6
    targets = {"source": {0: 0.5, 1: 0.2, 2: 0.2, 3: 0.1}, "lang": {"x": 0.45, "y": 0.3, "z": 0.25}}
    kept = mixing.rake(cells, targets, keep) * keep * cells["tokens"]
    assert abs(kept.sum() / total - keep) < 1e-4 and (kept <= cells["tokens"] * (1 + 1e-9)).all()
    have = cells.groupby("source")["tokens"].sum()
    assert all(abs(kept[cells["source"] == s].sum() - have[s]) < 1e-3 * have[s] for s in (1, 2, 3))
    assert all(abs(kept[cells["lang"] == v].sum() / kept.sum() - t) < 0.01 for v, t in targets["lang"].items())


IMAGES = "image_id long, width int, height int, pixels binary"


def _image(i, a):
    return i, a.shape[1], a.shape[0], bytearray(np.ascontiguousarray(a).tobytes())


def test_image_copies(spark):
    drawn = [image_copies.render(i * 77 + 5) for i in range(12)]
    rows = [_image(i, a) for i, a in enumerate(drawn)]
    rows += [_image(100, image_copies.edited(drawn[0], 0, 5)), (101, 64, 64, None), (102, 64, 64, bytearray(64 * 64)), (103, 64, 64, rows[3][3]), (104, 5, 64, rows[3][3]), (None, 64, 64, rows[4][3])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], IMAGES + ", content string")
    got = image_copies.image_copies(frame).collect()
    of = {r.image_id: r.component_id for r in got}
    assert len(got) == len(rows) and of[100] == 0 and of[103] == 3 and of[101] == 101 and of[102] == 102 and of[104] == 104 and of[7] == 7 and of[None] == 4
    assert {r.image_id: r.n_links for r in got}[0] == 1
    assert image_copies.image_copies(frame.limit(0)).count() == 0


def _half(a):
    return np.rint((a[::2, ::2].astype(float) + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4).astype(np.uint8)


def test_image_copies_by_kind_of_edit(spark):
    """Recall of each kind of edit, and that unlike images stay apart."""
    n = 40
    drawn = [image_copies.render(i * 991 + 5, 96) for i in range(n)]
    noise = lambda a, i: np.clip(a.astype(int) + np.random.default_rng(i).integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    kinds = [noise, lambda a, i: a[20:, 12:84], lambda a, i: np.rot90(a), lambda a, i: _half(a), lambda a, i: (a // 2 + 50).astype(np.uint8)]
    rows = [_image(i, a) for i, a in enumerate(drawn)] + [_image(1000 * (k + 1) + i, f(a, i)) for k, f in enumerate(kinds) for i, a in enumerate(drawn)]
    got = {r.image_id: r.component_id for r in image_copies.image_copies(spark.createDataFrame(rows, IMAGES)).collect()}
    for k in range(len(kinds)):
        assert sum(got[1000 * (k + 1) + i] == got[i] for i in range(n)) >= 0.95 * n
    assert len({got[i] for i in range(n)}) == n


def _image_links(images):
    """How many other images each image links with, by brute force over all pairs."""
    found = [image_copies.describe(np.frombuffer(bytes(px), np.uint8).reshape(1, h, w))[0] for _, w, h, px in images]
    keys = [set(np.unique(image_copies._pieces(d)).tolist()) for d in found]
    out = [0] * len(images)
    for i in range(len(images)):
        for j in range(i):
            if len(keys[i] & keys[j]) >= image_copies.MIN_SHARED and image_copies.placements(found[i], found[j]) >= image_copies.MIN_VOTES:
                out[i], out[j] = out[i] + 1, out[j] + 1
    return out


def test_image_copies_meet_in_pairs(spark, monkeypatch):
    rows = []
    for i in range(20):
        a = image_copies.render(i * 31 + 9)
        rows.append(_image(len(rows), a))
        rows += [_image(len(rows) + k, a[step:, step:] + step) for k, step in enumerate((2, 4, 6) if i < 4 else ())]
    want = _image_links(rows)
    assert sorted(want)[-4] >= 3  # groups whose members are all compared
    images = spark.createDataFrame(rows, IMAGES)
    for common in (64, 1):
        monkeypatch.setattr(image_copies, "COMMON", common)
        assert [r.n_links for r in image_copies.image_copies(images).orderBy("image_id").collect()] == want


def test_image_copies_that_share_no_piece(spark, monkeypatch):
    """Links whose matches all differ in both halves of their bits, and those between groups, in tiles of any size."""
    rng = np.random.default_rng(3)
    drawn = [image_copies.render(i * 53 + 1) for i in range(60)]
    rows = [_image(i, a) for i, a in enumerate(drawn)]
    rows += [_image(100 + i, np.clip(a.astype(int) + rng.integers(-14, 15, a.shape), 0, 255).astype(np.uint8)) for i, a in enumerate(drawn)]
    found = [image_copies.describe(np.frombuffer(bytes(px), np.uint8).reshape(1, h, w))[0] for _, w, h, px in rows]
    keys = [set(image_copies._pieces(d).ravel().tolist()) for d in found]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if image_copies.placements(found[i], found[j]) >= image_copies.MIN_VOTES]
    assert any(len(keys[i] & keys[j]) < image_copies.MIN_SHARED for i, j in links)
    want = [sum(i in x for x in links) for i in range(len(rows))]
    images = spark.createDataFrame(rows, IMAGES)
    for group, tile in ((128, 8192), (20, 100)):
        monkeypatch.setattr(image_copies, "GROUP_CONTENTS", group)
        monkeypatch.setattr(image_copies, "TILE_HELD", tile)
        assert [r.n_links for r in image_copies.image_copies(images).orderBy("image_id").collect()] == want


def test_image_groups_are_not_dealt_out(spark, monkeypatch):
    """Contents travel once, to be told apart; the comparison of all reads the groups where they are written."""
    plans = {}

    def watched(df, name, *args, **kw):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, *args, **kw)

    written = image_copies.written
    monkeypatch.setattr(image_copies, "written", watched)
    monkeypatch.setattr(image_copies, "GROUP_CONTENTS", 4)
    drawn = [image_copies.render(i * 77 + 5) for i in range(9)]
    rows = [_image(i, a) for i, a in enumerate(drawn)] + [_image(100 + i, image_copies.edited(a, 0, 5)) for i, a in enumerate(drawn)]
    got = {r.image_id: r.component_id for r in image_copies.image_copies(spark.createDataFrame(rows, IMAGES)).collect()}
    assert got == {i: i % 100 for i in got} and len(got) == 18
    assert "Exchange" not in plans["image-links"]


def test_bpe_texts_come_in_small_batches(spark, monkeypatch):
    """Neither Spark nor a Python step holds more whole texts at once than TEXTS_AT_ONCE."""
    import public_tokenizers

    taken, at_once = [], []

    def watched(df, name, batch_rows=None, **kw):
        taken.append((name, batch_rows))
        with bpe.small_batches(spark, batch_rows):
            at_once.append(max(r.n for r in df.sparkSession.range(100, numPartitions=1).mapInArrow(_batch_sizes, "n long").collect()))
        return written(df, name, batch_rows, **kw)

    written = bpe.written
    monkeypatch.setattr(bpe, "written", watched)
    monkeypatch.setattr(bpe, "TEXTS_AT_ONCE", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"word{i} of the text {'ab' * i}") for i in range(60)], "doc_id long, text string")
    got = bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)).orderBy("doc_id").collect()
    assert [r.decoded_sha256 for r in got] == [bpe.sha256(r.text.encode()) for r in docs.orderBy("doc_id").collect()]
    assert taken == [("token-digests", 7)] and at_once == [7]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def _batch_sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])
