"""The queries op1 to op13 and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import functions as F


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(mod):
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op1_toxicity(spark, sf_dir):
    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").where(_remainder(4) != 2))
    return score_toxicity(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_top_k(spark, sf_dir):
    from .mtree import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op3_image_copies(spark, sf_dir):
    from .image_copies import image_copies, page_images

    return image_copies(page_images(_table(spark, sf_dir, "pages")))


def op4_warc(spark, sf_dir):
    from .warc import read_warc, write_warc

    path = write_warc(_table(spark, sf_dir, "pages"))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import digests, encode

    return digests(encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op6_source_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "mix_topic", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op7_language_id(spark, sf_dir):
    from .language_id import fit_languages, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(_remainder(3) != 1).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark, sf_dir):
    from .html_blocks import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark, sf_dir):
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op11_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import removal_digests

    return removal_digests(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    from .fill_in_middle import fim_digests

    return fim_digests(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark, sf_dir):
    from .ranked_search import ranked_search

    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def license_places(spark, sf_dir):
    """The base columns of op10, which SQL can express."""
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {n: f for n, f in globals().items() if (n.startswith("op") and callable(f)) or n in ("license_places", "pipeline")}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.least_id, n.doc_id)) AS component_id
FROM n LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) m ON m.a = n.doc_id""",
    "license_places": f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['under', 'the', 'mit', 'license']) AS mit,
  list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['apache', 'license', 'version', '2']) AS apache,
  list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['cc', 'by', 'nc']) AS cc FROM w)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(cc) AS BIGINT) AS n_base,
  CAST(list_min(mit || apache || cc) - 1 AS BIGINT) AS first_word, CAST(list_max(mit || apache || cc) - 1 AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM h""",
    "op11_suffix_dedup": """
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS bytes, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, bytes FROM b WHERE n >= 50),
c AS (SELECT doc_id, i, bytes[i + 1:i + 50] AS s FROM w),
f AS (SELECT s, min(doc_id) AS first_doc FROM c GROUP BY s),
r AS (SELECT DISTINCT doc_id, i FROM c JOIN f USING (s) WHERE first_doc < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM r),
k AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM k GROUP BY ALL),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
t AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last FROM s GROUP BY doc_id),
x AS (SELECT e.doc_id, string_agg(hex(b.bytes[before + 1:lo]), '' ORDER BY lo) AS kept FROM e JOIN b USING (doc_id) GROUP BY e.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b.bytes[coalesce(last, 0) + 1:n]))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * CAST(len(t) AS BIGINT) * n_docs) // n_terms AS m FROM d, c WHERE n_terms > 0),
s AS (SELECT item_id, m.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}


def oracle_sql():
    return dict(SQL)
