"""Operators that keep, merge, choose and rank, and the corpus operators as a whole, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import inventory, validate
from ..operators.choice import choose_texts
from ..operators.compare import multiset_difference
from ..operators.lookup import TermIndex, case_briefs, commentary
from ..operators.state import budget_reached, replay, summary, total_cost
from ..sinks.files import new_folder
from ..sinks.snapshots import layer_store, write_layers
from ..sinks.yaml_files import write_records
from ..sources.article_source import parse_answers
from ..sources.content import ARTICLE, scan_records
from ..streaming.state import EVENTS, follow, state_table
from . import prompts, publish
from .driver_queries import query
from .regenerate import regenerate
from .stages import Pipeline, Stage


@query("""WITH c AS (SELECT doc_id, coalesce(lang, '') AS law, 'summary' AS layer, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 3 = 0 THEN coalesce(source, '') ELSE coalesce(text, '') END AS content FROM documents
UNION ALL SELECT doc_id, coalesce(lang, ''), 'doctrine', coalesce(lang, '') FROM documents WHERE doc_id % 5 = 0)
SELECT law, doc_id AS article, layer, CAST(length(content) AS BIGINT) AS chars, md5(content) AS digest FROM c""")
def layer_overwrite(t, spark):
    """Whole layers, then some overwritten twice over."""
    store = layer_store(spark, new_folder(spark, "layer-store"), buckets=16)
    d = t("documents").select(F.lower(F.coalesce("lang", F.lit(""))).alias("law"), F.col("doc_id").cast("int").alias("article"), F.lit("").alias("suffix"), "text", "source")
    row = lambda df, layer, content, seq: df.select("law", "article", "suffix", F.lit(layer).alias("layer"), F.coalesce(content, F.lit("")).alias("content"), F.lit(seq).alias("seq"))
    write_layers(store, row(d, "summary", F.col("text"), 1), "seq")
    third = d.where("article % 3 = 0")
    changes = row(third, "summary", F.col("source"), 1).unionAll(row(d.where("article % 6 = 0"), "summary", F.lit(""), 2)).unionAll(row(d.where("article % 5 = 0"), "doctrine", F.col("law"), 1))
    for _ in range(2):  # a replay changes nothing
        write_layers(store, changes, "seq")
    return store.read().select("law", F.col("article").cast("long").alias("article"), "layer", F.char_length("content").cast("long").alias("chars"), F.md5(F.col("content")).alias("digest"))


@query("SELECT doc_id AS article, split_part(text, chr(10), 1) AS title, CAST(n_chars AS BIGINT) AS paragraphs, CASE WHEN doc_id % 4 = 0 THEN '2026-01-01' END AS generated, CASE WHEN doc_id % 4 = 0 THEN 3 END AS version FROM documents WHERE text IS NOT NULL AND doc_id > 0")
def yaml_round_trip(t, spark):
    """Records written as YAML files and scanned again."""
    root = new_folder(spark, "yaml-tree")
    d = t("documents").where("text IS NOT NULL AND doc_id > 0")
    layer = "named_struct('last_generated', '2026-01-01', 'version', 3, 'quality_score', CAST(NULL AS DOUBLE), 'trigger', CAST(NULL AS STRING), 'last_reviewed', CAST(NULL AS STRING), 'total_decisions', CAST(NULL AS INT), 'new_decisions_count', CAST(NULL AS INT))"
    layers = F.expr(f"CASE WHEN doc_id % 4 = 0 THEN map('summary', {layer}) ELSE CAST(map() AS MAP<STRING, STRUCT<last_generated: STRING, version: INT, quality_score: DOUBLE, trigger: STRING, last_reviewed: STRING, total_decisions: INT, new_decisions_count: INT>>) END")
    record = F.struct(F.lit("OR").alias("law"), F.col("doc_id").cast("int").alias("article"), F.lit("").alias("article_suffix"), F.substring_index("text", "\n", 1).alias("title"), F.lit("220").alias("sr_number"), F.col("n_chars").cast("int").alias("absatz_count"), F.lit("").alias("fedlex_url"), F.lit(None).cast("int").alias("lexfind_id"), F.lit("").alias("lexfind_url"), F.lit("").alias("in_force_since"), layers.alias("layers"))
    write_records(d.select(F.lit("or").alias("law_dir"), T.dir_name(F.col("doc_id"), F.lit("")).alias("art_dir"), record.alias("record")), root)
    r = scan_records(spark, root, schema=ARTICLE).select("record.*")
    made = F.col("layers")["summary"]
    return r.select(F.col("article").cast("long").alias("article"), "title", F.col("absatz_count").cast("long").alias("paragraphs"), made["last_generated"].alias("generated"), made["version"].alias("version"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, CAST(sum(len(w)) // count(*) AS BIGINT) AS mean FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * log2(n::DOUBLE / count(*) + 1)) AS BIGINT) AS w FROM p, n GROUP BY term, n),
s AS (SELECT item_id, doc_id, CAST(sum(w * CAST(floor(1000 * tf / (tf + 1 + length / greatest(mean, 1)::DOUBLE)) AS BIGINT)) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def ranked_lookup(t, spark):
    """The ten best documents for each benchmark item, by a term index made for it."""
    index = TermIndex.build(t("documents").select("doc_id", "text"), new_folder(spark, "term-index"), "doc_id")
    return index.search(t("benchmark"), 10, "item_id", "text").withColumnRenamed("key", "doc_id")


@query("""SELECT c.conv_id, c.turn, coalesce(d.source, 'no brief of ''' || k || '''') AS content, d.source IS NULL AS is_error FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(conv_id AS VARCHAR) WHEN turn % 3 = 1 THEN CAST(conv_id + turn AS VARCHAR) ELSE '' END AS k FROM conversations) c
LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS k2, source FROM documents WHERE doc_id % 2 = 0) d ON d.k2 = c.k""")
def brief_look_up(t, spark):
    """A case, else a decision, else nothing, looked up for each turn."""
    c = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("conv_id").cast("string")).alias("case"), F.when(F.col("turn") % 3 < 2, (F.col("conv_id") + F.col("turn")).cast("string")).alias("decision_id"))
    briefs = t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("text"))
    return case_briefs(c, briefs).select("conv_id", "turn", "content", "is_error")


@query("""WITH r AS (SELECT item_id, (SELECT lang FROM documents d WHERE d.doc_id = item_id) AS law, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) END AS wanted FROM benchmark),
m AS (SELECT r.item_id, string_agg(d.source, chr(10) || chr(10) ORDER BY d.doc_id, d.source) AS content FROM r JOIN documents d ON lower(d.lang) = lower(r.law) AND (r.wanted IS NULL OR r.wanted = CAST(d.doc_id AS VARCHAR)) WHERE d.source IS NOT NULL GROUP BY r.item_id)
SELECT r.item_id AS request_id, md5(coalesce(content, 'no commentary on ' || coalesce(law, ''))) AS digest, content IS NULL AS is_error FROM r LEFT JOIN m USING (item_id)""")
def commentary_look_up(t, spark):
    """The commentary on a law, or on one of its articles, for each benchmark item."""
    d = t("documents").select("doc_id", F.col("lang").alias("abbreviation"), F.col("doc_id").cast("string").alias("article"), F.col("source").alias("text"))
    asked = t("benchmark").select(F.col("item_id").alias("request_id")).join(d.select(F.col("doc_id").alias("request_id"), "abbreviation"), "request_id", "left")
    asked = asked.withColumn("article", F.when(F.col("request_id") % 2 == 0, F.col("request_id").cast("string")))
    return commentary(asked, d).select("request_id", F.md5("content").alias("digest"), "is_error")


@query("""WITH d AS (SELECT doc_id, coalesce(lang, '') AS law, CAST(doc_id % 500 AS VARCHAR) AS article, CASE doc_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'it' ELSE 'en' END AS lang, source || '-' || CAST(doc_id AS VARCHAR) AS text, doc_id % 3 = 0 AS original, doc_id % 7 <> 0 AS federal FROM documents),
s AS (SELECT law, article, lang, CAST(federal AS INTEGER) AS source, original, min(text) AS text FROM d WHERE text IS NOT NULL GROUP BY ALL),
asked AS (SELECT DISTINCT d.law, d.article, l.lang FROM d, (VALUES ('de'), ('en')) l(lang)),
a AS (SELECT law, article, lang, arg_min({'t': text, 's': source}, {'s': source, 't': text}) AS x FROM s GROUP BY ALL),
o AS (SELECT law, article, arg_min({'t': text, 's': source, 'l': lang}, {'s': source, 't': text, 'l': lang}) AS x FROM s WHERE original GROUP BY ALL)
SELECT q.law, q.article, q.lang, coalesce(a.x.t, o.x.t) AS text, CASE WHEN a.x.t IS NOT NULL THEN q.lang ELSE o.x.l END AS text_lang, coalesce(a.x.s, o.x.s) AS source, a.x.t IS NULL AND o.x.t IS NOT NULL AND o.x.l <> q.lang AS fallback
FROM asked q LEFT JOIN a ON (q.law, q.article, q.lang) = (a.law, a.article, a.lang) LEFT JOIN o ON (q.law, q.article) = (o.law, o.article)""")
def chosen_texts(t, spark):
    """German and English readers' texts from a cantonal and a federal source, in one shuffle."""
    lang = F.when(F.col("doc_id") % 4 == 0, "de").when(F.col("doc_id") % 4 == 1, "fr").when(F.col("doc_id") % 4 == 2, "it").otherwise("en")
    d = t("documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("law"), (F.col("doc_id") % 500).cast("string").alias("article"), lang.alias("lang"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("text"), (F.col("doc_id") % 3 == 0).alias("original"))
    asked = d.select("law", "article", F.explode(F.array(F.lit("de"), F.lit("en"))).alias("lang"))
    return choose_texts(asked, d.where("doc_id % 7 = 0").drop("doc_id"), d.where("doc_id % 7 <> 0").drop("doc_id"))


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) > 0 AS kept, text FROM documents WHERE n_chars > 500), c AS (SELECT doc_id FROM k WHERE doc_id % 2 = 0)
SELECT 'select' AS stage, (SELECT count(*) FROM k) AS n_rows, 'done' AS first_run, 'kept' AS second_run UNION ALL SELECT 'split', (SELECT count(*) FROM c), 'done', 'skipped' UNION ALL SELECT 'digest', NULL, 'noted', 'noted'""")
def stage_runs(t, spark):
    """Two runs of three stages, the second with one skipped: what became of each."""
    stages = [
        Stage("select", lambda _, p: t("documents").where("n_chars > 500").select("doc_id", "text")),
        Stage("split", lambda made, p: made["select"].where("doc_id % 2 = 0").select("doc_id"), ("select",)),
        Stage("digest", lambda made, p: made["split"], ("split",), requires="law"),
    ]
    pipeline = Pipeline(spark, new_folder(spark, "stages"), stages)
    first, second = pipeline.run("documents"), pipeline.run("documents", skip=("split",))
    rows = [(a.stage, a.metrics.get("rows"), a.status, b.status) for a, b in zip(first, second, strict=True)]
    return spark.createDataFrame(rows, "stage string, n_rows long, first_run string, second_run string")


@query("""WITH a AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT lang, source, count(*) AS n FROM (SELECT lang, source FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT lang, source FROM documents WHERE doc_id % 7 = 0) GROUP BY ALL)
SELECT * FROM (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS n FROM a FULL JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source) WHERE n <> 0""")
def set_difference(t, spark):
    """What two tables with repeated rows do not share."""
    d = t("documents").select("lang", "source", "doc_id")
    other = d.where("doc_id % 10 <> 0").unionAll(d.where("doc_id % 7 = 0"))
    return multiset_difference(d.drop("doc_id"), other.drop("doc_id"))


@query("SELECT event_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cost, sum(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) > 500000 AS exceeded FROM events")
def budget_guard(t, spark):
    """One budget for all events."""
    e = t("events").select("event_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "completed").otherwise("add").alias("event"), F.floor(F.col("value") * 100).cast("long").alias("cost"))
    return budget_reached(e, 500000).select("event_id", "running_cost", "exceeded")


def _log(t) -> DataFrame:
    """events as a log of articles: the first of a user adds, later ones complete or fail by their number."""
    first = F.col("event_id") % 5 < 2
    kind = F.when(first, "add").when(F.col("event_id") % 5 < 4, "completed").otherwise("failed")
    return t("events").select(F.col("event_id").cast("long").alias("seq"), F.lit("OR").alias("law"), F.col("user_id").cast("int").alias("article_number"), F.lit("").alias("article_suffix"), kind.alias("event"), F.when(kind == "completed", F.floor(F.col("value") * 100).cast("double")).alias("cost"), F.when(kind == "failed", F.col("event_type")).alias("error"))


_LOG = """WITH l AS (SELECT event_id AS seq, user_id, CASE WHEN event_id % 5 < 2 THEN 'add' WHEN event_id % 5 < 4 THEN 'completed' ELSE 'failed' END AS event, floor(value * 100) AS cost, event_type AS error FROM events),
a AS (SELECT user_id, min(seq) AS added FROM l WHERE event = 'add' GROUP BY user_id), e AS (SELECT l.* FROM l JOIN a USING (user_id) WHERE event <> 'add' AND seq > added),
s AS (SELECT a.user_id, coalesce(arg_max(event, seq), 'pending') AS status, CAST(coalesce(arg_max(cost, seq) FILTER (event = 'completed'), 0) AS DOUBLE) AS cost_usd, coalesce(arg_max(error, seq) FILTER (event = 'failed'), '') AS error, CAST(coalesce(sum(cost) FILTER (event = 'completed'), 0) AS DOUBLE) AS total_cost FROM a LEFT JOIN e USING (user_id) GROUP BY a.user_id)"""


@query(_LOG + " SELECT CAST(user_id AS BIGINT) AS article, status, cost_usd, error FROM s")
def state_replay(t, spark):
    """The state of each article from the whole log."""
    return replay(_log(t)).select(F.col("article_number").cast("long").alias("article"), "status", "cost_usd", "error")


@query(_LOG + " SELECT CAST(sum(total_cost) AS DOUBLE) AS total_cost FROM s")
def state_total(t, spark):
    """What all completions of added articles cost."""
    return total_cost(_log(t))


@query(_LOG + " SELECT CAST(user_id AS BIGINT) AS article, status, cost_usd, error, total_cost FROM s")
def state_stream(t, spark):
    """The same log as a stream that stops and goes on, saved in a table."""
    folder = new_folder(spark, "state-stream")
    table = state_table(spark, f"{folder}/table")
    log = _log(t)
    cut = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for part in (log.where(F.col("seq") <= cut), log.where(F.col("seq") > cut)):
        part.select(*[c.split()[0] for c in EVENTS.split(", ")]).repartition("article_number").write.mode("append").parquet(f"{folder}/events")
        follow(spark, f"{folder}/events", table, f"{folder}/checkpoint")
    return table.read().select(F.col("article_number").cast("long").alias("article"), "status", "cost_usd", "error", "total_cost")


@query("""WITH p AS (SELECT l.pos, l.lang, s.part, s.n, s.art_dir, s.path FROM (VALUES (0, 'de'), (1, 'fr'), (2, 'it'), (3, 'en')) l(pos, lang), (SELECT 0 AS part, i AS n, '' AS art_dir, path FROM (VALUES (0, '/'), (1, '/about'), (2, '/methodology'), (3, '/changelog')) x(i, path) UNION ALL SELECT 1, i, '', '/' || law FROM (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es')) y(i, law)
UNION ALL SELECT 1, i, 'art-' || CASE WHEN doc_id < 1000 THEN right('00' || CAST(doc_id AS VARCHAR), 3) ELSE CAST(doc_id AS VARCHAR) END, '/' || law || '/art-' || CAST(doc_id AS VARCHAR) FROM documents JOIN (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es')) z(i, law) ON law = lang) s)
SELECT row_number() OVER (ORDER BY pos, part, n, art_dir) - 1 AS number, CAST((row_number() OVER (ORDER BY pos, part, n, art_dir) - 1) // 500 AS BIGINT) AS file, 'https://example.org/' || lang || path AS url FROM p""")
def sitemap_files(t, spark):
    """The number and file of each URL of the sitemap, 500 a file."""
    dirs = t("documents").where("lang IS NOT NULL").select(F.col("lang").alias("law_dir"), T.dir_name(F.col("doc_id"), F.lit("")).alias("art_dir"))
    urls = publish.sitemap_urls(dirs, laws=("en", "fr", "de", "es"))
    rows = publish.numbered(urls, ["lang_pos", "part", "n", "art_dir"], new_folder(spark, "sitemap"))
    return rows.select(F.col("number").cast("long").alias("number"), F.floor(F.col("number") / 500).alias("file"), "url")


@query("SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 2 ELSE 3 END AS INTEGER) AS round, NOT (quality = 0 AND toxic = 1) AS passed, CASE WHEN quality = 0 AND toxic = 1 THEN 'again again again ' END AS feedback FROM labels")
def feedback_rounds(t, spark):
    """Three rounds: good documents pass at once, clean ones with feedback, the others never."""
    said = F.concat(F.coalesce("feedback", F.lit("")), F.lit("again "))
    passed = (F.col("quality") == 1) | (F.col("feedback").isNotNull() & (F.col("toxic") == 0))
    judge = lambda df: df.withColumns({"passed": passed, "feedback": F.when(~passed, said)})
    made = regenerate(spark, t("labels").select("doc_id", "quality", "toxic"), lambda df: df, judge, new_folder(spark, "rounds"))
    return made.select("doc_id", "round", "passed", "feedback")


@query("""WITH d AS (SELECT doc_id, lang, 'art-' || CASE WHEN doc_id < 1000 THEN right('00' || CAST(doc_id AS VARCHAR), 3) ELSE CAST(doc_id AS VARCHAR) END AS dir FROM documents WHERE lang IS NOT NULL), x AS (SELECT d.doc_id, lang, dir, l.quality, l.toxic FROM d LEFT JOIN labels l USING (doc_id))
SELECT lang AS law_dir, dir AS art_dir, 0 AS ordinal, lang || '/' || dir || ': missing meta.yaml' AS error FROM x WHERE quality IS NULL
UNION ALL SELECT lang, dir, 1, lang || '/' || dir || ': invalid meta.yaml — toxic' FROM x WHERE toxic = 1
UNION ALL SELECT lang, dir, 2, lang || '/' || dir || ': missing ' || f FROM x, (VALUES ('summary.md'), ('doctrine.md'), ('caselaw.md')) y(f) WHERE toxic = 0 AND NOT (f = 'summary.md' AND doc_id % 3 > 0) AND NOT (f = 'doctrine.md' AND doc_id % 5 > 0)
UNION ALL SELECT lang, dir, 3, lang || '/' || dir || ': meta declares ''doctrine'' but doctrine.md missing' FROM x WHERE toxic = 0 AND quality = 1 AND doc_id % 5 = 0""")
def tree_errors(t, spark):
    """Every error of a content tree."""
    d = t("documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("law_dir"), T.dir_name(F.col("doc_id"), F.lit("")).alias("art_dir"))
    file = F.explode(F.array_compact(F.array(F.when(F.col("doc_id") % 3 > 0, "summary.md"), F.when(F.col("doc_id") % 5 > 0, "doctrine.md"))))
    layers = F.when(F.col("quality") == 1, F.create_map(F.lit("doctrine"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>"))
    metas = d.join(t("labels"), "doc_id").select("law_dir", "art_dir", F.upper("law_dir").alias("law"), layers.alias("layers"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    return validate.tree_errors(d.drop("doc_id"), d.select("law_dir", "art_dir", file.alias("file")), metas)


@query("""WITH a AS (SELECT l_partkey AS article, l_orderkey AS pos, l_linenumber AS n FROM lineitem), f AS (SELECT article % 50 AS law, article AS number FROM a GROUP BY ALL)
SELECT 'L' || CAST(law AS VARCHAR) AS law, CAST(number AS INTEGER) AS number, CAST(number AS VARCHAR) AS raw, (SELECT CASE WHEN arg_min(pos, pos * 10 + n) % 2 = 0 THEN 'Titel ' || CAST(arg_min(pos, pos * 10 + n) AS VARCHAR) END FROM a WHERE a.article = f.number) AS title FROM f""")
def article_lists(t, spark):
    """Article lists parsed from answers of many lines: the first line of each article counts."""
    i = t("lineitem").select((F.col("l_partkey") % 50).alias("law"), "l_orderkey", "l_linenumber", F.concat(F.lit("- Art. "), F.col("l_partkey").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(" Titel "), F.col("l_orderkey").cast("string"))).otherwise("")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))), lambda x: x["line"]), "\n")
    answers = i.groupBy(F.concat(F.lit("L"), F.col("law").cast("string")).alias("law")).agg(F.concat(F.lit("Header\n- Art. 1 – 3 Bereich\n"), text).alias("text"))
    return inventory.parse_article_lists(answers).select("law", "number", "raw", "title")


@query("""WITH l AS (SELECT l.doc_id, x.layer, x.version, CASE WHEN l.doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(l.doc_id % 400 AS INTEGER), '%Y-%m-%d') END AS date, upper(d.lang) AS law
FROM (SELECT doc_id, 'summary' AS layer, quality AS version FROM labels UNION ALL SELECT doc_id, 'caselaw', toxic FROM labels) x JOIN labels l USING (doc_id) JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'fr', 'de', 'es')),
n AS (SELECT *, CASE layer WHEN 'summary' THEN 'Overview' ELSE 'Case Law' END AS name, 'Art. ' || CAST(doc_id AS VARCHAR) || ' ' || law AS display, greatest(version, 1) AS v FROM l WHERE date <> '')
SELECT date, law, doc_id AS article, layer, display || ' — ' || display || ' (' || name || ' v' || CAST(v AS VARCHAR) || ')' AS item_title, 'https://example.org/de/' || lower(law) || '/art-' || CAST(doc_id AS VARCHAR) AS link, 'https://example.org/de/' || lower(law) || '/art-' || CAST(doc_id AS VARCHAR) || '#' || layer || '-v' || CAST(v AS VARCHAR) AS guid,
strftime(CAST(date AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S GMT') AS pub_date, name || ' layer updated for ' || display AS description FROM n ORDER BY date DESC, law, doc_id, layer LIMIT 100""")
def feed_layers(t, spark):
    """The feed's items of the newest layers of labelled documents."""
    day = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd"))
    made = lambda v: F.struct(day.alias("last_generated"), F.col(v).cast("int").alias("version"))
    layers = F.create_map(F.lit("summary"), made("quality"), F.lit("caselaw"), made("toxic"))
    record = F.struct(F.lit(None).cast("string").alias("law"), F.col("doc_id").alias("article"), F.lit(None).cast("string").alias("article_suffix"), F.lit("").alias("title"), layers.alias("layers"))
    articles = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").select(F.col("lang").alias("law_dir"), record.alias("record"))
    return publish.feed_items(publish.feed_entries(articles, laws=("en", "fr", "de", "es"))).drop("suffix")


@query("WITH e AS (SELECT d.doc_id, l.quality, f FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES (0), (1), (2)) x(f) WHERE d.lang IS NOT NULL) SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS total_articles, CAST(count(*) FILTER (CASE WHEN quality IS NULL THEN f = 0 ELSE f = 0 OR f = 2 AND doc_id % 2 = 0 OR f = 1 END) AS BIGINT) AS errors, false AS valid FROM e")
def tree_report(t, spark):
    """The number of articles and errors of a content tree."""
    d = t("documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("law_dir"), T.dir_name(F.col("doc_id"), F.lit("")).alias("art_dir"))
    none = F.array().cast("array<string>")
    metas = d.join(t("labels"), "doc_id").select("law_dir", "art_dir", F.upper("law_dir").alias("law"), F.create_map().cast("map<string,int>").alias("layers"), none.alias("problems"))
    files = d.where("doc_id % 2 = 1").select("law_dir", "art_dir", F.lit("summary.md").alias("file"))
    return validate.tree_report(d, validate.tree_errors(d.drop("doc_id"), files, metas))


@query("""SELECT coalesce(lang, '') AS law, doc_id AS number, f || '.md' AS file, '# ' || h || chr(10) || chr(10) || 'Art. ' || CAST(doc_id AS VARCHAR) || ' ' || coalesce(lang, '') || ' — ' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Art. ' || CAST(doc_id AS VARCHAR) || ' ' || coalesce(lang, '') END || chr(10) AS text
FROM documents, (VALUES ('summary', 'Übersicht', 3), ('doctrine', 'Doktrin', 5), ('caselaw', 'Rechtsprechung', 7)) x(f, h, m) WHERE doc_id % m > 0""")
def scaffold_files(t, spark):
    """The placeholder files that a scaffold adds to what is there."""
    d = t("documents").select(F.coalesce("lang", F.lit("")).alias("law"), F.col("doc_id").alias("number"), F.lit("").alias("suffix"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("title"))
    there = F.explode(F.array_compact(F.array(*[F.when(F.col("number") % m == 0, f"{f}.md") for f, m in (("summary", 3), ("doctrine", 5), ("caselaw", 7))])))
    _, _, bodies = inventory.scaffold(d, d.limit(0), d.select("law", "number", "suffix", there.alias("file")))
    return bodies.select("law", "number", "file", "text")


@query("SELECT p_brand AS law, arg_max(p_name, p_partkey) FILTER (p_partkey % 3 = 0) AS in_force_since, arg_max(p_name, p_partkey) FILTER (p_partkey % 3 = 1) AS fedlex_url, max(p_partkey) FILTER (p_partkey % 3 = 2) AS lexfind_id FROM part GROUP BY p_brand")
def legislation_lines(t, spark):
    """The last line of each kind in the answers on laws."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("**In force since:** "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("- [DE] "), "p_name")).otherwise(F.concat(F.lit("**LexFind ID:** "), F.col("p_partkey").cast("string")))
    lines = t("part").groupBy(F.col("p_brand").alias("law")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return inventory.legislation_metadata(lines).select("law", "in_force_since", "fedlex_url", F.col("lexfind_id").cast("long").alias("lexfind_id"))


@query(_LOG + " SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending, CAST(sum(total_cost) AS DOUBLE) AS total_cost FROM s")
def state_counts(t, spark):
    """How many articles are in each state, and what all cost."""
    log = _log(t)
    return summary(replay(log), log)


@query("""WITH r AS (SELECT doc_id, coalesce(lang, '') AS law, CASE doc_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'doctrine' ELSE 'caselaw' END AS layer, 'Art. ' || CAST(doc_id AS VARCHAR) || ' ' || coalesce(lang, '') AS name, 'content/' || lower(coalesce(lang, '')) || '/art-' || CASE WHEN doc_id < 1000 THEN right('00' || CAST(doc_id AS VARCHAR), 3) ELSE CAST(doc_id AS VARCHAR) END AS dir, source FROM documents)
SELECT doc_id AS number, CASE layer WHEN 'doctrine' THEN 'opus-thinking' ELSE 'sonnet' END AS model, 'Write the ' || layer || ' layer of ' || name || '. Its directory is ' || dir || '.' || CASE WHEN source IS NOT NULL AND source <> '' AND doc_id % 2 = 0 THEN chr(10) || chr(10) || source ELSE '' END || CASE WHEN layer <> 'caselaw' AND doc_id % 5 = 0 THEN chr(10) || chr(10) || 'refs' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || chr(10) || 'The last attempt was rejected. Mend these issues:' || chr(10) || 'short' ELSE '' END AS prompt FROM r""")
def generation_prompts(t, spark):
    """A prompt for a layer of each document, with what is known of its article."""
    key = [F.coalesce("lang", F.lit("")).alias("law"), F.col("doc_id").alias("number"), F.lit("").alias("suffix")]
    layer = F.when(F.col("doc_id") % 3 == 0, "summary").when(F.col("doc_id") % 3 == 1, "doctrine").otherwise("caselaw")
    d = t("documents")
    asked = d.select(*key, layer.alias("layer"), F.when(F.col("doc_id") % 4 == 0, "short").alias("feedback"))
    refs = d.where("doc_id % 5 = 0").select(*key, F.lit("refs").alias("refs"))
    made = prompts.generation(prompts.enrich(asked, d.where("doc_id % 2 = 0").select(*key, F.col("source").alias("article_text")), refs, d.limit(0).select(*key, F.lit("").alias("materials"))))
    return made.select("number", "model", "prompt")


@query("SELECT doc_id % 100 AS article, min(CASE WHEN quality = 1 THEN 'publish' ELSE 'reject' END) FILTER (toxic = 0) AS base_verdict, CAST(sum(doc_id) FILTER (toxic = 0) AS DOUBLE) AS base_cost, CAST(count(*) FILTER (toxic = 0) AS DOUBLE) AS base_n, min(CASE WHEN quality = 1 THEN 'publish' ELSE 'reject' END) FILTER (toxic = 1) AS think_verdict, CAST(sum(doc_id) FILTER (toxic = 1) AS DOUBLE) AS think_cost FROM labels GROUP BY ALL")
def variant_table(t, spark):
    """Two variants side by side for each article."""
    runs = t("labels").select((F.col("doc_id") % 100).alias("article"), F.when(F.col("toxic") == 0, "base").otherwise("think").alias("variant"), F.when(F.col("quality") == 1, "publish").otherwise("reject").alias("verdict"), F.col("doc_id").cast("double").alias("cost"), F.lit(1.0).alias("seconds"))
    made = prompts.compare_variants(runs, ["base", "think"])
    return made.select("article", "base_verdict", "base_cost", F.coalesce("base_seconds", F.lit(0.0)).alias("base_n"), "think_verdict", "think_cost")


@query("""SELECT CAST(doc_id AS VARCHAR) AS law, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || chr(10) || coalesce(source, '') END AS text, CASE doc_id % 4 WHEN 1 THEN 'RPC error: ' || coalesce(source, '') WHEN 2 THEN 'no data in answer: event' WHEN 3 THEN 'OSError: busy' END AS error FROM documents""")
def rpc_answers(t, spark):
    """What answers of a service hold, or what is wrong with them."""
    item = lambda c: F.struct(F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"))
    good = F.to_json(F.struct(F.struct(F.array(item(F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), item(F.col("source"))).alias("content")).alias("result")))
    bad = F.to_json(F.struct(F.struct(F.lit(1).alias("code"), F.coalesce("source", F.lit("")).alias("message")).alias("error")))
    n = F.col("doc_id") % 4
    body = F.when(n == 0, F.concat(F.lit("event: message\ndata: "), good)).when(n == 1, F.concat(F.lit("data: "), bad)).when(n == 2, "event")
    got = t("documents").select(F.col("doc_id").cast("string").alias("law"), body.alias("body"), F.when(n == 3, "OSError: busy").alias("error"))
    return parse_answers(got)
