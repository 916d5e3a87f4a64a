"""The library's operators on the driver's tables, each with its SQL. Patterns that the tables lack are injected by the
same rewrite on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import LANGS, LAYER_LABELS
from ..operators.citations import by_article
from ..operators.extract import density, join_pages, not_done
from ..operators.inventory import scaffold
from ..operators.state import budget_reached
from ..operators.validate import score_gate
from .publish import list_totals, previous_next

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
        SQL[f.__name__] = sql
        return f

    return add


def _layers(t) -> DataFrame:
    """Two layers a labelled document, with a date that depends on doc_id; every seventh has none."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")
    both = F.explode(F.array(F.struct(F.lit("summary").alias("layer"), F.col("quality").alias("version")), F.struct(F.lit("caselaw").alias("layer"), F.col("toxic").alias("version"))))
    rows = t("labels").select("doc_id", both.alias("l")).select("doc_id", "l.*").withColumn("date", F.when(F.col("doc_id") % 7 == 0, "").otherwise(day))
    return rows.join(t("documents").select("doc_id", "lang", "source"), "doc_id")


_LAYERS = """WITH layers AS (SELECT l.doc_id, x.layer, x.version, CASE WHEN l.doc_id % 7 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(l.doc_id % 400 AS INTEGER), '%Y-%m-%d') END AS date, d.lang, d.source
FROM (SELECT doc_id, 'summary' AS layer, quality AS version FROM labels UNION ALL SELECT doc_id, 'caselaw', toxic FROM labels) x JOIN labels l USING (doc_id) JOIN documents d USING (doc_id))"""


@query(_LAYERS + """ SELECT doc_id, lang, date, CASE layer WHEN 'summary' THEN 'Overview' WHEN 'doctrine' THEN 'Doctrine' WHEN 'caselaw' THEN 'Case Law' ELSE layer END AS label,
'https://example.org/de/' || lower(lang) || '/art-' || CAST(doc_id AS VARCHAR) || '#' || layer || '-v' || CAST(greatest(version, 1) AS VARCHAR) AS guid,
strftime(CAST(date AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S GMT') AS pub_date FROM layers WHERE date <> '' ORDER BY date DESC, doc_id, layer LIMIT 100""")
def feed_topk(t, spark):
    top = _layers(t).where("date <> ''").orderBy(F.desc("date"), "doc_id", "layer").limit(100)
    guid = F.concat(F.lit("https://example.org/de/"), F.lower("lang"), F.lit("/art-"), F.col("doc_id").cast("string"), F.lit("#"), "layer", F.lit("-v"), F.greatest("version", F.lit(1)).cast("string"))
    return top.select("doc_id", "lang", "date", T.label(F.col("layer"), LAYER_LABELS, F.col("layer")).alias("label"), guid.alias("guid"), T.rfc822(F.to_timestamp_ntz("date")).alias("pub_date"))


@query("SELECT d.doc_id, r.file FROM documents d CROSS JOIN (VALUES ('summary.md'), ('doctrine.md'), ('caselaw.md')) r(file) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND ((r.file = 'summary.md' AND l.quality = 1) OR (r.file = 'caselaw.md' AND l.toxic = 1)))")
def layer_anti_required(t, spark):
    present = t("labels").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "summary.md"), F.when(F.col("toxic") == 1, "caselaw.md")))).alias("file"))
    wanted = t("documents").select("doc_id", F.explode(F.array(F.lit("summary.md"), F.lit("doctrine.md"), F.lit("caselaw.md"))).alias("file"))
    return wanted.join(present, ["doc_id", "file"], "left_anti")


@query("SELECT l.doc_id, u.layer FROM labels l CROSS JOIN (VALUES ('quality'), ('toxic')) u(layer) WHERE (CASE u.layer WHEN 'quality' THEN l.quality ELSE l.toxic END) = 1 AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.source = 'src0')")
def layer_anti_declared(t, spark):
    declared = t("labels").select("doc_id", F.explode(F.map_keys(F.map_filter(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic")), lambda _, v: v == 1))).alias("layer"))
    return declared.join(t("documents").where("source = 'src0'").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> c_custkey % 5")
def dim_mismatch(t, spark):
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_regionkey") != F.col("c_custkey") % 5).select("c_custkey", "n_name")


@query("SELECT s_suppkey, coalesce(n.n_name, '') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n.n_nationkey")
def dim_left_default(t, spark):
    return t("supplier").join(F.broadcast(t("nation").where("n_regionkey < 3")), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nation"))


@query("""WITH e AS (SELECT lang, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT lang, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0 UNION ALL SELECT lang, doc_id FROM documents WHERE n_chars < 500)
SELECT d.lang, CAST(d.n AS BIGINT) AS total_articles, CAST(coalesce(x.n, 0) AS BIGINT) AS errors, coalesce(x.n, 0) = 0 AS valid FROM (SELECT lang, count(*) n FROM documents GROUP BY lang) d LEFT JOIN (SELECT lang, count(*) n FROM e GROUP BY lang) x ON d.lang IS NOT DISTINCT FROM x.lang""")
def validation_report(t, spark):
    d, labels = t("documents").select("doc_id", "lang", "n_chars"), t("labels").select("doc_id", "quality")
    errors = d.join(labels, "doc_id", "left_anti").select("lang").unionAll(d.join(labels.where("quality = 0"), "doc_id").select("lang")).unionAll(d.where("n_chars < 500").select("lang"))
    n, e = d.groupBy("lang").agg(F.count("*").alias("total_articles")), errors.groupBy(F.col("lang").alias("l2")).agg(F.count("*").alias("n"))
    errors_n = F.coalesce("n", F.lit(0).cast("long"))
    return n.join(e, n["lang"].eqNullSafe(e["l2"]), "left").select("lang", "total_articles", errors_n.alias("errors"), (errors_n == 0).alias("valid"))


@query("SELECT doc_id, line_key FROM (SELECT doc_id, md5(split_part(text, chr(10), 1)) AS line_key, row_number() OVER (PARTITION BY md5(split_part(text, chr(10), 1)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_seen_dedupe(t, spark):
    first = t("documents").groupBy(F.md5(F.substring_index("text", "\n", 1)).alias("line_key")).agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "line_key")


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_event FROM events GROUP BY user_id")
def last_wins(t, spark):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("last_event"))


_STATE = "WITH s AS (SELECT user_id, arg_max(event_id % 3, event_id) AS st FROM events GROUP BY user_id)"


@query(_STATE + " SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (st = 0) AS BIGINT) AS completed, CAST(count(*) FILTER (st = 1) AS BIGINT) AS failed, CAST(count(*) FILTER (st = 2) AS BIGINT) AS pending FROM s")
def state_summary(t, spark):
    last = t("events").groupBy("user_id").agg(F.max_by(F.col("event_id") % 3, "event_id").alias("st"))
    return last.agg(F.count("*").alias("total"), *[F.count_if(F.col("st") == i).alias(n) for i, n in enumerate(("completed", "failed", "pending"))])


@query("WITH c AS (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS cost FROM events WHERE event_id % 3 = 0) SELECT CAST(sum(s) AS BIGINT) AS total_cost, CAST(sum(l) AS BIGINT) AS latest_cost FROM (SELECT user_id, sum(cost) AS s, arg_max(cost, event_id) AS l FROM c GROUP BY user_id)")
def cost_double_count(t, spark):
    c = t("events").where("event_id % 3 = 0").select("user_id", "event_id", F.floor(F.col("value") * 100).alias("cost"))
    return c.groupBy("user_id").agg(F.sum("cost").alias("s"), F.max_by("cost", "event_id").alias("l")).agg(F.sum("s").alias("total_cost"), F.sum("l").alias("latest_cost"))


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) OVER w AS BIGINT) AS running_cost, sum(CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) OVER w > 50000 AS exceeded FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def budget_cut(t, spark):
    e = t("events").select("user_id", F.col("event_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "completed").otherwise("add").alias("event"), F.floor(F.col("value") * 100).alias("cost"))
    return budget_reached(e, 50000, ["user_id"]).select("user_id", "event_id", F.col("running_cost").cast("long").alias("running_cost"), "exceeded")


@query("SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)")
def pending_keys(t, spark):
    return t("customer").select("c_custkey").distinct().join(t("orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT coalesce(lang, 'all') AS lang, CAST(count(*) AS BIGINT) AS articles FROM documents WHERE lang IS NOT NULL GROUP BY ROLLUP (lang)")
def law_rollup(t, spark):
    return list_totals(t("documents").select(F.col("lang").alias("law"))).select(F.coalesce("law", F.lit("all")).alias("lang"), "articles")


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 'art-' || right('00' || CAST(o_orderkey AS VARCHAR), 3) ELSE 'art-' || CAST(o_orderkey AS VARCHAR) END || 'a' AS dir FROM orders")
def dir_name(t, spark):
    return t("orders").select("o_orderkey", T.dir_name(F.col("o_orderkey"), F.lit("a")).alias("dir"))


@query("SELECT p_partkey, 'art-' || CAST(p_partkey AS VARCHAR) || 'bis' AS slug, '/de/or/art-' || ltrim(CAST(p_partkey AS VARCHAR) || 'bis', '0') AS href FROM part")
def slug_strip(t, spark):
    d = T.dir_name(F.col("p_partkey"), F.lit("bis"))
    return t("part").select("p_partkey", T.slug_of_dir(d).alias("slug"), T.provision_link(F.concat(F.lit("or/"), d))["href"].alias("href"))


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text || chr(10) || '12' || chr(10) || 'BBl 1999' || chr(10) || 'Bundes-' || chr(10) || 'rechts', '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), chr(10)), lambda x: NOT regexp_matches(trim(x), '^([0-9]+|(?i:bbl)\s+[0-9]{4})$')), chr(10)) AS cleaned FROM documents""")
def clean_text(t, spark):
    return t("documents").select("doc_id", T.clean_extracted(F.concat("text", F.lit("\n12\nBBl 1999\nBundes-\nrechts"))).alias("cleaned"))


@query("SELECT doc_id, string_agg('[Page ' || CAST(i AS VARCHAR) || ']' || chr(10) || p, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id")
def page_markers(t, spark):
    pages = t("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("doc", (F.col("at") + 1).alias("page"), "text")
    return join_pages(pages).select(F.col("doc").alias("doc_id"), "text")


@query(r"""SELECT doc_id, CAST(len(string_split(replace(text, chr(10), chr(10) || '7 '), chr(10) || '7 ')) AS BIGINT) AS parts, string_split(replace(text, chr(10), chr(10) || '7 '), chr(10) || '7 ')[-1] AS last_text FROM documents""")
def paragraph_split(t, spark):
    parts = F.split(F.replace("text", F.lit("\n"), F.lit("\n7 ")), r"\n(?=7 )", -1)
    return t("documents").select("doc_id", F.size(parts).cast("long").alias("parts"), F.regexp_replace(F.element_at(parts, -1), "^7 ", "").alias("last_text"))


@query("SELECT conv_id, CAST(grp AS BIGINT) AS pos, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, text, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations) GROUP BY conv_id, grp")
def continuation_lines(t, spark):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = t("conversations").withColumn("pos", F.sum((F.col("turn") % 3 == 0).cast("int")).over(order))
    return c.groupBy("conv_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) / (len(text) - len(replace(text, chr(10), '')) + 1) AS chars_per_page, CAST(length(text) AS DOUBLE) / (len(text) - len(replace(text, chr(10), '')) + 1) < 1000 AS low_density FROM documents")
def low_density(t, spark):
    return density(t("documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("pages"))).select("doc_id", "chars_per_page", "low_density")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_text, CAST(page_id AS VARCHAR) AS number FROM pages")
def html_text(t, spark):
    span = F.concat(F.lit("<span class='number'>"), F.col("page_id").cast("string"), F.lit("</span>"))
    return t("pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("n_text"), T.html_number(F.concat(span, "html")).alias("number"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS feed, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS sitemap FROM pages""")
def xml_escape(t, spark):
    return t("pages").select("page_id", T.escape_xml(F.col("html")).alias("feed"), T.escape_xml(F.col("html"), quotes=False).alias("sitemap"))


@query("""WITH l AS (SELECT unnest(['de', 'fr', 'it', 'en']) AS lang), p AS (SELECT unnest(['/', '/about', '/methodology', '/changelog']) AS page_path UNION ALL SELECT '/' || d.lang || '/art-' || CAST(d.doc_id AS VARCHAR) FROM documents d WHERE d.lang IS NOT NULL)
SELECT l.lang, p.page_path, 'https://example.org/' || l.lang || p.page_path AS url, 'https://example.org/en' || p.page_path AS alternate_en FROM p CROSS JOIN l""")
def sitemap_urls(t, spark):
    static = spark.createDataFrame([("/",), ("/about",), ("/methodology",), ("/changelog",)], "page_path string")
    slug = T.slug_of_dir(T.dir_name(F.col("doc_id"), F.lit("")))
    pages = static.unionAll(t("documents").where("lang IS NOT NULL").select(F.concat(F.lit("/"), "lang", F.lit("/"), slug)))
    per = pages.select("page_path", F.explode(F.array(*map(F.lit, LANGS))).alias("lang"))
    return per.select("lang", "page_path", F.concat(F.lit("https://example.org/"), "lang", "page_path").alias("url"), F.concat(F.lit("https://example.org/en"), "page_path").alias("alternate_en"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang, CASE WHEN regexp_extract(url, '^https?://[^/]+/[a-z]+(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+/[a-z]+(/.*)$', 1) END AS path FROM pages")
def url_language(t, spark):
    return t("pages").select("page_id", T.url_language(F.col("url")).alias("lang"), T.url_path(F.col("url")).alias("path"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date FROM orders")
def rfc822_date(t, spark):
    return t("orders").select("o_orderkey", T.rfc822(F.col("o_orderdate")).alias("pub_date"))


@query("SELECT p_partkey, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def prev_next(t, spark):
    articles = t("part").select(F.col("p_brand").alias("law"), F.col("p_partkey").alias("number"), F.lit("").alias("suffix"), F.col("p_partkey").alias("raw"))
    return previous_next(articles).select(F.col("number").alias("p_partkey"), "previous", "next")


@query("SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS decision_refs, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY l_partkey")
def citation_map(t, spark):
    cited = t("lineitem").select(F.col("l_orderkey").alias("reference"), F.array(F.struct(F.lit("OR").alias("law"), F.col("l_partkey").alias("article"), F.lit("").alias("suffix"))).alias("articles"))
    found = by_article(cited)
    return found.select(F.col("article").alias("l_partkey"), F.array_join(F.transform("decision_refs", lambda x: x.cast("string")), ",").alias("decision_refs"), F.size("decision_refs").cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_props(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT conv_id, turn, (CASE WHEN role = 'user' THEN len(string_split(text, ' ')) ELSE 0 END * 10 + CASE WHEN role <> 'user' THEN len(string_split(text, ' ')) ELSE 0 END * 30) / 1000000.0::DOUBLE AS cost FROM conversations")
def token_cost(t, spark):
    n = F.size(F.split("text", " ", -1))
    return t("conversations").select("conv_id", "turn", T.token_cost(F.when(F.col("role") == "user", n), F.when(F.col("role") != "user", n)).alias("cost"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_skip(t, spark):
    return not_done(t("documents").select("doc_id", "source"), t("labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 3 = 1 THEN 'Art. ' || CAST(doc_id AS VARCHAR) || ' ' || coalesce(lang, '') ELSE source END AS title FROM documents")
def title_upsert(t, spark):
    old = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Art. 1").otherwise(F.col("source"))
    d = t("documents").select(F.coalesce("lang", F.lit("")).alias("law"), F.col("doc_id").alias("number"), F.lit("").alias("suffix"), old.alias("title"))
    _, updated, _ = scaffold(d.withColumn("title", F.lit("")), d, spark.createDataFrame([], "law string, number long, suffix string, file string"))
    return updated.select(F.col("number").alias("doc_id"), "title")


@query("SELECT doc_id AS item, quality * 0.96 >= 0.95 AS passed FROM labels")
def score_gate_query(t, spark):
    scores = lambda e, v: t("labels").select(F.col("doc_id").alias("item"), F.lit(e).alias("evaluator"), F.create_map(F.lit("precision"), v).alias("scores"))
    rows = scores("first", F.col("quality") * 0.96).unionAll(scores("advice", F.lit(0.0))).unionAll(scores("third", F.lit(1.0)))
    return score_gate(rows, {"precision": 0.95}, ("advice",))


@query("SELECT r_name AS law, string_agg(n_name, '|' ORDER BY n_nationkey) AS articles, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def nest_map(t, spark):
    rows = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("law")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a")).select("law", F.array_join(F.transform("a", lambda x: x["n_name"]), "|").alias("articles"), F.size("a").cast("long").alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["feed_topk"](spark, sf_dir)
