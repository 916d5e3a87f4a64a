"""Publication outputs: feed, sitemap, concept pages, navigation, JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import LANGS, LAYER_LABELS, PUBLISHED_DIRS, STATIC_PAGES, langs
from ..sinks.files import Files

SITE = "https://example.org"


def feed_entries(articles: DataFrame, limit: int = 100, laws: tuple[str, ...] = PUBLISHED_DIRS) -> DataFrame:
    """(law_dir, record) -> the newest layers: date descending, ties by law, article, suffix and layer."""
    rows = articles.where(F.col("law_dir").isin(*laws) & F.col("record").isNotNull()).select("law_dir", "record.*")
    layers = rows.select("law_dir", "law", "article", "article_suffix", "title", F.explode("layers").alias("layer", "m")).where(F.coalesce(F.col("m.last_generated"), F.lit("")) != "")
    law = F.upper(T.or_default(F.col("law"), F.col("law_dir")))
    entry = layers.select(
        law.alias("law"), "article", T.or_default(F.col("article_suffix"), "").alias("suffix"), T.default_title(F.col("title"), law, F.col("article"), F.col("article_suffix")).alias("title"),
        F.col("m.last_generated").alias("date"), "layer", F.coalesce(F.nullif(F.col("m.version"), F.lit(0)), F.lit(1)).alias("version"),
    )
    return entry.orderBy(F.desc("date"), "law", "article", "suffix", "layer").limit(limit)


def feed_items(entries: DataFrame, site: str = SITE) -> DataFrame:
    display = F.concat(F.lit("Art. "), T.article_key(F.col("article"), F.col("suffix")), F.lit(" "), F.col("law"))
    name = T.label(F.col("layer"), LAYER_LABELS, F.col("layer"))
    url = F.concat(F.lit(f"{site}/de/"), F.lower("law"), F.lit("/art-"), T.article_key(F.col("article"), F.col("suffix")))
    return entries.select(
        "date", "law", "article", "suffix", "layer",
        T.escape_xml(F.concat(display, F.lit(" — "), F.col("title"), F.lit(" ("), name, F.lit(" v"), F.col("version").cast("string"), F.lit(")"))).alias("item_title"),
        url.alias("link"), F.concat(url, F.lit("#"), F.col("layer"), F.lit("-v"), F.col("version").cast("string")).alias("guid"),
        T.rfc822(F.to_timestamp_ntz("date")).alias("pub_date"), T.escape_xml(F.concat(name, F.lit(" layer updated for "), display)).alias("description"),
    )


def feed_xml(items: DataFrame, title: str, description: str, site: str = SITE) -> DataFrame:
    """The RSS document of at most some hundred items, in one row."""
    item = F.format_string("    <item>\n      <title>%s</title>\n      <link>%s</link>\n      <guid>%s</guid>\n      <pubDate>%s</pubDate>\n      <description>%s</description>\n    </item>", "item_title", "link", "guid", "pub_date", "description")
    newest = Window.orderBy(F.desc("date"), "law", "article", "suffix", "layer")
    body = items.select(F.row_number().over(newest).alias("n"), item.alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda r: r["x"]), "\n").alias("items"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">\n  <channel>\n    <title>{title}</title>\n    <link>{site}</link>\n    <description>{description}</description>\n    <language>de</language>\n    <atom:link href="{site}/feed.xml" rel="self" type="application/rss+xml" />\n'
    return body.select(F.concat(F.lit(head), "items", F.lit("\n  </channel>\n</rss>")).alias("value"))


def page_url(site: str, lang: Column, page_path: Column) -> Column:
    return F.concat(F.lit(f"{site}/"), lang, page_path)


def sitemap_urls(dirs: DataFrame, site: str = SITE, laws: tuple[str, ...] = PUBLISHED_DIRS) -> DataFrame:
    """(law_dir, art_dir) -> lang, url, page_path, alternates: static pages, law indexes and articles in each language.
    The directories are read once and met with the four languages."""
    spark = dirs.sparkSession
    static = spark.createDataFrame([(0, i, "", f"/{p}" if p else "/") for i, p in enumerate(STATIC_PAGES)], "part int, n int, art_dir string, page_path string")
    index = spark.createDataFrame([(1, i, "", f"/{x}") for i, x in enumerate(laws)], "part int, n int, art_dir string, page_path string")
    number = F.create_map([F.lit(v) for i, x in enumerate(laws) for v in (x, i)])
    slug = T.slug_of_dir(F.col("art_dir"))
    arts = dirs.where(F.col("law_dir").isin(*laws) & slug.isNotNull()).select(F.lit(1).alias("part"), number[F.col("law_dir")].alias("n"), "art_dir", F.concat(F.lit("/"), "law_dir", F.lit("/"), slug).alias("page_path"))
    pages = static.unionByName(index).unionByName(arts).crossJoin(F.broadcast(langs(spark)))
    alternates = F.array(*[page_url(site, F.lit(x), F.col("page_path")) for x in LANGS])
    return pages.select("lang_pos", "part", "n", "art_dir", "lang", "page_path", page_url(site, F.col("lang"), F.col("page_path")).alias("url"), alternates.alias("alternates"))


URLS_A_FILE = 50_000  # what a sitemap file may hold

_URLSET = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">'
_INDEX = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def sitemap_entries(urls: DataFrame) -> DataFrame:
    """(lang_pos, part, n, art_dir, xml): one `<url>` element a row, with its alternates."""
    links = F.array_join(F.transform(F.arrays_zip(F.array(*[F.lit(x) for x in LANGS]).alias("l"), F.col("alternates").alias("u")), lambda z: F.concat(F.lit('<xhtml:link rel="alternate" hreflang="'), z["l"], F.lit('" href="'), T.escape_xml(z["u"]), F.lit('" />'))), "")
    return urls.select("lang_pos", "part", "n", "art_dir", F.concat(F.lit("<url><loc>"), T.escape_xml(F.col("url"), quotes=False), F.lit("</loc>"), links, F.lit("</url>")).alias("xml"))


def numbered(rows: DataFrame, order: list[str], folder: str, name: str = "number") -> DataFrame:
    """rows numbered from 0 in an order, without all of them in one task: ranges are sorted and kept below folder, and
    what the ranges before it hold, one number a range on the driver, is added to a row's place in its own."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(folder)  # kept, as ranges fall elsewhere each time they are worked out
    kept = spark.read.schema(ranged.schema).parquet(folder)
    sizes = dict(kept.groupBy("__range").count().collect())
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return kept.withColumn(name, start[F.col("__range")] + place - 1).drop("__range")


def write_sitemap(urls: DataFrame, path: str, scratch: str, site: str = SITE, urls_a_file: int = URLS_A_FILE) -> list[str]:
    """Writes the sitemap below path and returns the names of its files: sitemap.xml alone where all URLs fit in one;
    else sitemap-1.xml and so on, in order, with sitemap.xml as their index. Each file is whole, head and foot
    included, and written by one task, which holds what one file may. scratch: an unused folder."""
    spark = urls.sparkSession
    rows = numbered(sitemap_entries(urls), ["lang_pos", "part", "n", "art_dir"], f"{scratch}/numbered")
    body = rows.select(F.floor(F.col("number") / urls_a_file).cast("int").alias("file"), "number", F.col("xml").alias("value"))
    count = (body.agg(F.max("file")).first()[0] or 0) + 1
    frame = spark.range(count).select(F.col("id").cast("int").alias("file"))
    head, foot = (frame.select("file", F.lit(n).cast("long").alias("number"), F.lit(x).alias("value")) for n, x in ((-1, _URLSET), ((1 << 62), "</urlset>")))
    whole = body.select("file", F.col("number").cast("long"), "value").unionByName(head).unionByName(foot)
    whole.repartition(count, "file").sortWithinPartitions("file", "number").select("file", "value").write.partitionBy("file").text(f"{scratch}/files")
    files, names = Files(spark, path), []
    for i in range(count):
        part = next(n for n in files.names(f"{scratch}/files/file={i}") if n.startswith("part-"))
        names.append("sitemap.xml" if count == 1 else f"sitemap-{i + 1}.xml")
        files.move(f"{scratch}/files/file={i}/{part}", f"{path}/{names[-1]}")
    if count > 1:
        entries = "".join(f"\n<sitemap><loc>{site}/{n}</loc></sitemap>" for n in names)
        files.delete(f"{path}/sitemap.xml")
        files.publish(f"{_INDEX}{entries}\n</sitemapindex>\n", f"{path}/sitemap.xml")
        names.append("sitemap.xml")
    return names


def concept_pages(concepts: DataFrame) -> DataFrame:
    """Every concept in every language, with provision links and the number of provisions; an unknown confidence has no
    label."""
    labels = {x: f"concepts.{x}" for x in ("settled", "contested", "evolving")}
    return concepts.crossJoin(F.broadcast(langs(concepts.sparkSession))).select("lang", "slug", "title", T.label(F.col("confidence"), labels).alias("confidence_label"), F.size("provisions").alias("provision_count"), F.transform("provisions", lambda p: T.provision_link(p)).alias("links"))


def previous_next(articles: DataFrame) -> DataFrame:
    order = Window.partitionBy("law").orderBy("number", "suffix")
    return articles.withColumns({"previous": F.lag("raw").over(order), "next": F.lead("raw").over(order)})


def breadcrumb(c) -> F.Column:
    """Items of a trail with whether each is a link: all but the last."""
    return F.transform(c, lambda x, i: F.struct(x.alias("item"), (i < F.size(c) - 1).alias("linked")))


def page_title(title, site: str):
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(site)).otherwise(F.concat(title, F.lit(f" — {site}")))


def locale(lang):
    return T.label(lang, {"de": "de_CH", "fr": "fr_CH", "it": "it_CH", "en": "en_US"}, F.lit("de_CH"))


def list_totals(articles: DataFrame) -> DataFrame:
    """law, articles: the number of articles of each law, and of all (law null), with the number of laws."""
    return articles.where("law IS NOT NULL").rollup("law").agg(F.count("*").alias("articles"), F.count_distinct("law").alias("laws"))


def write_article_lists(articles: DataFrame, path: str) -> None:
    articles.groupBy("law").agg(F.count("*").alias("article_count"), F.array_sort(F.collect_list(F.struct("number", "suffix", "raw", "title"))).alias("articles")).write.json(path)


def write_texts(texts: DataFrame, path: str) -> None:
    texts.write.partitionBy("lang").json(path)


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], order: str, path: str) -> None:
    """Last change of a key, or what exists, written to a new path; readers switch when it is whole."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    newest = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", order)
    existing.join(newest, key, "left_anti").unionByName(newest).write.parquet(path)
