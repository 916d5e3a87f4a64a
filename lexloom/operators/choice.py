"""Which text of an article a reader gets: cantonal or federal source, asked language or the law's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LANGS

CANTONAL = "canton string, law_key string, sr_number string, language string, title string, lexfind_id int, source string, fetched_at string, article_count int, articles array<struct<number:int,suffix:string,raw:string,title:string>>, article_texts map<string,array<struct<num:string,text:string>>>"


def law_slug(abbr: Column, canton: Column, law_type: Column) -> Column:
    """A federal law's abbreviation in lower case; canton-type for a cantonal one."""
    return F.when(F.coalesce(canton, F.lit("")) == "", F.lower(abbr)).otherwise(F.concat(F.lower(canton), F.lit("-"), F.lower(law_type)))


def read_cantonal(spark: SparkSession, path: str) -> DataFrame:
    """(law, article, lang, text, original, canton, sr_number) of files of cantonal laws: the paragraphs of an article
    joined by lines, numbers first. A cantonal text is in its law's own language."""
    files = spark.read.schema(CANTONAL).json(path, multiLine=True, pathGlobFilter="*.json")
    parts = files.select(F.col("canton"), "sr_number", "language", law_slug(F.col("law_key"), F.col("canton"), F.lit("kv")).alias("law"), F.explode("article_texts").alias("article", "ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat_ws(" ", p["num"], p["text"])), "\n")
    return parts.select("law", "article", F.lower("language").alias("lang"), text.alias("text"), F.lit(True).alias("original"), "canton", "sr_number")


def cantonal_article_lists(spark: SparkSession, path: str) -> DataFrame:
    """(law, canton, sr_number, number, suffix, raw, title) of files of cantonal laws."""
    files = spark.read.schema(CANTONAL).json(path, multiLine=True, pathGlobFilter="*.json")
    return files.select(law_slug(F.col("law_key"), F.col("canton"), F.lit("kv")).alias("law"), "canton", "sr_number", F.explode("articles").alias("a")).select("law", "canton", "sr_number", "a.*")


def choose_texts(requests: DataFrame, *sources: DataFrame, langs: tuple[str, ...] = LANGS) -> DataFrame:
    """requests (law, article, lang) and sources (law, article, lang, text, original), the first that has a text first ->
    law, article, lang, text, text_lang, source, fallback.

    A reader gets the text in the language asked, by the first source that has it; else the text in the law's own
    language, as a fallback; else null. Of two texts of one source in one language the least one counts. Equal requests
    are one; a null language asks for the law's own. Requests and sources meet in one shuffle, by article: what
    travels is one row for each task and article, whatever the number of requests."""
    key = ["law", "article"]
    asked = requests.select(*key, F.lit(-1).alias("source"), F.col("lang"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("original"))
    rows = asked
    for i, s in enumerate(sources):
        rows = rows.unionByName(s.where("text IS NOT NULL").select(*key, F.lit(i).alias("source"), "lang", "text", F.coalesce("original", F.lit(False)).alias("original")))
    is_text = F.col("source") >= 0
    best = lambda when: F.min_by(F.struct("text", "lang", "source"), F.when(is_text & when, F.struct("source", "text", "lang")))
    wanted = F.collect_set(F.when(~is_text, F.coalesce("lang", F.lit(""))))  # a handful of languages
    met = rows.groupBy(*key).agg(wanted.alias("asked"), best(F.col("original")).alias("own"), *[best(F.col("lang") == x).alias(f"in_{x}") for x in langs])
    each = met.select(*key, F.explode("asked").alias("lang"), "own", *[f"in_{x}" for x in langs])
    direct = F.coalesce(*[F.when(F.col("lang") == x, F.col(f"in_{x}")) for x in langs])
    got = F.coalesce(direct, F.col("own"))
    return each.select(*key, F.nullif("lang", F.lit("")).alias("lang"), got["text"].alias("text"), got["lang"].alias("text_lang"), got["source"].alias("source"), (got.isNotNull() & F.coalesce(got["lang"] != F.nullif("lang", F.lit("")), F.lit(False))).alias("fallback"))
