"""Parsers of article lists, article texts and metadata, and the scaffold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import LAYER_HEADINGS, LAYERS, laws

LAYER = "struct<last_generated:string,version:int,quality_score:double,trigger:string,last_reviewed:string,total_decisions:int,new_decisions_count:int>"
_LINE = r"(?U)^- Art\.\s+(\d+)\s*([a-z]*)\s*(.*)"


def parse_article_lists(responses: DataFrame) -> DataFrame:
    """(law, text) -> law, number, suffix, raw, title (null if none): article lines but ranges, the first of each key."""
    lines = responses.select("law", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    lines = lines.where(F.col("line").startswith("- Art.") & ~F.col("line").rlike(r"(?U)^- Art\.\s+\d+\s*(?:–|—|-)\s*\d+") & F.col("line").rlike(_LINE))
    found = lines.select("law", "pos", F.regexp_extract("line", _LINE, 1).cast("int").alias("number"), F.regexp_extract("line", _LINE, 2).alias("suffix"), T.strip(F.regexp_extract("line", _LINE, 3)).alias("rest"))
    found = found.withColumn("raw", T.article_key(F.col("number"), F.col("suffix")))
    first = Window.partitionBy("law", "raw").orderBy("pos")
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("law", "number", "suffix", "raw", F.nullif(T.article_title(F.col("rest")), F.lit("")).alias("title")).orderBy("law", "number", "suffix")


def article_paragraphs(texts: DataFrame, keys: list[str], text_col: str = "raw") -> DataFrame:
    """keys, pos, num (null if unnumbered), text: the paragraphs of what follows the first article heading."""
    lines = F.split(T.strip(F.col(text_col)), "\n", -1)
    head = lambda x: x.startswith("### Art.")
    first = F.array_position(F.transform(lines, head), True)
    body = F.when(first > 0, F.array_join(F.filter(F.slice(lines, first.cast("int"), F.size(lines)), lambda x: ~head(x)), "\n")).otherwise("")
    parts = F.filter(F.transform(F.split(T.strip(body), r"\n(?=(?U)\d+\s)", -1), T.strip), lambda x: x != "")
    pattern = r"(?sU)^(\d+)\s+(.*)"
    exploded = texts.select(*keys, F.posexplode(parts).alias("pos", "part"))
    num = F.nullif(F.regexp_extract("part", pattern, 1), F.lit(""))
    return exploded.select(*keys, "pos", num.alias("num"), F.when(num.isNull(), F.col("part")).otherwise(T.strip(F.regexp_extract("part", pattern, 2))).alias("text"))


def continued_paragraphs(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos, num, text: a numbered line opens a paragraph, other lines go on with it."""
    lines = texts.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    order = Window.partitionBy(*keys).orderBy("line_no")
    starts = F.col("line").rlike(r"^\d+\s+\S") | (F.row_number().over(order) == 1)
    grouped = lines.withColumn("pos", F.sum(starts.cast("int")).over(order))
    joined = grouped.groupBy(*keys, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("t"))
    num = F.nullif(F.regexp_extract("t", r"^(\d+)\s+(.*)", 1), F.lit(""))
    return joined.select(*keys, "pos", num.alias("num"), F.when(num.isNull(), F.col("t")).otherwise(F.regexp_extract("t", r"^(\d+)\s+(.*)", 2)).alias("text"))


def legislation_metadata(responses: DataFrame) -> DataFrame:
    """(law, text) -> sr_number and the fields of the header lines, the last of each. lexfind_id reads the digits after
    the label; the label's closing asterisks made the original reading fail on every line."""
    line = F.col("line")
    lines = responses.select("law", F.posexplode(T.split_lines(F.col("text"))).alias("pos", "line"))
    field = F.when(line.startswith("**LexFind ID:**"), "lexfind_id").when(line.startswith("**In force since:**"), "in_force_since").when(line.startswith("- [DE]"), "fedlex_url").when(line.startswith("- [DE PDF]"), "lexfind_url")
    value = F.when(line.startswith("**"), T.strip(F.element_at(F.split(line, r":\*\*"), -1))).otherwise(T.strip(F.element_at(F.split(line, "]"), -1)))
    tagged = lines.select("law", "pos", field.alias("field"), value.alias("value"))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("pos"))).alias(f)
    out = tagged.groupBy("law").agg(*[last(f) for f in ("lexfind_id", "in_force_since", "fedlex_url", "lexfind_url")])
    return out.withColumn("lexfind_id", F.expr("try_cast(lexfind_id AS INT)")).join(F.broadcast(laws(responses.sparkSession).select("law", "sr_number")), "law", "left")


def scaffold(candidates: DataFrame, metas: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates (law, number, suffix, title), metas (law, number, suffix, title), files (law, number, suffix, file) ->
    metas to create, metas with titles brought up to date, placeholder files to create. Nothing that exists is lost."""
    key = ["law", "number", "suffix"]
    wanted = candidates.dropDuplicates(key).join(F.broadcast(laws(candidates.sparkSession).select("law", "sr_number", "eli")), "law", "left")
    title = T.default_title(F.col("title"), F.col("law"), F.col("number"), F.col("suffix"))
    wanted = wanted.select(*key, title.alias("title"), F.coalesce("sr_number", F.lit("")).alias("sr_number"), T.fedlex_url(F.col("eli"), F.col("number"), F.col("suffix")).alias("fedlex_url"))
    created = wanted.join(metas, key, "left_anti").withColumn("absatz_count", F.lit(1))
    new = wanted.select(*key, F.col("title").alias("new_title"))
    updated = metas.join(new, key, "left").withColumn("title", F.when(F.col("new_title").isNotNull() & (F.coalesce("title", F.lit("")).startswith("Art. ") | (F.coalesce("title", F.lit("")) == "")), F.col("new_title")).otherwise(F.col("title"))).drop("new_title")
    heads = F.explode(F.array(*[F.struct(F.lit(f"{x}.md").alias("file"), F.lit(LAYER_HEADINGS[x]).alias("heading")) for x in LAYERS])).alias("f")
    bodies = wanted.select(*key, "title", heads).select(*key, "f.file", F.concat(F.lit("# "), F.col("f.heading"), F.lit("\n\nArt. "), T.article_key(F.col("number"), F.col("suffix")), F.lit(" "), F.col("law"), F.lit(" — "), F.col("title"), F.lit("\n")).alias("text"))
    return created, updated, bodies.join(files, [*key, "file"], "left_anti")


def scaffold_records(created: DataFrame) -> DataFrame:
    """The metas that scaffold creates as whole records: law_dir, art_dir, record; one paragraph, no layers yet, and
    empty where nothing is known."""
    none = F.create_map().cast(f"map<string,{LAYER}>")
    record = F.struct("law", F.col("number").cast("int").alias("article"), F.coalesce("suffix", F.lit("")).alias("article_suffix"), "title", "sr_number", "absatz_count", "fedlex_url", F.lit(None).cast("int").alias("lexfind_id"), F.lit("").alias("lexfind_url"), F.lit("").alias("in_force_since"), none.alias("layers"))
    return created.select(F.lower("law").alias("law_dir"), T.dir_name(F.col("number"), F.col("suffix")).alias("art_dir"), record.alias("record"))


def nest_texts(paragraphs: DataFrame) -> DataFrame:
    """law, key, pos, num, text -> law, texts: map of key to paragraphs; the last of a repeated position wins."""
    last = paragraphs.groupBy("law", "key", "pos").agg(F.max_by(F.struct("num", "text"), "pos").alias("p"))
    rows = last.groupBy("law", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("ps"))
    return rows.groupBy("law").agg(F.map_from_entries(F.collect_list(F.struct("key", "ps"))).alias("texts"), F.count_if(F.size("ps") > 0).alias("with_text"), F.count("*").alias("articles"))
