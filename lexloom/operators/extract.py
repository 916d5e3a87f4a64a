"""Page texts of documents: markers, cleaning and density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, text) -> doc, pages, text: cleaned pages in order under `[Page N]` marks, a blank line between."""
    marked = pages.select("doc", "page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), T.clean_extracted(F.col("text"))).alias("t"))
    return marked.groupBy("doc").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def density(docs: DataFrame, floor: float = 1000.0) -> DataFrame:
    """Characters a page, and whether that is low."""
    rate = T.per_unit(F.length("text"), F.col("pages"))
    return docs.withColumn("chars_per_page", rate).withColumn("low_density", rate < floor)


def not_done(candidates: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return candidates.join(done, key, "left_anti")


def split_volume(volumes: DataFrame, text_col: str = "text") -> DataFrame:
    """A volume's articles at `Art. N` headings: key, text."""
    parts = volumes.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=Art\. \d+[a-z]*\s*\n)")).alias("part"))
    pattern = r"(?s)^Art\. (\d+[a-z]*)\s*\n(.*)$"
    return parts.where(F.col("part").rlike(pattern)).select(F.regexp_extract("part", pattern, 1).alias("key"), T.strip(F.regexp_extract("part", pattern, 2)).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(~F.col("skipped")).alias("processed"), F.count_if("skipped").alias("skipped"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("low_density"), F.col("doc")))), ", ").alias("low_density"))
