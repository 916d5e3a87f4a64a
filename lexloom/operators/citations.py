"""Decisions and the articles they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LAWS

_CITED = r"(?:\b(" + "|".join(LAWS) + r") Art\. (\d+)([a-z]*)\b|\bArt\. (\d+)([a-z]*)(?: [^.\n]{0,40}?)? (" + "|".join(LAWS) + r")\b)"


def parse_decisions(texts: DataFrame) -> DataFrame:
    """(text) -> pos, reference, articles: both list layouts (`N. **REF** - title`, `**N. DOCKET** (date) ...`). Only
    numbers with a known law are citations."""
    start = r"\n(?=\s*(?:\*\*)?\d+\. )"
    blocks = texts.select(F.posexplode(F.split(F.concat(F.lit("\n"), F.col("text")), start)).alias("pos", "block"))
    head = r"^\s*(?:\d+\. \*\*([^*]+)\*\*|\*\*\d+\. ([^*]+)\*\*)"
    ref = F.coalesce(F.nullif(F.regexp_extract("block", head, 1), F.lit("")), F.nullif(F.regexp_extract("block", head, 2), F.lit("")))
    groups = [F.regexp_extract_all("block", F.lit(_CITED), F.lit(i)) for i in range(1, 7)]
    cited = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda z: F.struct(F.concat(z["g0"], z["g5"]).alias("law"), F.concat(z["g1"], z["g3"]).cast("int").alias("article"), F.concat(z["g2"], z["g4"]).alias("suffix")))
    return blocks.select("pos", ref.alias("reference"), F.array_distinct(cited).alias("articles")).where("reference IS NOT NULL")


def by_article(decisions: DataFrame) -> DataFrame:
    """(reference, articles) -> law, article, suffix, decision_refs (sorted, distinct)."""
    rows = decisions.select("reference", F.explode("articles").alias("a")).select("reference", "a.*").distinct()
    return rows.groupBy("law", "article", "suffix").agg(F.array_sort(F.collect_list("reference")).alias("decision_refs"))


def search(decisions: DataFrame, query: str | None = None, law: str | None = None, article: int | None = None, limit: int | None = None) -> DataFrame:
    """Decisions that meet the conditions given; a falsy one is none. The most cited come first."""
    out = decisions
    if query:
        out = out.where(F.contains(F.lower("text"), F.lit(query.lower())))
    if law:
        out = out.where(F.exists("articles", lambda a: a["law"] == law))
    if article:
        out = out.where(F.exists("articles", lambda a: a["article"] == article))
    out = out.orderBy(F.desc("citations"), "reference") if "citations" in decisions.columns else out.orderBy("reference")
    return out.limit(limit) if limit else out


def affairs(raw: DataFrame) -> DataFrame:
    """(json) -> id, short_id, botschaften and resolutions of a parliamentary affair, flattened from its drafts."""
    from ..functions.text import bbl_reference

    ref = "struct<title:string,publication:struct<source:string,url:string,year:string,page:string>,date:string>"
    res = "struct<council:struct<name:string>,date:string,text:string>"
    parsed = raw.select(F.from_json("json", f"id long, title string, shortId string, drafts array<struct<references:array<{ref}>,consultation:struct<resolutions:array<{res}>>>>").alias("a")).select("a.*")
    refs = F.flatten(F.transform("drafts", lambda d: F.coalesce(d["references"], F.array().cast(f"array<{ref}>"))))
    made = F.transform(refs, lambda r: F.struct(F.concat_ws(" ", r["publication"]["source"], r["publication"]["year"], r["publication"]["page"]).alias("bbl_ref"), bbl_reference(F.concat_ws(" ", r["publication"]["source"], r["publication"]["year"], r["publication"]["page"])).alias("bbl_ref_normalized"), r["publication"]["url"].alias("pdf_url")))
    done = F.flatten(F.transform("drafts", lambda d: F.coalesce(d["consultation"]["resolutions"], F.array().cast(f"array<{res}>"))))
    return parsed.select(F.col("id").cast("string").alias("id"), F.col("shortId").alias("short_id"), made.alias("botschaften"), F.transform(done, lambda r: F.struct(r["council"]["name"].alias("council"), r["date"].alias("date"), r["text"].alias("text"))).alias("resolutions"))


def affair_counts(flattened: DataFrame) -> DataFrame:
    """id, messages, resolutions: how many of each an affair has; none where a list is null."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return flattened.select("id", n("botschaften").alias("messages"), n("resolutions").alias("resolutions"))


def leading_cases(decisions: DataFrame, law: str | None = None, article: int | None = None, limit: int = 10) -> DataFrame:
    """(reference, articles), a row each time a decision is named -> reference, citations: those named most often, ties
    by reference; with a law or an article only where it is named for that."""
    out = decisions
    if law or article:
        meets = lambda a: (a["law"] == law if law else F.lit(True)) & (a["article"] == article if article else F.lit(True))
        out = out.where(F.exists("articles", meets))
    return out.groupBy("reference").agg(F.count("*").alias("citations")).orderBy(F.desc("citations"), "reference").limit(limit)
