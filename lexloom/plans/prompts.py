"""Prompts as columns: generation and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import LAWS, LAYERS, MODELS, TRANSLATIONS


def enrich(requests: DataFrame, texts: DataFrame, references: DataFrame, materials: DataFrame) -> DataFrame:
    """Requests with article_text, refs and materials, the last two for doctrine and summary only."""
    key = ["law", "number", "suffix"]
    out = requests.join(texts.select(*key, "article_text"), key, "left").join(references.select(*key, "refs"), key, "left").join(materials.select(*key, "materials"), key, "left")
    both = F.col("layer").isin("doctrine", "summary")
    return out.withColumns({"refs": F.when(both, F.col("refs")), "materials": F.when(both, F.col("materials"))})


def _name():
    return F.concat(F.lit("Art. "), T.article_key(F.col("number"), F.col("suffix")), F.lit(" "), F.col("law"))


def _known(c, names, what):
    return F.coalesce(T.label(c, names), F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(c, F.lit("null")))))


def generation(requests: DataFrame, root: str = "content") -> DataFrame:
    """Enriched requests (law, number, suffix, layer, feedback, article_text, refs, materials) with model and prompt; an
    unknown layer fails."""
    block = lambda c, lead="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("\n\n" + lead), F.col(c))).otherwise("")
    prompt = F.concat(F.lit("Write the "), "layer", F.lit(" layer of "), _name(), F.lit(". Its directory is "), T.article_path(root, F.col("law"), F.col("number"), F.col("suffix")), F.lit("."), block("article_text"), block("refs"), block("materials"), block("feedback", "The last attempt was rejected. Mend these issues:\n"))
    return requests.withColumns({"model": _known(F.col("layer"), MODELS, "layer"), "prompt": prompt})


def translation(requests: DataFrame) -> DataFrame:
    """Requests (law, number, suffix, layer, target_lang) with target_layer and prompt; an unknown language fails."""
    target = F.concat_ws(".", "layer", "target_lang")
    return requests.withColumn("target_layer", target).withColumn("prompt", F.concat(F.lit("Translate the "), "layer", F.lit(" layer of "), _name(), F.lit(" from German to "), _known(F.col("target_lang"), TRANSLATIONS, "language"), F.lit(" and write it as "), target, F.lit(".")))


def guidelines(files: DataFrame, requests: DataFrame) -> DataFrame:
    """files (file, text), requests (law, layer) -> system prompt: global, law and layer texts in that order. A layer or
    a law that the corpus does not have fails, and so does a layer or a global text that no file holds; a law may do
    without a text of its own."""
    asked = requests.select("law", "layer").distinct()
    checked = asked.withColumns({"layer": _known(F.col("layer"), {x: x for x in LAYERS}, "layer"), "law": _known(F.col("law"), {x: x for x in LAWS}, "law")})
    parts = checked.select("law", "layer", F.posexplode(F.array(F.lit("global"), F.lower("law"), F.col("layer"))).alias("pos", "file"))
    # a text for each law and layer at most
    found = parts.join(F.broadcast(files), "file", "left")
    text = F.when(F.col("text").isNull() & (F.col("pos") != 1), F.raise_error(F.concat(F.lit("no guideline: "), "file"))).otherwise(F.col("text"))
    return found.groupBy("law", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("system_prompt"))


def compare_variants(results: DataFrame, variants: list[str]) -> DataFrame:
    """(article, variant, verdict, cost, seconds, scores) -> a row an article, columns by variant. Of two runs of a
    variant costs and seconds add up; the verdict and scores are those of the least verdict."""
    scores = [F.min_by("scores", "verdict").alias("scores")] if "scores" in results.columns else []
    return results.groupBy("article").pivot("variant", variants).agg(F.min("verdict").alias("verdict"), F.sum("cost").alias("cost"), F.sum("seconds").alias("seconds"), *scores)


def variant_summary(results: DataFrame) -> DataFrame:
    """variant, runs, published, cost, seconds, and mean_scores: the mean of each score over its runs."""
    means = results.select("variant", F.explode("scores").alias("name", "score")).groupBy("variant", "name").agg(F.avg("score").alias("mean"))
    maps = means.groupBy("variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "mean")))).alias("mean_scores"))
    whole = results.groupBy("variant").agg(F.count("*").alias("runs"), F.count_if(F.col("verdict") == "publish").alias("published"), F.sum("cost").alias("cost"), F.sum("seconds").alias("seconds"))
    return whole.join(maps, "variant", "left")
