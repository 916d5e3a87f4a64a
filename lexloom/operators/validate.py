"""Checks of metadata records and of the content tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AUTHOR_STATUS, CONFIDENCE, LAWS, LAYERS, laws


def article_problems() -> Column:
    """Array of problems of an article record; empty if it is valid."""
    layer_ok = lambda _, m: (F.coalesce(m["version"], F.lit(0)) >= 1) & (F.coalesce(m["quality_score"], F.lit(0.0)).between(0, 1)) & (F.coalesce(m["total_decisions"], F.lit(0)) >= 0) & (F.coalesce(m["new_decisions_count"], F.lit(0)) >= 0)
    checks = [
        (~F.coalesce(F.col("law").isin(*LAWS), F.lit(False)), "unknown law"),
        (~F.coalesce(F.col("article") > 0, F.lit(False)), "article must be positive"),
        (F.coalesce(F.length("title"), F.lit(0)) < 1, "empty title"),
        (~F.coalesce(F.col("absatz_count") >= 1, F.lit(False)), "absatz_count must be at least 1"),
        (~F.coalesce(F.forall(F.map_keys("layers"), lambda k: k.isin(*LAYERS)), F.lit(True)), "unknown layer"),
        (~F.coalesce(F.forall(F.map_entries("layers"), lambda e: layer_ok(e["key"], e["value"])), F.lit(True)), "layer out of range"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def concept_problems(contested: bool = False) -> Column:
    checks = [(~F.coalesce(F.col("author_status").isin(*AUTHOR_STATUS), F.lit(False)), "unknown author_status"), (F.coalesce(F.length("title"), F.lit(0)) < 1, "empty title")]
    checks += [(~F.coalesce(F.col("type") == ("contested" if contested else "concept"), F.lit(False)), "wrong type")]
    if not contested:
        checks += [(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "unknown confidence"), (~F.coalesce(F.col("quality_score").between(0, 1), F.lit(True)), "quality out of range")]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def reference_problems() -> Column:
    """Of a commentary reference: authors, edition and the positions of controversies must not be empty."""
    checks = [
        (F.coalesce(F.size("authors"), F.lit(0)) < 1, "no authors"),
        (F.coalesce(F.length("edition"), F.lit(0)) < 1, "empty edition"),
        (~F.coalesce(F.forall("controversies", lambda c: F.size(c["positions"]) >= 1), F.lit(True)), "controversy without positions"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))


def tree_errors(dirs: DataFrame, files: DataFrame, metas: DataFrame) -> DataFrame:
    """dirs (law_dir, art_dir), files (law_dir, art_dir, file), metas (law_dir, art_dir, law, layers, problems) ->
    law_dir, art_dir, ordinal, error. A missing or invalid record ends the checks of its directory."""
    key = ["law_dir", "art_dir"]
    dirs = dirs.where(~F.col("law_dir").startswith(".") & F.col("art_dir").startswith("art-")).dropDuplicates(key)
    at = F.concat_ws("/", *key)
    error = lambda df, n, *text: df.select(*key, F.lit(n).alias("ordinal"), F.concat(at, F.lit(": "), *text).alias("error"))
    known = dirs.join(metas, key)
    missing = error(dirs.join(metas, key, "left_anti"), 0, F.lit("missing meta.yaml"))
    invalid = error(known.where(F.size("problems") > 0), 1, F.lit("invalid meta.yaml — "), F.array_join("problems", "; "))
    valid = known.where(F.size("problems") == 0)
    required = valid.select(*key, F.explode(F.array(*[F.lit(f"{x}.md") for x in LAYERS])).alias("file")).join(files, [*key, "file"], "left_anti")
    declared = valid.select(*key, F.explode(F.map_keys("layers")).alias("layer")).withColumn("file", F.concat("layer", F.lit(".md"))).join(files, [*key, "file"], "left_anti")
    names = F.broadcast(laws(dirs.sparkSession).select(F.col("dir").alias("law_dir"), F.col("law").alias("dir_law")))
    other = valid.join(names, "law_dir").where("dir_law <> law")
    return (
        missing.unionByName(invalid)
        .unionByName(error(required, 2, F.lit("missing "), F.col("file")))
        .unionByName(error(declared, 3, F.lit("meta declares '"), F.col("layer"), F.lit("' but "), F.col("file"), F.lit(" missing")))
        .unionByName(error(other, 4, F.lit("directory under '"), F.col("law_dir"), F.lit("/' but meta says law='"), F.col("law"), F.lit("'")))
    )


def tree_report(dirs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: total_articles, errors (count), valid."""
    total = dirs.where(~F.col("law_dir").startswith(".") & F.col("art_dir").startswith("art-")).distinct().agg(F.count("*").alias("total_articles"))
    return total.join(F.broadcast(errors.agg(F.count("*").alias("errors")))).withColumn("valid", F.col("errors") == 0)


def score_gate(results: DataFrame, thresholds: dict[str, float], advisory: tuple[str, ...] = ()) -> DataFrame:
    """(item, evaluator, scores map) -> item, passed: every evaluator but the advisory ones reaches every threshold."""
    limits = F.create_map([F.lit(x) for k, v in thresholds.items() for x in (k, v)])
    ok = F.forall(F.map_keys(limits), lambda k: F.coalesce(F.col("scores")[k] >= limits[k], F.lit(False)))
    return results.where(~F.col("evaluator").isin(*advisory) if advisory else F.lit(True)).groupBy("item").agg(F.bool_and(ok).alias("passed"))


def report_text(dirs: DataFrame, errors: DataFrame, shown: int = 1000) -> tuple[str, int]:
    """The report of a content tree as text, and the exit status: 0 for a tree without errors, else 1. Errors stand in
    order of directory and kind; beyond `shown` only their number is given, as the rest stays in the table."""
    one = tree_report(dirs, errors).first()
    lines = [f"Validated {one['total_articles']} articles"]
    if one["valid"]:
        return "\n".join([*lines, "All valid."]), 0
    first = errors.orderBy("law_dir", "art_dir", "ordinal", "error").limit(shown).collect()
    lines += [f"{one['errors']} errors:", *[f"  - {r['error']}" for r in first]]
    if one["errors"] > shown:
        lines.append(f"  ... and {one['errors'] - shown} more")
    return "\n".join(lines), 1
