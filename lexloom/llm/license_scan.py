"""License scans by diagonal voting, in DataFrame operations only.

Every rolling K-word gram of a text is joined, by hash and then by value, to the template positions that hold it. Hits
are counted by template and diagonal (text position minus template position); neighbouring diagonals merge, as words
added or lost shift them; a span is verified by the share of the template's grams on it and by its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals no further apart than this belong to one span.
DRIFT = 2
#: A span of the method's own templates counts from this share of the template's grams on, or with a changed word for
#: each WORDS_A_CHANGE of the template's (one at least), each of which breaks K grams.
MIN_SHARE, WORDS_A_CHANGE = 0.7, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_NOTICE = "you can redistribute it and or modify it under the terms of the gnu {}general public license"
_FULL = "this {} is free software " + _NOTICE + " as published by the free software foundation either version 3 of the license or at your option any later version"
_CC = "licensed under a creative commons attribution {} {} license"

# Base phrases with their labels, then the method's own template texts, with the grams that must be there
# because they tell a license from its kin.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
OWN = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public", "license version 3")),
    (_NOTICE.format(""), "gpl", ("gnu general public",)),
    (_NOTICE.format("lesser "), "lgpl", ("gnu lesser general",)),
    (_NOTICE.format("affero "), "agpl", ("gnu affero general",)),
    (_FULL.format("program", ""), "gpl-3", ("gnu general public", "either version 3")),
    (_FULL.format("library", "lesser "), "lgpl-3", ("gnu lesser general", "either version 3")),
    (_FULL.format("program", "affero "), "agpl-3", ("gnu affero general", "either version 3")),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3", ("gnu lesser general", "license version 3")),
    ("licensed under the gnu affero general public license version 3", "agpl-3", ("gnu affero general", "license version 3")),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ()),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache-2", ("license version 2",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ()),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2", ("mozilla public license",)),
    ("licensed under the creative commons attribution noncommercial license", "cc-by-nc", ("attribution noncommercial license",)),
    ("licensed under the creative commons attribution sharealike license", "cc-by-sa", ("attribution sharealike license",)),
    *((_CC.format(kind, version), label, (f"commons attribution {kind.split()[0]}", f"{kind.split()[-1]} {version[:3]}")) for version in ("4 0 international", "3 0 unported") for kind, label in (("noncommercial", "cc-by-nc"), ("sharealike", "cc-by-sa"), ("noncommercial sharealike", "cc-by-nc-sa"), ("noderivatives", "cc-by-nd"))),
    ("this work is dedicated to the public domain", "public-domain", ("the public domain",)),
    ("all rights reserved", "all-rights-reserved", ()),
]


def _templates(spark: SparkSession) -> DataFrame:
    """A row for each K-gram position of each template; some hundred rows, so it can be broadcast."""
    rows = []
    for i, (phrase, label, must) in enumerate([(*b, ()) for b in BASE] + OWN):
        words = phrase.split()
        for at in range(len(words) - K + 1):
            gram = " ".join(words[at : at + K])
            bit = 1 << must.index(gram) if gram in must else 0
            rows.append((gram, i, label, i < len(BASE), at, len(words), bit, (1 << len(must)) - 1))
    return spark.createDataFrame(rows, "gram string, template int, label string, base boolean, at int, size int, bit int, must int").withColumn("h", F.xxhash64("gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base (places of base phrases), first_word and last_word (least and
    largest start of one, else null), base_labels, labels (sorted, comma-joined, "" for none), score (the best share
    of a template found, 1 for a base phrase) and spans (label, start, words, share).

    Null and empty texts have no words. Repeated rows and null ids each give their row; other columns are ignored; an
    empty table gives an empty result. Overlapping places of a phrase all count.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), upper, lower)
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    joined = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"))
    rolling = F.regexp_extract_all("t", F.lit(r"(?<= )(?=((?:[^ ]+ ){%d}[^ ]+) )" % (K - 1)), F.lit(1))
    grams = joined.select("doc_id", "row", "n_words", F.posexplode_outer(rolling).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    # The outer join keeps the documents without a hit; its misses fall together in the first, map-side, aggregation.
    t = F.broadcast(_templates(docs.sparkSession)).withColumnRenamed("gram", "tgram")
    hits = grams.join(t, (grams["h"] == t["h"]) & (grams["gram"] == t["tgram"]), "left")
    key = ["row", "doc_id", "n_words", "template", "label", "base", "size", "must"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("at").alias("hits"), F.bit_or("bit").alias("bits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = votes.withColumn("new", (F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > DRIFT)).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*key, "run").agg(F.sum("hits").alias("hits"), F.bit_or("bits").alias("bits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("start"))
    grams_of = F.col("size") - (K - 1)
    share = F.least(F.lit(1.0), F.col("hits") / grams_of)
    changes = F.greatest(F.lit(1), F.floor(F.col("size") / WORDS_A_CHANGE))
    near = (share >= MIN_SHARE) | (F.col("hits") >= F.greatest(F.lit(1), grams_of - K * changes))
    length = F.col("hi") - F.col("lo") + K
    found = F.when(F.col("base"), F.col("hits") == F.col("size") - (K - 1)).otherwise(near & (F.col("bits") == F.col("must")) & (length <= 1.5 * F.col("size") + DRIFT))
    spans = spans.withColumn("share", share).withColumn("found", F.coalesce(found, F.lit(False)))
    base = F.col("found") & F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("start", "label", length.alias("words"), "share")))).alias("spans"),
    ).drop("row")
