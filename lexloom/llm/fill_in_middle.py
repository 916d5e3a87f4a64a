"""Fill-in-middle transformation in Spark SQL functions: cut a text in three, arrange the parts under sentinels, parse
them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import columns_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
#: A unit is a word with the white space before it, or the white space that ends a text.
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _hash_words(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed:id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output) of each row, form being plain, psm or spm.

    n counts units. Cuts and forms depend on seed and id only, so rows that share an id and a text are cut alike, and a
    null id hashes as no digits. Null texts count as empty; bytes that are no UTF-8 become U+FFFD first. A text that is
    empty or holds a sentinel stays plain: its parts are null and its output is the text. An empty table gives an empty
    result; other columns are left out, whatever their names."""
    id_, text = columns_of(docs, [id_col, text_col])
    rows = docs.select(id_.alias("id"), F.make_valid_utf8(F.coalesce(text, F.lit(""))).alias("text"))
    h = _hash_words(seed, F.col("id"))
    holds = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | holds | (h[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    units = rows.select("id", "text", F.regexp_extract_all("text", F.lit(_UNIT), F.lit(0)).alias("u"), form.alias("form"))
    a, b = h[0] % (F.size("u") + 1), h[1] % (F.size("u") + 1)
    cuts = units.select("id", "text", "u", "form", F.size("u").cast("long").alias("n"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("u", start + 1, length), ""))

    parts = cuts.select("id", "text", "n", "form", part(F.lit(0), F.col("a")).alias("prefix"), part(F.col("a"), F.col("b") - F.col("a")).alias("middle"), part(F.col("b"), F.greatest(F.size("u") - F.col("b"), F.lit(0))).alias("suffix"))
    p, s, m = (F.concat(F.lit(x), F.col(c)) for x, c in ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("text"))
    return parts.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its sentinels and its form; null for an unknown form or a null."""
    parts = F.split(output, _SENTINEL, -1)
    join = lambda *order: F.array_join(F.array(*[F.get(parts, i) for i in order]), "")
    return F.when(form == "plain", output).when(form == "psm", join(1, 3, 2)).when(form == "spm", join(2, 3, 1))


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text restored from it."""
    cut = fill_in_middle(docs, id_col, text_col, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(id_col, "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
