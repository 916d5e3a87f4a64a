"""Equality of tables as multisets, and what is different."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checked(a: DataFrame, b: DataFrame) -> list[str]:
    kinds = lambda df: {n.lower(): t for n, t in df.dtypes}
    if kinds(a) != kinds(b):
        raise ValueError(f"different columns: {sorted(kinds(a).items())} and {sorted(kinds(b).items())}")
    return sorted(a.columns, key=str.lower)


def _row_text(names: list[str]) -> F.Column:
    """A row as text, nulls and all, the columns by name; different rows never look alike."""
    return F.to_json(F.struct(*[F.col(f"`{n}`").alias(n.lower()) for n in names]), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, names: list[str] | None = None) -> tuple:
    """(rows, sum, sum): counts and sums of two 64-bit hashes of the rows, so the order of rows makes no difference and
    their number does. Two numbers for each task are all that travels."""
    text = _row_text(sorted(df.columns, key=str.lower) if names is None else names)
    two = df.select(F.xxhash64(text).alias("x"), F.xxhash64(F.lit("again"), text).alias("y"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0))
    return tuple(two.agg(F.count("*"), total("x"), total("y")).first())


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a with n: how many more a holds than b (less than 0: b holds more); none where they are equal.
    Counts are summed before they travel, so a frequent row is one row of each task."""
    names = _checked(a, b)
    both = a.select(*names, F.lit(1).alias("__n")).unionByName(b.select(*names, F.lit(-1).alias("__n")))
    return both.groupBy(*names).agg(F.sum("__n").alias("n")).where("n <> 0")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether a and b hold the same rows as often. One pass over each where their fingerprints agree; else rows are
    compared, as values that look different may be equal, such as 0.0 and -0.0."""
    names = _checked(a, b)
    one, two = fingerprint(a, names), fingerprint(b, names)
    if one == two:
        return True
    return one[0] == two[0] and multiset_difference(a, b).isEmpty()
