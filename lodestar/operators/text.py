"""Substring search and suffix order of bounded texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, pattern: str) -> Column:
    """Ascending 0-based starts, overlaps included; the empty pattern starts everywhere."""
    n = F.length(text)
    if not pattern:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # cut before each occurrence: one pass over the text, then starts are running sums of the pieces' lengths
    pieces = F.transform(F.split(text, f"(?=\\Q{pattern}\\E)"), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    sums = F.aggregate(pieces, start, lambda acc, k: F.struct((acc["at"] + k).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])
    return F.when(text.startswith(pattern), sums).otherwise(F.slice(sums, 2, F.greatest(F.size(sums) - 1, F.lit(0))))


def count_occurrences(text: Column, pattern: str) -> Column:
    return F.length(text) if not pattern else F.regexp_count(text, F.lit(f"(?=\\Q{pattern}\\E)"))


def suffixes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, start, suffix) in suffix order within each text, sorted inside the text's own array."""
    n = F.length(text)
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(F.col(text), i, n).alias("suffix"), (i - 1).alias("start"))))
    rows = texts.where(n > 0).select(key, F.posexplode(pairs).alias("place", "s"))
    return rows.select(key, "place", "s.start", "s.suffix")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix: the first place where the texts differ."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))
