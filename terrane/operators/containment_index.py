"""Which texts hold which others: an index of two-character grams, probed by each part's rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    n = F.length(text)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))))


def contained(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole): every two different-or-equal values of column ``part`` of ``parts`` and column ``whole`` of ``wholes`` of which
    the second holds the first. Null and empty values are in no pair.

    A whole is filed under its grams of two characters and under its characters, as many as it is long. A part is looked up
    under the one of its grams that the fewest wholes hold, or under itself if it is one character; what is found is checked.
    A part with a gram that no whole holds isn't looked up at all.
    """
    p, w = parts.select(part).where(F.length(part) > 0).distinct(), wholes.select(whole).where(F.length(whole) > 0).distinct()
    filed = w.select(whole, F.explode(F.concat(grams(F.col(whole), 2), grams(F.col(whole), 1))).alias("gram"))
    held = filed.groupBy("gram").agg(F.count("*").alias("n"))
    own = p.select(part, F.explode(F.when(F.length(part) == 1, F.array(F.col(part))).otherwise(grams(F.col(part), 2))).alias("gram"))
    rare = own.join(held, "gram", "left").groupBy(part).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return rare.select(part, F.col("r.gram").alias("gram")).join(filed, "gram").where(F.contains(whole, part)).select(part, whole)
