"""Running sums and extremes of long keys: ranges of the order, what each range carries on, then rows.

A window over a key puts all its rows in one task. Here the order is cut into ranges of about as many rows; each range of a
key is summed up, a window over these few sums gives what comes before a range, and a window within the range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range of the order has as expected, over all keys, and the most ranges.
ROWS, MOST = 200_000, 20_000


def ranges(df: DataFrame, order: str, rows: int = ROWS) -> list[float]:
    """Cuts of the numeric column ``order`` into ranges of about ``rows`` rows, approximate quantiles; none for few rows."""
    n = df.agg(F.count(order)).first()[0]
    parts = min(MOST, -(-n // rows))
    if parts < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]))


def ranged(df: DataFrame, order: str, rows: int = ROWS) -> tuple[DataFrame, str | None]:
    """``df`` with the range of ``order`` as column ``_span``, and that name; as it is, and none, if one range holds all."""
    cuts = ranges(df, order, rows)
    return (df.withColumn("_span", range_of(F.col(order), cuts)), "_span") if cuts else (df, None)


def range_of(order: Column, cuts: list[float]) -> Column:
    """Number of the range that ``order`` falls in; null comes first."""
    if not cuts:
        return F.lit(0)
    return F.when(order.isNull(), 0).otherwise(F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > order)))


def running(df: DataFrame, keys: list[str], order: list[Column | str], span: str | None, values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """``df`` with running values within ``keys`` in ``order``.

    ``span`` names a column that never falls along the order: its ranges are worked on apart. ``values``: for each new column
    (``sum`` | ``max`` | ``min``, what, whether the row itself counts); nulls are passed over, nothing gives null. Without
    ``span`` all is one range, which is a plain window.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    either = {"sum": lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b), "max": F.greatest, "min": F.least}
    if span is None:
        frame = lambda own: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.withColumns({name: kinds[kind](what).over(frame(own)) for name, (kind, what, own) in values.items()})
    source = df.withColumns({f"_v_{name}": what for name, (_, what, _) in values.items()})
    per = source.groupBy(*keys, span).agg(*[kinds[kind](f"_v_{name}").alias(f"_c_{name}") for name, (kind, _, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(span).alias("_k_span"), *[kinds[kind](f"_c_{name}").over(earlier).alias(f"_e_{name}") for name, (kind, _, _) in values.items()])
    same = [source[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = source.join(per, [*same, source[span].eqNullSafe(F.col("_k_span"))])
    out = {}
    for name, (kind, _, own) in values.items():
        frame = Window.partitionBy(*keys, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        out[name] = either[kind](F.col(f"_e_{name}"), kinds[kind](f"_v_{name}").over(frame))
    return joined.withColumns(out).select(*df.columns, *values)
