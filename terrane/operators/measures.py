"""Measures over scopes: funnels, resource equivalents, matched differences, roll-ups and the dimensions of health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FUNNEL = {"CoverageAllocationGap": ("need", "commitment"), "SchedulingCoverageGap": ("commitment", "scheduled"), "ExecutionCoverageGap": ("scheduled", "actual")}


def funnel(need: DataFrame, *steps: DataFrame) -> DataFrame:
    """(scope, subtype, gap): what is lost between neighbouring steps of (scope, need), (scope, commitment), (scope, scheduled)
    and (scope, actual). A scope without a row in a step has 0 there."""
    j = need
    for step in steps:
        j = j.join(step, "scope", "left")
    j = j.fillna(0)
    return j.select("scope", F.explode(F.array(*(F.struct(F.lit(k).alias("subtype"), (F.col(a) - F.col(b)).alias("gap")) for k, (a, b) in FUNNEL.items()))).alias("g")).select("scope", "g.*")


def resource_equivalents(work: DataFrame, capacity: DataFrame) -> DataFrame:
    """Adds equivalent, the workload of each row of ``work`` (archetype, minutes, ...) in units of its archetype's effective capacity
    (archetype, capacity); null where that is unknown or 0."""
    return work.join(capacity, "archetype", "left").withColumn("equivalent", F.when(F.col("capacity") > 0, F.col("minutes") / F.col("capacity")))


def matched_difference(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """One row: difference in differences of ``rows`` (unit, treated, before, after, bucket...) with control units of the same bucket.
    Each treated unit is compared with the mean change of its bucket's control units; units without any don't count."""
    change = rows.withColumn("change", F.col("after") - F.col("before"))
    control = change.where("NOT treated").groupBy(*bucket).agg(F.avg("change").alias("control"), F.count("*").alias("controls"))
    met = change.where("treated").join(control, bucket)
    return met.agg(F.count("*").alias("units"), F.round(F.avg("change"), 6).alias("treated_change"), F.round(F.avg("control"), 6).alias("control_change"), F.round(F.avg(F.col("change") - F.col("control")), 6).alias("effect"))


def ancestors(nodes: DataFrame, depth: int = 16) -> DataFrame:
    """(node, ancestor, up): every node with itself and all above it in ``nodes`` (node, parent). A node may have several
    parents; each ancestor counts once, at its least distance. Goes up to ``depth`` levels, which also ends cycles."""
    out = front = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")).distinct()
    up = nodes.where("parent IS NOT NULL").select(F.col("node").alias("ancestor"), "parent")
    for level in range(1, depth + 1):
        front = front.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(level).alias("up")).distinct()
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out.groupBy("node", "ancestor").agg(F.min("up").alias("up"))


def rolled_up(values: DataFrame, above: DataFrame) -> DataFrame:
    """(ancestor, members, total): values (node, value) summed over each ancestor's distinct nodes."""
    return values.join(above, "node").groupBy("ancestor").agg(F.count_distinct("node").alias("members"), F.sum("value").alias("total"))


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, kept, lost, gained, churn): what changes between two versions of (store_id, owner); churn is the share of rows that
    differ. Stores may have several owners."""
    j = before.distinct().withColumn("b", F.lit(1)).join(after.distinct().withColumn("a", F.lit(1)), ["store_id", "owner"], "full")
    per = j.groupBy("owner").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("gained"))
    return per.withColumn("churn", F.round((F.col("lost") + F.col("gained")) / (F.col("kept") + F.col("lost") + F.col("gained")), 9))


def health_dimensions(kinded: DataFrame, load: DataFrame, capacity: float) -> DataFrame:
    """(district, stores, unassigned, overlap, direct, utilisation, share): per district of ``kinded`` (district, kind) the shares of stores
    that no one, several, and a direct supplier serve; ``load`` (district, load) against ``capacity``, and its share of all loads."""
    share = lambda *kinds: F.round(F.count_if(F.col("kind").isin(*kinds)) / F.count("*"), 9)
    per = kinded.groupBy("district").agg(F.count("*").alias("stores"), share("GAP").alias("unassigned"), share("MULTI").alias("overlap"), share("DIRECT", "DIRECT_IN").alias("direct"))
    total = load.withColumn("share", F.round(F.col("load") / F.sum("load").over(Window.partitionBy()), 9))  # one row a district
    return per.join(total, "district", "left").select(*per.columns, F.round(F.coalesce("load", F.lit(0)) / capacity, 9).alias("utilisation"), F.coalesce("share", F.lit(0.0)).alias("share"))
