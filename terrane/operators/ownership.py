"""Ownership by layered rules, manual overrides and fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import scans
from terrane.session import stored

DIMS = ["province", "city", "channel"]
POOL = "UNASSIGNED"


def specificity(dims: list[str]) -> Column:
    """Number of dimensions that a rule fixes."""
    return sum((F.col(d).isNotNull().cast("int") for d in dims), F.lit(0))


def match_rules(stores: DataFrame, rules: DataFrame, dims: list[str]) -> DataFrame:
    """Stores with every rule that fits: each dimension of a rule is null (any) or equal.

    Rules are split by the set of dimensions they fix, of which there are few; each set is an equi-join on just these.
    """
    out = None
    for mask in range(1 << len(dims)):
        fixed = [d for k, d in enumerate(dims) if mask >> k & 1]
        free = [d for d in dims if d not in fixed]
        some = rules.where(" AND ".join([f"{d} IS NOT NULL" for d in fixed] + [f"{d} IS NULL" for d in free]))
        some = some.select("node_id", "dealer_id", specificity(dims).alias("spec"), *fixed)
        found = (stores.join(some, fixed) if fixed else stores.join(some)).select("store_id", "node_id", "dealer_id", "spec")
        out = found if out is None else out.unionByName(found)
    return out


def rule_assign(stores: DataFrame, rules: DataFrame, dims: list[str]) -> DataFrame:
    """(store_id, node_id, dealer_id, cause): the most specific rule, of equal ones the largest node_id; else the pool.

    Of rules with the same dimensions only the last can win, so they are cut down to it first and written. Then stores meet
    each set of fixed dimensions that occurs in one left join, and the best of what they met is taken row by row.
    """
    fixes = sum((F.col(d).isNotNull().cast("int") * (1 << k) for k, d in enumerate(dims)), F.lit(0))
    last = rules.groupBy(*dims).agg(F.max(F.struct("node_id", "dealer_id")).alias("r"))
    last = stored(last.select(*dims, fixes.alias("mask"), F.struct(specificity(dims).alias("spec"), "r.node_id", "r.dealer_id").alias("r")), "rules")
    met, found = stores.select("store_id", *dims), []
    for mask in sorted(r.mask for r in last.select("mask").distinct().collect()):  # a few sets of dimensions
        fixed = [d for k, d in enumerate(dims) if mask >> k & 1]
        some = last.where(F.col("mask") == mask).select(*fixed, F.col("r").alias(f"_{mask}"))
        met = met.join(some, fixed, "left") if fixed else met.crossJoin(F.broadcast(some))  # one rule fixes nothing
        found.append(F.col(f"_{mask}"))
    best = F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<spec:int,node_id:long,dealer_id:long>")
    met = met.select("store_id", best.alias("b"))
    return met.select("store_id", F.col("b.node_id").alias("node_id"), F.col("b.dealer_id").alias("dealer_id"), F.when(F.col("b").isNull(), POOL).otherwise("RULE").alias("cause"))


def with_overrides(assigned: DataFrame, overrides: DataFrame, excluded: DataFrame) -> DataFrame:
    """Overrides (store_id, to_dealer, actor, reason) replace rule results; excluded stores drop out even if overridden."""
    joined = assigned.join(excluded, "store_id", "left_anti").join(overrides, "store_id", "left")
    manual = F.col("to_dealer").isNotNull()
    return joined.select("store_id", F.when(manual, F.col("to_dealer")).otherwise(F.col("dealer_id")).alias("dealer_id"), F.when(manual, "MANUAL").otherwise(F.col("cause")).alias("cause"), "actor", F.when(manual, F.col("node_id")).alias("overwritten_node_id"))


def override_violations(overrides: DataFrame, dealers: DataFrame) -> DataFrame:
    """(store_id, problem): overrides without actor or reason, or to an unknown dealer; every problem is a row."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    known = dealers.select(F.col("dealer_id").alias("to_dealer"))
    return (
        overrides.where(blank("actor")).select("store_id", F.lit("actor").alias("problem"))
        .unionByName(overrides.where(blank("reason")).select("store_id", F.lit("reason").alias("problem")))
        .unionByName(overrides.join(known, "to_dealer", "left_anti").select("store_id", F.lit("dealer").alias("problem")))
    )


def allocate(kinded: DataFrame, nearest: DataFrame, dealers: DataFrame, excluded: Column) -> DataFrame:
    """(store_id, dealer_id, rule): EXCLUDED, UPSTREAM if that is a dealer, CURRENT_FENCE, NEAREST_CENTROID or UNASSIGNED."""
    known = dealers.select(F.col("dealer_id").alias("upstream"), F.col("dealer_id").alias("up")).distinct()
    j = kinded.join(known, "upstream", "left").join(nearest.select("store_id", F.col("dealer_id").alias("near")), "store_id", "left")
    inside = F.get("dealers", F.lit(0))
    rule = F.when(excluded, "EXCLUDED").when(F.col("up").isNotNull(), "UPSTREAM").when(inside.isNotNull(), "CURRENT_FENCE").when(F.col("near").isNotNull(), "NEAREST_CENTROID").otherwise("UNASSIGNED")
    return j.select("store_id", F.when(~excluded, F.coalesce("up", inside, "near")).alias("dealer_id"), rule.alias("rule"))


def current(assignments: DataFrame) -> DataFrame:
    """The latest row of an append-only history (store_id, dealer_id, created_at, assignment_id)."""
    return assignments.groupBy("store_id").agg(F.max_by("dealer_id", F.struct("created_at", "assignment_id")).alias("dealer_id"))


def replay(log: DataFrame) -> DataFrame:
    """(unit_id, owner): the last writer of each unit in a log (unit_id, seq, owner)."""
    return log.groupBy("unit_id").agg(F.max_by("owner", "seq").alias("owner"))


def orphans(contracts: DataFrame, fences: DataFrame) -> DataFrame:
    """Contracts whose dealer has no fence."""
    return contracts.join(fences.select("dealer_id").distinct(), "dealer_id", "left_anti")


def merged_intervals(intervals: DataFrame, keys: list[str], rows: int = scans.ROWS) -> DataFrame:
    """(keys, s, e): the union of each key's ``intervals`` (keys, start, end) as stretches that don't touch, in seconds. Empty ones and
    those without a start or end are left out. Ranges of time of about ``rows`` rows are worked on apart."""
    iv = intervals.select(*keys, F.col("start").cast("timestamp").cast("double").alias("s"), F.col("end").cast("timestamp").cast("double").alias("e")).where("s < e")
    iv, span = scans.ranged(iv, "s", rows)
    iv = scans.running(iv, keys, ["s", "e"], span, {"_before": ("max", F.col("e"), False)})
    iv = scans.running(iv.withColumn("_new", (F.col("_before").isNull() | (F.col("_before") < F.col("s"))).cast("long")), keys, ["s", "e"], span, {"_nth": ("sum", F.col("_new"), True)})
    return iv.groupBy(*keys, "_nth").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_nth")


def exclusive_conflicts(intervals: DataFrame, rows: int = scans.ROWS) -> DataFrame:
    """(store_id, a, b): owners whose validity intervals (store_id, owner, start, end) overlap.

    Each owner's intervals of a store are merged first. What is left meets by store and bucket of time, wide enough that an
    interval touches two or three buckets as a rule and about 64 at most, so a store with many intervals is met piece by piece.
    """
    iv = stored(merged_intervals(intervals, ["store_id", "owner"], rows), "intervals")
    size = iv.agg(F.avg(F.col("e") - F.col("s")).alias("mean"), F.max(F.col("e") - F.col("s")).alias("most")).first()
    width = max(size.mean or 1.0, (size.most or 0.0) / 64)
    bucket = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width)))
    filed = iv.withColumn("bucket", bucket)
    other = filed.select("store_id", "bucket", F.col("owner").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = filed.withColumnRenamed("owner", "a").join(other, ["store_id", "bucket"]).where("a < b AND s < e2 AND s2 < e")
    return met.select("store_id", "a", "b").distinct()
