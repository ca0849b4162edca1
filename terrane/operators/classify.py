"""Store kinds, coverage, dealer health and gap classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.spatial import contain

#: A dealer's verdict: above OOF_LIMIT out-of-fence share it is looked into, from OK_LIMIT on it is healthy.
OOF_LIMIT, OK_LIMIT = 0.20, 0.79
LOOK_INTO, HEALTHY, WATCH = "调查", "健康", "观察"


def store_dealers(stores: DataFrame, fences: DataFrame) -> DataFrame:
    """``stores`` (store_id, x, y, ...) with dealers: the sorted distinct dealers whose fences hold the store."""
    pairs = contain(stores.select("store_id", "x", "y"), fences, ["dealer_id"]).select("store_id", "dealer_id").distinct()
    per = pairs.groupBy("store_id").agg(F.sort_array(F.collect_list("dealer_id")).alias("dealers"))  # fences over one point
    return stores.join(per, "store_id", "left").withColumn("dealers", F.coalesce("dealers", F.array().cast("array<bigint>")))


def with_upstream(held: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Adds upstream: null for every 11th store, else the lowest holding dealer for two of three, else the main supplier."""
    known = held.join(suppliers, "store_id", "left")
    own = F.when((F.col("store_id") % 3 != 0) & (F.size("dealers") > 0), F.get("dealers", F.lit(0))).otherwise(F.col("supplier"))
    return known.withColumn("upstream", F.when(F.col("store_id") % 11 != 0, own)).drop("supplier")


def kind(dealers: Column, direct: Column, upstream: Column) -> Column:
    """Six kinds, first match wins; an unknown upstream inside one fence is out of fence."""
    return (
        F.when(F.size(dealers) > 1, "MULTI")
        .when(F.size(dealers) == 0, F.when(direct, "DIRECT").otherwise("GAP"))
        .when(direct, "DIRECT_IN")
        .when(upstream == F.get(dealers, F.lit(0)), "OK")
        .otherwise("OOF")
    )


def is_direct(upstream: Column, markers: list[str]) -> Column:
    """True if any marker is a part of the upstream name."""
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.coalesce(upstream, F.lit("")), m))


def kind_counts(kinded: DataFrame) -> DataFrame:
    return kinded.groupBy("kind").agg(F.count("*").alias("n"))


def coverage(kinded: DataFrame) -> DataFrame:
    """One row: counts of the older five-way analysis, where a store may count twice, and both coverage rates."""
    inside = F.size("dealers") > 0
    multi = F.size("dealers") > 1
    out = inside & ~F.coalesce(F.array_contains("dealers", F.col("upstream")), F.lit(True))
    counts = kinded.agg(
        F.count("*").alias("n"),
        F.count_if(inside & ~out).alias("ok"),
        F.count_if(~inside & F.col("direct")).alias("normal_direct"),
        F.count_if(~inside & ~F.col("direct")).alias("real_gap"),
        F.count_if(multi).alias("multi"),
        F.count_if(out).alias("out_of_fence"),
        F.count_if(inside).alias("inside"),
    )
    return counts.select("*", F.round((F.col("ok") + F.col("multi") + F.col("out_of_fence")) / F.col("n"), 9).alias("legacy_rate"), F.round(F.col("inside") / F.col("n"), 9).alias("coverage_rate"))


def out_of_fence_by_upstream(kinded: DataFrame) -> DataFrame:
    return kinded.where("kind = 'OOF'").groupBy("upstream").agg(F.count("*").alias("n"))


def gap_by_district(kinded: DataFrame) -> DataFrame:
    return kinded.where("kind = 'GAP'").groupBy("district").agg(F.count("*").alias("n"))


def dealer_stores(kinded: DataFrame) -> DataFrame:
    """A row for each dealer and store held."""
    return kinded.withColumn("dealer_id", F.explode("dealers"))


def health(kinded: DataFrame, area: DataFrame) -> DataFrame:
    """Per dealer with an area (dealer_id, area_km2): stores, kind mix, rates, verdict and density."""
    per = dealer_stores(kinded).groupBy("dealer_id").agg(F.count("*").alias("stores"), *(F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("OK", "OOF", "MULTI", "DIRECT_IN")))
    zero = {c: 0 for c in ("stores", "n_ok", "n_oof", "n_multi", "n_direct_in")}
    per = area.join(per, "dealer_id", "left").fillna(zero)
    rate = lambda c: F.when(F.col("stores") > 0, F.col(c) / F.col("stores")).otherwise(0.0)
    per = per.withColumn("ok_rate", rate("n_ok")).withColumn("oof_rate", rate("n_oof"))
    verdict = F.when(F.col("oof_rate") > OOF_LIMIT, LOOK_INTO).when(F.col("ok_rate") >= OK_LIMIT, HEALTHY).otherwise(WATCH)
    return per.select("dealer_id", "stores", "n_ok", "n_oof", "n_multi", "n_direct_in", F.round("ok_rate", 9).alias("ok_rate"), F.round("oof_rate", 9).alias("oof_rate"), verdict.alias("verdict"), F.round(F.col("stores") / F.col("area_km2"), 6).alias("density"))


def top_district(kinded: DataFrame) -> DataFrame:
    """(dealer_id, district, purity): the commonest district of a dealer's stores, lowest on a tie, and its share."""
    counts = dealer_stores(kinded).groupBy("dealer_id", "district").agg(F.count("*").alias("n"))
    return counts.groupBy("dealer_id").agg(F.max_by("district", F.struct("n", -F.col("district"))).alias("district"), F.round(F.max("n") / F.sum("n"), 9).alias("purity"))


def health_ranking(healths: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` dealers to look at first: those to look into, then by falling out-of-fence rate, then by id."""
    first = (F.col("verdict") == LOOK_INTO).cast("int")
    return healths.orderBy(F.desc(first), F.desc("oof_rate"), "dealer_id").limit(n)


def one_per_dealer(fences: DataFrame) -> DataFrame:
    """The first component of each dealer."""
    w = Window.partitionBy("dealer_id").orderBy("comp")
    return fences.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def gap_classes(kinded: DataFrame, nearest: DataFrame, dealers: DataFrame, far_km: float = 5.0) -> DataFrame:
    """GAP stores as (store_id, district, class, layer, structural, nearest_km): without upstream (layer DATA), with a fence
    dealer upstream, or other (layer D); structural if the nearest fence centroid, to two decimals, is more than ``far_km``
    away. Without any fence nearest_km is null and nothing is structural."""
    known = dealers.select(F.col("dealer_id").alias("upstream")).distinct().withColumn("is_dealer", F.lit(True))
    gaps = kinded.where("kind = 'GAP'").join(known, "upstream", "left").join(nearest.select("store_id", F.round("km", 2).alias("nearest_km")), "store_id", "left")
    named = F.when(F.col("upstream").isNull(), "no_upstream").when(F.col("is_dealer"), "dealer_outside").otherwise("other_upstream")
    structural = F.coalesce(F.col("nearest_km") > far_km, F.lit(False))
    return gaps.select("store_id", "district", named.alias("class"), F.when(F.col("upstream").isNull(), "DATA").otherwise("D").alias("layer"), structural.alias("structural"), "nearest_km")


def gap_summary(classed: DataFrame) -> DataFrame:
    """Counts by class, by layer, by district, by structural flag, and in all: one row per group with its grouping."""
    out = classed.groupingSets([["class"], ["layer"], ["district"], ["structural"], []], "class", "layer", "district", "structural").agg(F.grouping_id().cast("int").alias("g"), F.count("*").alias("n"))
    return out.select("g", "class", "layer", "district", "structural", "n")


def conflicts(kinded: DataFrame, n: int = 5) -> DataFrame:
    """OOF, MULTI and GAP: how many, and the first ``n`` store ids."""
    w = Window.partitionBy("kind").orderBy("store_id")
    rows = kinded.where(F.col("kind").isin("OOF", "MULTI", "GAP"))
    head = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list("store_id")), lambda x: x.cast("string")), ",").alias("head"))  # n at most
    return rows.groupBy("kind").agg(F.count("*").alias("n")).join(head, "kind")
