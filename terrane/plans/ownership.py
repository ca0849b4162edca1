"""Queries on rules, overrides, allocation, packs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import ownership as O
from terrane.plans import containment as P
from terrane.session import table


def rules(spark, d):
    """Region rules, nation rules and (nation, segment) rules as nodes of one table."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("province"), F.col("n_nationkey").cast("long").alias("city"))
    none = F.lit(None)
    by_region = n.select("province").distinct().select(F.col("province").alias("node_id"), "province", none.cast("long").alias("city"), none.cast("string").alias("channel"))
    by_nation = n.select((F.col("city") + 100).alias("node_id"), "province", "city", none.cast("string").alias("channel"))
    seg = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))))
    by_segment = n.withColumn("c", seg).where("(city + c.k) % 3 = 0").select((F.lit(1000) + F.col("city") * 10 + F.col("c.k")).alias("node_id"), "province", "city", F.col("c.s").alias("channel"))
    return by_region.unionByName(by_nation).unionByName(by_segment).withColumn("dealer_id", F.col("node_id") % 10)


def rule_stores(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_regionkey").cast("long").alias("province"))
    s = B.stores(spark, d).join(n, "district")
    return s.where("store_id % 13 <> 0").select("store_id", "province", F.col("district").cast("long").alias("city"), "channel").unionByName(s.where("store_id % 13 = 0").select("store_id", (F.col("province") + 50).alias("province"), F.col("district").cast("long").alias("city"), "channel"))


def assigned(spark, d):
    return O.rule_assign(rule_stores(spark, d), rules(spark, d), O.DIMS)


def overrides(spark, d):
    return B.stores(spark, d).where("store_id % 37 = 0").select("store_id", (F.col("store_id") % 7).alias("to_dealer"), F.when(F.col("store_id") % 74 == 0, "planner").otherwise("").alias("actor"), F.when(F.col("store_id") % 111 == 0, "").otherwise("requested").alias("reason"))


def excluded(spark, d):
    return B.stores(spark, d).where("store_id % 41 = 0").select("store_id")


def allocation(spark, d):
    return O.allocate(P.kinded(spark, d), P.nearest_dealer(spark, d), B.dealers(spark, d), F.col("store_id") % 41 == 0)


def history(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("store_id"), (F.col("o_orderkey") % 10).alias("dealer_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("assignment_id"))


def contracts(spark, d):
    s = table(spark, d, "supplier")
    return s.select((F.col("s_suppkey") * 2).alias("dealer_id"), F.col("s_nationkey").alias("district"))


def listing(spark, d):
    f = B.fences(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("dealer_id"), F.col("s_nationkey").alias("district")), "dealer_id").groupBy("district").agg(F.count("*").alias("fences"))
    return f.join(B.stores(spark, d).groupBy("district").agg(F.count("*").alias("stores")), "district", "full").select("district", F.coalesce("fences", F.lit(0)).alias("fences"), F.coalesce("stores", F.lit(0)).alias("stores"))


def dossier(spark, d):
    """Per dealer: components, area, stores in its fences and its contract's district."""
    held = P.store_fence(spark, d).select("dealer_id", "store_id").distinct().groupBy("dealer_id").agg(F.count("*").alias("stores"), F.array_join(F.sort_array(F.collect_list("store_id")).cast("array<string>"), ",").alias("store_list"))  # a dealer's own stores
    return P.dealer_area(spark, d).join(held, "dealer_id", "left").join(contracts(spark, d), "dealer_id", "left").select("dealer_id", "components", F.round("area_km2", 6).alias("area_km2"), F.coalesce("stores", F.lit(0)).alias("stores"), F.coalesce("store_list", F.lit("")).alias("store_list"), "district")


def ledger(spark, d):
    """Instructions (nation by nation) over units of the streets that they name; the last one wins."""
    log = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS seq", "CAST(n_regionkey AS BIGINT) AS owner", "explode(sequence(n_nationkey * 3, n_nationkey * 3 + 9)) AS street")
    return O.replay(log.join(B.units(spark, d).select("street", "unit_id"), "street").select("unit_id", "seq", "owner"))


def upsert(spark, d):
    """Compiled rows where odd dealers are replaced and new ones appended."""
    old = B.dealers(spark, d).select("dealer_id", F.col("h").alias("size"), F.lit(1).alias("version"))
    new = old.where("dealer_id % 2 = 1").select("dealer_id", (F.col("size") + 1).alias("size"), F.lit(2).alias("version")).unionByName(old.select((-F.col("dealer_id") - 1).alias("dealer_id"), "size", F.lit(2).alias("version")))
    return old.join(new, "dealer_id", "left_anti").unionByName(new)


def conflicts(spark, d):
    o = table(spark, d, "orders")
    return O.exclusive_conflicts(o.select(F.col("o_custkey").alias("store_id"), (F.col("o_orderkey") % 5).alias("owner"), F.col("o_orderdate").alias("start"), F.expr("o_orderdate + interval 30 days").alias("end")))


QUERIES = {
    "p17_specificity": lambda s, d: rules(s, d).select("node_id", O.specificity(O.DIMS).alias("spec")),
    "j3_rule_match": lambda s, d: O.match_rules(rule_stores(s, d), rules(s, d), O.DIMS),
    "w1_rule_assign": assigned,
    "j4_overrides": lambda s, d: O.with_overrides(assigned(s, d), overrides(s, d), excluded(s, d)),
    "j4_override_violations": lambda s, d: O.override_violations(overrides(s, d), B.dealers(s, d)),
    "j5_allocation": allocation,
    "r10_current_assignment": lambda s, d: O.current(history(s, d)),
    "j15_orphan_contracts": lambda s, d: O.orphans(contracts(s, d), B.fences(s, d)),
    "s11_region_listing": listing,
    "s13_dossier": dossier,
    "s14_upsert": upsert,
    "g9_ledger_replay": ledger,
    "a31_ledger_summary": lambda s, d: ledger(s, d).groupBy("owner").agg(F.count("*").alias("units")),
    "m10_exclusive_conflicts": conflicts,
}
_RULES = "SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS node_id, CAST(n_regionkey AS BIGINT) AS province, CAST(NULL AS BIGINT) AS city, CAST(NULL AS VARCHAR) AS channel FROM nation UNION ALL SELECT n_nationkey + 100, n_regionkey, n_nationkey, NULL FROM nation UNION ALL SELECT 1000 + n_nationkey * 10 + k, n_regionkey, n_nationkey, s FROM nation, (VALUES (0,'AUTOMOBILE'),(1,'BUILDING'),(2,'FURNITURE'),(3,'HOUSEHOLD'),(4,'MACHINERY')) v(k, s) WHERE (n_nationkey + k) % 3 = 0"
_STORES = "SELECT store_id, CAST(n_regionkey + CASE WHEN store_id % 13 = 0 THEN 50 ELSE 0 END AS BIGINT) AS province, CAST(district AS BIGINT) AS city, channel FROM store JOIN nation ON n_nationkey = district"
_MATCH = "SELECT store_id, node_id, node_id % 10 AS dealer_id, CAST(r.province IS NOT NULL AS INTEGER) + CAST(r.city IS NOT NULL AS INTEGER) + CAST(r.channel IS NOT NULL AS INTEGER) AS spec FROM rstore s JOIN rule r ON (r.province IS NULL OR r.province = s.province) AND (r.city IS NULL OR r.city = s.city) AND (r.channel IS NULL OR r.channel = s.channel)"
_ASSIGN = "SELECT s.store_id, node_id, dealer_id, CASE WHEN node_id IS NULL THEN 'UNASSIGNED' ELSE 'RULE' END AS cause FROM rstore s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY spec DESC, node_id DESC) AS r FROM matched) WHERE r = 1) USING (store_id)"
_OVER = "SELECT store_id, store_id % 7 AS to_dealer, CASE WHEN store_id % 74 = 0 THEN 'planner' ELSE '' END AS actor, CASE WHEN store_id % 111 = 0 THEN '' ELSE 'requested' END AS reason FROM store WHERE store_id % 37 = 0"
_R = {"rule": _RULES, "rstore": _STORES, "matched": _MATCH, "assigned": _ASSIGN, "override": _OVER}
_LEDGER = "SELECT unit_id, arg_max(owner, seq) AS owner FROM (SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_regionkey AS BIGINT) AS owner, unnest(range(n_nationkey * 3, n_nationkey * 3 + 10)) AS street FROM nation) JOIN unit USING (street) GROUP BY 1"
SQL = {
    "p17_specificity": sql("SELECT node_id, CAST(province IS NOT NULL AS INTEGER) + CAST(city IS NOT NULL AS INTEGER) + CAST(channel IS NOT NULL AS INTEGER) AS spec FROM rule", **_R),
    "j3_rule_match": sql("SELECT * FROM matched", **_R),
    "w1_rule_assign": sql("SELECT * FROM assigned", **_R),
    "j4_overrides": sql("SELECT store_id, coalesce(to_dealer, dealer_id) AS dealer_id, CASE WHEN to_dealer IS NOT NULL THEN 'MANUAL' ELSE cause END AS cause, actor, CASE WHEN to_dealer IS NOT NULL THEN node_id END AS overwritten_node_id FROM assigned LEFT JOIN override USING (store_id) WHERE store_id % 41 <> 0", **_R),
    "j4_override_violations": sql("SELECT store_id, 'actor' AS problem FROM override WHERE actor = '' UNION ALL SELECT store_id, 'reason' FROM override WHERE reason = '' UNION ALL SELECT store_id, 'dealer' FROM override WHERE to_dealer NOT IN (SELECT dealer_id FROM dealer)", **_R),
    "j5_allocation": sql("SELECT k.store_id, CASE WHEN k.store_id % 41 <> 0 THEN coalesce(d.dealer_id, k.first_dealer, n.dealer_id) END AS dealer_id, CASE WHEN k.store_id % 41 = 0 THEN 'EXCLUDED' WHEN d.dealer_id IS NOT NULL THEN 'UPSTREAM' WHEN k.first_dealer IS NOT NULL THEN 'CURRENT_FENCE' WHEN n.dealer_id IS NOT NULL THEN 'NEAREST_CENTROID' ELSE 'UNASSIGNED' END AS rule FROM kinded k LEFT JOIN dealer d ON d.dealer_id = k.upstream LEFT JOIN near n ON n.store_id = k.store_id", near=P._POOLED),
    "r10_current_assignment": "SELECT o_custkey AS store_id, arg_max(o_orderkey % 10, (o_orderdate, o_orderkey)) AS dealer_id FROM orders GROUP BY 1",
    "j15_orphan_contracts": "SELECT s_suppkey * 2 AS dealer_id, s_nationkey AS district FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)",
    "s11_region_listing": sql("SELECT district, coalesce(fences, 0) AS fences, coalesce(stores, 0) AS stores FROM (SELECT s_nationkey AS district, count(*) AS fences FROM (SELECT DISTINCT dealer_id, comp FROM fence_vertex) JOIN supplier ON s_suppkey = dealer_id GROUP BY 1) FULL JOIN (SELECT district, count(*) AS stores FROM store GROUP BY 1) USING (district)"),
    "s13_dossier": sql("SELECT a.dealer_id, components, round(area_km2, 6) AS area_km2, coalesce(stores, 0) AS stores, coalesce(store_list, '') AS store_list, c.district FROM (SELECT dealer_id, sum(area_km2) AS area_km2, count(*) AS components FROM area GROUP BY 1) a LEFT JOIN (SELECT dealer_id, count(*) AS stores, string_agg(store_id, ',' ORDER BY store_id) AS store_list FROM (SELECT DISTINCT dealer_id, store_id FROM held) GROUP BY 1) USING (dealer_id) LEFT JOIN (SELECT s_suppkey * 2 AS dealer_id, s_nationkey AS district FROM supplier) c USING (dealer_id)"),
    "s14_upsert": sql("SELECT dealer_id, h + dealer_id % 2 AS size, CAST(1 + dealer_id % 2 AS INTEGER) AS version FROM dealer UNION ALL SELECT -dealer_id - 1, h, 2 FROM dealer"),
    "g9_ledger_replay": sql(_LEDGER),
    "a31_ledger_summary": sql("SELECT owner, count(*) AS units FROM led GROUP BY 1", led=_LEDGER),
    "m10_exclusive_conflicts": "WITH v AS (SELECT o_custkey AS store_id, o_orderkey % 5 AS owner, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e FROM orders) SELECT DISTINCT a.store_id, a.owner AS a, b.owner AS b FROM v a JOIN v b ON a.store_id = b.store_id AND a.owner < b.owner AND a.s < b.e AND b.s < a.e",
}
