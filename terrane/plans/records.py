"""Queries on entity records and on measures over scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import identity as I
from terrane.operators import measures as M
from terrane.plans import aggregates, scenarios
from terrane.plans import containment as P
from terrane.plans.scenarios import Case
from terrane.session import stored, table

# A customer is one record of source a; every second one is a record of source b too, with slips in name, place or contact. The SQL of both:
_A = "SELECT c_custkey * 2 AS record_id, 'a' AS source, c_custkey AS entity, c_name AS name, c_nationkey AS place, CASE WHEN c_custkey % 10 <> 9 THEN round(c_acctbal * 100) END AS contact, c_custkey % 7 AS updated FROM customer"
_B = "SELECT c_custkey * 2 + 1 AS record_id, 'b' AS source, c_custkey AS entity, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, 'Customer', 'Custmer') ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS place, CASE WHEN c_custkey % 8 <> 6 THEN round(c_acctbal * 100) WHEN c_custkey % 24 = 6 THEN -1 END AS contact, c_custkey % 5 AS updated FROM customer WHERE c_custkey % 2 = 0"


def records(spark, d):
    key = F.col("c_custkey")
    c = table(spark, d, "customer").select(key.cast("long").alias("entity"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("place"), F.round(F.col("c_acctbal") * 100).cast("long").alias("contact"))
    entity = F.col("entity")
    a = c.select((entity * 2).alias("record_id"), F.lit("a").alias("source"), "entity", "name", "place", F.when(entity % 10 != 9, F.col("contact")).alias("contact"), (entity % 7).alias("updated"))
    slip = F.when(entity % 3 == 0, F.replace("name", F.lit("Customer"), F.lit("Custmer"))).otherwise(F.col("name"))
    moved = F.when(entity % 5 == 0, (F.col("place") + 1) % 25).otherwise(F.col("place"))
    changed = F.when(entity % 8 != 6, F.col("contact")).when(entity % 24 == 6, F.lit(-1))
    b = c.where(entity % 2 == 0).select((entity * 2 + 1).alias("record_id"), F.lit("b").alias("source"), "entity", slip.alias("name"), moved.alias("place"), changed.cast("long").alias("contact"), (entity % 5).alias("updated"))
    return stored(a.unionByName(b), "records")


def pairs(r):
    return I.candidates(r, {"contact": F.col("contact"), "name": F.concat_ws("-", F.expr("right(name, 9)"), F.col("place"))})


def matched(spark, d):
    r = records(spark, d)
    return r, stored(I.scored(pairs(r), r), "scored")


def clustered(spark, d):
    r, s = matched(spark, d)
    return r, I.clusters(r, s.where("band = 'MATCH'").select("a", "b"))


def versions(spark, d):
    """Order statuses of each customer, valid from the order date and recorded 0 to 20 days later."""
    o = table(spark, d, "orders")
    return o.select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("valid_from"), F.expr("o_orderdate + make_interval(0, 0, 0, o_orderkey % 21)").alias("recorded"), F.col("o_orderstatus").alias("status"))


def known(spark, d):
    """What was known of each customer ten days after each of its orders."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("ask_id"), "o_custkey", F.expr("o_orderdate + interval 10 days").alias("at"))
    return I.as_of(versions(spark, d), asked, "o_custkey", "status")


def funnels(spark, d):
    """Orders as need, priced ones as commitment, those not pending as scheduled, and those shipped in full as actual, by nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("scope")), "o_custkey")
    flags = {"need": F.lit(True), "commitment": F.col("o_totalprice") >= 100000, "scheduled": (F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "P"), "actual": (F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") == "F")}
    return M.funnel(*(o.where(flag).groupBy("scope").agg(F.count("*").alias(k)) for k, flag in flags.items()))


def equivalents(spark, d):
    """Workload of each territory by segment, in units of the segment's capacity: the mean workload of its accounts times 100."""
    w = B.workloads(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("archetype")), "account_id").withColumn("minutes", F.col("calls") * F.col("minutes"))
    capacity = w.groupBy("archetype").agg((F.avg("minutes") * 100).alias("capacity"))
    per = w.groupBy("territory_id", "archetype").agg(F.sum("minutes").alias("minutes"))
    return M.resource_equivalents(per, capacity).select(F.col("territory_id").cast("long").alias("territory_id"), "archetype", "minutes", F.round("equivalent", 6).alias("equivalent"))


def treated(spark, d):
    """Customers of even id as treated, orders before and from 1998 on, matched by nation and segment."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count_if(F.expr("o_orderdate < TIMESTAMP '1998-01-01'")).alias("before"), F.count_if(F.expr("o_orderdate >= TIMESTAMP '1998-01-01'")).alias("after"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 2 == 0).alias("treated"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return M.matched_difference(c.join(o, "unit"), ["nation", "segment"])


def hierarchy(spark, d):
    """Customers below nations, every tenth below a second one too, nations below regions, regions below one root."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    customer, nation, region = (lambda e, p=p: F.concat(F.lit(p), e.cast("string")) for p in ("C", "N", "R"))
    own = c.select(customer(F.col("c_custkey")).alias("node"), nation(F.col("c_nationkey")).alias("parent"))
    second = c.where("c_custkey % 10 = 0").select(customer(F.col("c_custkey")).alias("node"), nation((F.col("c_nationkey") + 1) % 25).alias("parent"))
    up = n.select(nation(F.col("n_nationkey")).alias("node"), region(F.col("n_regionkey")).alias("parent"))
    top = n.select(region(F.col("n_regionkey")).alias("node"), F.lit("ALL").alias("parent")).distinct()
    nodes = own.unionByName(second).unionByName(up).unionByName(top)
    values = c.select(customer(F.col("c_custkey")).alias("node"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return M.rolled_up(values, M.ancestors(nodes)).where("NOT startswith(ancestor, 'C')")


def health(spark, d):
    load = aggregates.loads(spark, d).select(F.col("territory_id").alias("district"), "load")
    return M.health_dimensions(P.kinded(spark, d), load, aggregates.CAPACITY)


def churned(spark, d):
    c = Case(spark, d)
    pair = lambda df: df.select("store_id", F.explode("dealers").alias("owner"))
    return M.churn(pair(c.kinded), pair(scenarios.S.applied(c.kinded, c.moved)))


QUERIES = {
    "m1_block_recall": lambda s, d: (lambda r: I.recall(pairs(r), r.select("record_id", "entity")))(records(s, d)),
    "m2_pair_scores": lambda s, d: matched(s, d)[1],
    "m3_clusters": lambda s, d: clustered(s, d)[1],
    "m4_survivors": lambda s, d: (lambda r, c: I.survivors(r.join(c.select("record_id", "cluster"), "record_id")))(*clustered(s, d)),
    "m5_as_of": known,
    "m6_agreement": lambda s, d: (lambda r, c: I.agreement(c.select("record_id", "cluster").join(r.select("record_id", "entity"), "record_id")))(*clustered(s, d)),
    "m7_coverage_funnel": funnels,
    "m8_resource_equivalent": equivalents,
    "m9_matched_difference": treated,
    "m11_roll_up": hierarchy,
    "m12_health_dimensions": health,
    "m12_churn": churned,
}
_REC = f"SELECT record_id, source, entity, name, CAST(place AS BIGINT) AS place, CAST(contact AS BIGINT) AS contact, updated FROM ({_A} UNION ALL {_B})"
_PAIRS = "SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM rec a JOIN rec b ON a.record_id < b.record_id AND a.source <> b.source AND (a.contact = b.contact OR (right(a.name, 9) = right(b.name, 9) AND a.place = b.place))"
_SCORE = "SELECT a, b, round(0.5::DOUBLE * (1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name), 1)) + 0.2::DOUBLE * coalesce(CAST(x.place = y.place AS INTEGER), 0) + 0.3::DOUBLE * coalesce(CAST(x.contact = y.contact AS INTEGER), 0), 9) AS score FROM pair JOIN rec x ON x.record_id = a JOIN rec y ON y.record_id = b"
_BAND = "SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'MATCH' WHEN score >= 0.55::DOUBLE THEN 'UNCERTAIN' ELSE 'NON_MATCH' END AS band FROM score"
_LABEL = "SELECT record_id, min(root) AS label FROM reach GROUP BY 1"
_REACH = "linked AS (SELECT a, b FROM band WHERE band = 'MATCH' UNION SELECT b, a FROM band WHERE band = 'MATCH'),\nreach AS (SELECT record_id, record_id AS root FROM rec UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.record_id)"
_CLUSTER = "SELECT record_id, label, CASE WHEN conflict THEN record_id ELSE label END AS cluster, conflict FROM (SELECT record_id, label, count(DISTINCT contact) OVER (PARTITION BY label) > 1 AS conflict FROM label JOIN rec USING (record_id))"
_V = {"rec": _REC, "pair": _PAIRS, "score": _SCORE, "band": _BAND, "label": _LABEL, "clus": _CLUSTER}


def _with(body: str, upto: str) -> str:
    names = list(_V)[: list(_V).index(upto) + 1]
    text = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_V[n]})" for n in names)
    return text.replace("label AS (", _REACH + ",\nlabel AS (", 1) + "\n" + body


SQL = {
    "m1_block_recall": _with("SELECT (SELECT count(*) FROM pair) AS pairs, CAST(t AS BIGINT) AS true_pairs, f AS found, round(f / t, 9) AS recall FROM (SELECT count(*) AS t FROM rec WHERE source = 'b'), (SELECT count(*) AS f FROM pair JOIN rec x ON x.record_id = a JOIN rec y ON y.record_id = b WHERE x.entity = y.entity)", "pair"),
    "m2_pair_scores": _with("SELECT * FROM band", "band"),
    "m3_clusters": _with("SELECT * FROM clus", "clus"),
    "m4_survivors": _with("SELECT cluster, count(*) AS records, arg_max(place, (updated, record_id)) AS place, arg_min(contact, (source, record_id)) FILTER (WHERE contact IS NOT NULL) AS contact, any_value(best) AS name FROM clus JOIN rec USING (record_id) JOIN (SELECT cluster, arg_min(name, (-n, name)) AS best FROM (SELECT cluster, name, count(*) AS n FROM clus JOIN rec USING (record_id) GROUP BY 1, 2) GROUP BY 1) USING (cluster) GROUP BY 1", "clus"),
    "m5_as_of": "SELECT a.o_orderkey AS ask_id, a.o_custkey, arg_max(v.o_orderkey, (v.o_orderdate, v.o_orderkey)) AS version, arg_max(v.o_orderstatus, (v.o_orderdate, v.o_orderkey)) AS status FROM orders a LEFT JOIN orders v ON v.o_custkey = a.o_custkey AND v.o_orderdate <= a.o_orderdate + INTERVAL 10 DAY AND v.o_orderdate + to_days(CAST(v.o_orderkey % 21 AS INTEGER)) <= a.o_orderdate + INTERVAL 10 DAY GROUP BY 1, 2",
    "m6_agreement": _with("SELECT round(sum(n * (n - 1) / 2) / sum(n * (c - 1) / 2), 9) AS pair_precision, round(sum(n * (n - 1) / 2) / sum(n * (e - 1) / 2), 9) AS pair_recall, round(sum(n * n / c) / sum(n), 9) AS b3_precision, round(sum(n * n / e) / sum(n), 9) AS b3_recall FROM (SELECT *, sum(n) OVER (PARTITION BY cluster) AS c, sum(n) OVER (PARTITION BY entity) AS e FROM (SELECT cluster, entity, CAST(count(*) AS DOUBLE) AS n FROM clus JOIN rec USING (record_id) GROUP BY 1, 2))", "clus"),
    "m7_coverage_funnel": "WITH f AS (SELECT CAST(c_nationkey AS BIGINT) AS scope, count(*) AS n, count(*) FILTER (WHERE o_totalprice >= 100000) AS c, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P') AS s, count(*) FILTER (WHERE o_totalprice >= 100000 AND o_orderstatus = 'F') AS a FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT scope, 'CoverageAllocationGap' AS subtype, n - c AS gap FROM f UNION ALL SELECT scope, 'SchedulingCoverageGap', c - s FROM f UNION ALL SELECT scope, 'ExecutionCoverageGap', s - a FROM f",
    "m8_resource_equivalent": sql("SELECT CAST(territory_id AS BIGINT) AS territory_id, archetype, minutes, round(minutes / (cap * 100), 6) AS equivalent FROM (SELECT territory_id, c_mktsegment AS archetype, CAST(sum(calls * minutes) AS BIGINT) AS minutes FROM workload JOIN customer ON c_custkey = account_id GROUP BY 1, 2) JOIN (SELECT c_mktsegment AS archetype, avg(calls * minutes) AS cap FROM workload JOIN customer ON c_custkey = account_id GROUP BY 1) USING (archetype)"),
    "m9_matched_difference": "WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS change FROM orders GROUP BY 1), c AS (SELECT c_nationkey, c_mktsegment, c_custkey % 2 = 0 AS treated, change FROM customer JOIN o ON o_custkey = c_custkey) SELECT count(*) AS units, round(avg(change), 6) AS treated_change, round(avg(control), 6) AS control_change, round(avg(change - control), 6) AS effect FROM c JOIN (SELECT c_nationkey, c_mktsegment, avg(change) AS control FROM c WHERE NOT treated GROUP BY 1, 2) USING (c_nationkey, c_mktsegment) WHERE treated",
    "m11_roll_up": "WITH RECURSIVE node AS (SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS parent FROM customer UNION SELECT 'C' || c_custkey, 'N' || ((c_nationkey + 1) % 25) FROM customer WHERE c_custkey % 10 = 0 UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || n_regionkey, 'ALL' FROM nation), up AS (SELECT node, parent AS ancestor FROM node UNION SELECT u.node, n.parent FROM up u JOIN node n ON n.node = u.ancestor) SELECT ancestor, count(DISTINCT node) AS members, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM up JOIN customer ON node = 'C' || c_custkey GROUP BY 1",
    "m12_health_dimensions": sql("SELECT district, count(*) AS stores, round(count(*) FILTER (WHERE kind = 'GAP') / count(*), 9) AS unassigned, round(count(*) FILTER (WHERE kind = 'MULTI') / count(*), 9) AS overlap, round(count(*) FILTER (WHERE kind IN ('DIRECT', 'DIRECT_IN')) / count(*), 9) AS direct, round(coalesce(any_value(load), 0) / 3000.0::DOUBLE, 9) AS utilisation, coalesce(any_value(share), 0.0::DOUBLE) AS share FROM kinded LEFT JOIN (SELECT territory_id AS district, load, round(load / sum(load) OVER (), 9) AS share FROM load) USING (district) GROUP BY 1", load=aggregates._LOAD),
    "m12_churn": sql("SELECT owner, kept, lost, gained, round((lost + gained) / (kept + lost + gained), 9) AS churn FROM (SELECT owner, count(*) FILTER (WHERE a AND b) AS kept, count(*) FILTER (WHERE b AND NOT a) AS lost, count(*) FILTER (WHERE a AND NOT b) AS gained FROM (SELECT coalesce(p.store_id, q.store_id) AS store_id, coalesce(p.dealer_id, q.dealer_id) AS owner, p.dealer_id IS NOT NULL AS b, q.dealer_id IS NOT NULL AS a FROM kept p FULL JOIN (SELECT h.store_id, h.dealer_id FROM kept h LEFT JOIN once o ON o.store_id = h.store_id WHERE o.src IS NULL OR h.dealer_id <> o.src UNION SELECT store_id, dst FROM once) q ON p.store_id = q.store_id AND p.dealer_id = q.dealer_id) GROUP BY 1)", **scenarios._V, once="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY proposal_id) AS r FROM moved) WHERE r = 1"),
}
