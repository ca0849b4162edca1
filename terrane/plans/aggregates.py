"""Queries on workload, balance, quantiles, occupancy, overlap and adjacency."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import scores as Q
from terrane.operators import sizing as Z
from terrane.operators import spatial as S
from terrane.session import stored, table

CAPACITY = 3000.0


def loads(spark, d):
    return Z.loads(B.workloads(spark, d))


def occupancy(spark, d):
    """Distinct grid cells and stores per dealer, dealers of two cells or more."""
    held = S.contain(B.stores(spark, d), B.fences(spark, d), ["dealer_id"])
    cell = F.struct(F.floor(F.col("x") / 5000), F.floor(F.col("y") / 5000))
    return held.groupBy("dealer_id").agg(F.count_distinct(cell).alias("cells"), F.count_distinct("store_id").alias("stores")).where("cells >= 2")


def unit_truth(spark, d):
    return S.contain(B.units(spark, d).select("unit_id", "x", "y"), B.fences(spark, d), ["dealer_id", "comp"]).select("unit_id", "dealer_id").distinct()


def composed(units, truth):
    """(dealer_id, street, share, tag): share of each street's ``units`` that a dealer holds by ``truth``, with its tag."""
    total = units.groupBy("street").agg(F.count("*").alias("total"))
    own = truth.join(units.select("unit_id", "street"), "unit_id").groupBy("dealer_id", "street").agg(F.count("*").alias("n")).join(total, "street")
    share = F.col("n") / F.col("total")
    tag = F.when(share > 0.95, "全部").when(share >= 0.6, "大部").when(share >= 0.3, "约半").otherwise(F.concat(F.lit("约"), F.bround(share * 100).cast("int").cast("string"), F.lit("%")))
    return own.select("dealer_id", "street", F.round(share, 9).alias("share"), tag.alias("tag"))


def compose(spark, d):
    return composed(B.units(spark, d), unit_truth(spark, d))


def overlap(spark, d):
    """Predicted units (those of streets held by 30 % or more) against true ones, per dealer. Units and truth are written once."""
    units = stored(B.units(spark, d).select("unit_id", "street", "x", "y"), "units")
    truth = stored(S.contain(units.select("unit_id", "x", "y"), B.fences(spark, d), ["dealer_id", "comp"]).select("unit_id", "dealer_id").distinct(), "truth")
    predicted = composed(units, truth).where("share >= 0.3").select("dealer_id", "street").join(units.select("street", "unit_id"), "street").select("dealer_id", "unit_id")
    rows = predicted.withColumns({"p": F.lit(1), "t": F.lit(0)}).unionByName(truth.select("dealer_id", "unit_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    both = rows.groupBy("dealer_id", "unit_id").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    s = both.groupBy("dealer_id").agg(F.count_if((F.col("p") > 0) & (F.col("t") > 0)).alias("hit"), F.count_if(F.col("t") == 0).alias("over"), F.count_if(F.col("p") == 0).alias("miss"))
    return s.select("*", F.round(F.when(F.col("hit") + F.col("over") > 0, F.col("hit") / (F.col("hit") + F.col("over"))), 9).alias("precision"), F.round(F.col("hit") / (F.col("hit") + F.col("miss")), 9).alias("recall"), F.round(F.col("hit") / (F.col("hit") + F.col("over") + F.col("miss")), 9).alias("jaccard"))


def nearest_rank(spark, d):
    """Nearest-rank quantiles of order values per priority: the element at floor((n - 1) p)."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    high = o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") >= 250000).alias("high"))
    return Q.quantiles(o, "o_orderpriority", "o_totalprice", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, 1000.0).join(high, "o_orderpriority")


def adjacency(spark, d):
    """Dealers of whose fences, all components, boxes overlap."""
    b = S.with_box(B.fences(spark, d))
    cell = 100_000
    down = lambda c: F.floor(F.col(c) / cell)
    filed = b.withColumn("kx", F.explode(F.sequence(down("bx0"), down("bx1")))).withColumn("ky", F.explode(F.sequence(down("by0"), down("by1")))).select("dealer_id", "bx0", "by0", "bx1", "by1", "kx", "ky")
    o = filed.select("kx", "ky", *(F.col(c).alias(f"o_{c}") for c in ("dealer_id", "bx0", "by0", "bx1", "by1")))
    near = filed.join(o, ["kx", "ky"]).where("dealer_id < o_dealer_id AND bx0 <= o_bx1 AND o_bx0 <= bx1 AND by0 <= o_by1 AND o_by0 <= by1")
    return near.select(F.col("dealer_id").alias("a"), F.col("o_dealer_id").alias("b")).distinct()


def close_fences(spark, d):
    """Dealers whose boxes overlap and of whose vertices, every second one, some pair is less than 3 km apart."""
    v = B.fence_vertices(spark, d).where("pos % 2 = 0").select("dealer_id", "x", "y")
    near = S.within(v, v.select(F.col("dealer_id").alias("b"), F.col("x").alias("mx"), F.col("y").alias("my")), 3.0).where("dealer_id < b")
    return near.select(F.col("dealer_id").alias("a"), "b").distinct().join(adjacency(spark, d), ["a", "b"], "left_semi")


SUB = 5


def unit_shares(spark, d):
    """Units of which a dealer's fences hold half or more, or which are three tenths or more of all that they hold, by 5 x 5 points in each."""
    _, step = B.grid(spark, d)
    at = lambda c: F.explode(F.expr(f"transform(sequence(0, {SUB - 1}), k -> {c} - {step // 2} + k * {step // SUB} + {step // (2 * SUB)})"))
    p = B.units(spark, d).select("unit_id", F.col("x").alias("ux"), F.col("y").alias("uy")).withColumn("x", at("ux")).withColumn("y", at("uy")).select("unit_id", "x", "y")
    n = S.contain(p, B.fences(spark, d), ["dealer_id"]).distinct().groupBy("dealer_id", "unit_id").agg(F.count("*").alias("n"))
    own = n.groupBy("dealer_id").agg(F.sum("n").alias("own"))
    return n.join(own, "dealer_id").where(f"n >= 0.5 * {SUB * SUB} OR n >= 0.3 * own").select("dealer_id", "unit_id", "n")


def overlaps(spark, d):
    """Pairs of dealers that share units, and how many; the share of the region's units that some dealer holds is in each row."""
    t = unit_truth(spark, d)
    covered = t.select("unit_id").distinct().agg(F.count("*").alias("c")).crossJoin(B.units(spark, d).agg(F.count("*").alias("u"))).select(F.round(F.col("c") / F.col("u"), 9).alias("covered"))  # one row
    pairs = t.join(t.select("unit_id", F.col("dealer_id").alias("b")), "unit_id").where("dealer_id < b").groupBy(F.col("dealer_id").alias("a"), "b").agg(F.count("*").alias("units"))
    return pairs.crossJoin(F.broadcast(covered))


def tiling(spark, d):
    """Per street: units in no fence, one fence, two or more."""
    owners = unit_truth(spark, d).groupBy("unit_id").agg(F.count("*").alias("n"))
    return B.units(spark, d).join(owners, "unit_id", "left").groupBy("street").agg(F.count_if(F.col("n").isNull()).alias("none"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("many"))


def rebalanced(spark, d):
    w = B.workloads(spark, d).select(F.expr("territory_id div 5").cast("long").alias("scope"), "account_id", F.col("territory_id").cast("long").alias("territory_id"), (F.col("calls") * F.col("minutes")).alias("load"))
    return Z.rebalance(w)


QUERIES = {
    "a8_territory_loads": loads,
    "a9_required_reps": lambda s, d: loads(s, d).select("territory_id", Z.required_reps(F.col("load"), CAPACITY).alias("reps")),
    "a10_eq_index": lambda s, d: Z.eq_index(loads(s, d)),
    "a11_balance": lambda s, d: Z.balance(loads(s, d), CAPACITY),
    "j7_nearby": lambda s, d: Z.nearby(B.containers(s, d), 20.0, 3),
    "g1_rebalance": rebalanced,
    "a24_occupancy": occupancy,
    "j11_unit_in_fence": unit_truth,
    "a16_street_composition": compose,
    "a17_street_summary": lambda s, d: compose(s, d).where("share >= 0.15").select("dealer_id", "street", F.when(F.col("share") > 0.95, "full").otherwise("part").alias("held")),
    "a19_set_overlap": overlap,
    "a25_nearest_rank": nearest_rank,
    "a26_median": lambda s, d: Q.medians(table(s, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v")), "o_orderpriority", "v", 1000.0).select("o_orderpriority", F.round("median", 4).alias("median")),
    "a34_tiling": tiling,
    "j13_fence_adjacency": adjacency,
    "j13_close_fences": close_fences,
    "j11_unit_shares": unit_shares,
    "a34_overlaps": overlaps,
    "t2_candidate_top": lambda s, d: Z.nearby(B.containers(s, d), 40.0, 1).select("territory_id", "near_id", "distance"),
}
_LOAD = "SELECT territory_id, CAST(sum(calls * minutes) AS BIGINT) AS load FROM workload GROUP BY 1"
_TRUE = "SELECT DISTINCT unit_id, dealer_id FROM unit_in"
_COMP = "SELECT dealer_id, street, n / total AS s FROM (SELECT dealer_id, street, count(*) AS n FROM truth JOIN unit USING (unit_id) GROUP BY 1, 2) JOIN (SELECT street, count(*) AS total FROM unit GROUP BY 1) USING (street)"
_EQ = "SELECT count(*) AS n, round(CASE WHEN count(*) <= 1 OR coalesce(sum(load), 0) <= 0 THEN 1.0 ELSE CAST(sum(load) AS DOUBLE) * CAST(sum(load) AS DOUBLE) / (count(*) * sum(CAST(load AS DOUBLE) * load)) END, 9) AS eq FROM load"
SQL = {
    "a8_territory_loads": sql("SELECT * FROM load", load=_LOAD),
    "a9_required_reps": sql("SELECT territory_id, CASE WHEN load <= 0 THEN 0 ELSE CAST(ceil(load / 3000.0) AS BIGINT) END AS reps FROM load", load=_LOAD),
    "a10_eq_index": sql(_EQ, load=_LOAD),
    "a11_balance": sql(f"SELECT CAST(sum(load) AS BIGINT) AS total, CAST(ceil(sum(load) / 3000.0) AS BIGINT) AS reps_on_total, CAST(sum(ceil(load / 3000.0)) AS BIGINT) AS reps_by_territory, (SELECT eq FROM ({_EQ})) AS eq, round(CASE WHEN min(load) > 0 THEN max(load) / min(load) END, 9) AS max_min FROM load", load=_LOAD),
    "j7_nearby": sql("SELECT territory_id, near_id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY territory_id ORDER BY distance, near_id) AS rank FROM (SELECT a.territory_id, b.territory_id AS near_id, round_even(sqrt(pow(a.x_km - b.x_km, 2) + pow(a.y_km - b.y_km, 2)), 4) AS distance FROM container a JOIN container b ON a.territory_id <> b.territory_id AND b.headroom > 0 AND sqrt(pow(a.x_km - b.x_km, 2) + pow(a.y_km - b.y_km, 2)) <= 20.0)) WHERE rank <= 3"),
    "a24_occupancy": sql("SELECT dealer_id, count(DISTINCT (x // 5000, y // 5000)) AS cells, count(DISTINCT store_id) AS stores FROM held JOIN store USING (store_id) GROUP BY 1 HAVING cells >= 2"),
    "j11_unit_in_fence": sql(_TRUE),
    "a16_street_composition": sql("SELECT dealer_id, street, round(s, 9) AS share, CASE WHEN s > 0.95 THEN '全部' WHEN s >= 0.6 THEN '大部' WHEN s >= 0.3 THEN '约半' ELSE '约' || CAST(CAST(round_even(s * 100, 0) AS INTEGER) AS VARCHAR) || '%' END AS tag FROM comp", truth=_TRUE, comp=_COMP),
    "a17_street_summary": sql("SELECT dealer_id, street, CASE WHEN s > 0.95 THEN 'full' ELSE 'part' END AS held FROM comp WHERE round(s, 9) >= 0.15", truth=_TRUE, comp=_COMP),
    "a19_set_overlap": sql("SELECT *, round(CASE WHEN hit + over_ > 0 THEN hit / (hit + over_) END, 9) AS precision, round(hit / (hit + miss), 9) AS recall, round(hit / (hit + over_ + miss), 9) AS jaccard FROM (SELECT dealer_id, count(*) FILTER (WHERE p = 1 AND t = 1) AS hit, count(*) FILTER (WHERE t IS NULL) AS over_, count(*) FILTER (WHERE p IS NULL) AS miss FROM (SELECT dealer_id, unit_id, 1 AS p FROM comp JOIN unit USING (street) WHERE round(s, 9) >= 0.3) FULL JOIN (SELECT *, 1 AS t FROM truth) USING (dealer_id, unit_id) GROUP BY 1)", truth=_TRUE, comp=_COMP).replace("over_", '"over"'),
    "a25_nearest_rank": "SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE r = floor((n - 1) * 0.25) + 1) AS q25, max(o_totalprice) FILTER (WHERE r = floor((n - 1) * 0.5) + 1) AS q50, max(o_totalprice) FILTER (WHERE r = floor((n - 1) * 0.9) + 1) AS q90, count(*) FILTER (WHERE o_totalprice >= 250000) AS high FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1",
    "a26_median": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1",
    "a34_tiling": sql("SELECT street, count(*) FILTER (WHERE n IS NULL) AS none, count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n > 1) AS many FROM unit LEFT JOIN (SELECT unit_id, count(*) AS n FROM truth GROUP BY 1) USING (unit_id) GROUP BY 1", truth=_TRUE),
    "j13_close_fences": sql("SELECT DISTINCT v.dealer_id AS a, w.dealer_id AS b FROM fence_vertex v JOIN fence_vertex w ON v.dealer_id < w.dealer_id AND v.pos % 2 = 0 AND w.pos % 2 = 0 AND pow((v.x - w.x) / 1e6 * 102.2, 2) + pow((v.y - w.y) / 1e6 * 110.574, 2) < 9 JOIN b p ON p.dealer_id = v.dealer_id JOIN b q ON q.dealer_id = w.dealer_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1", b="SELECT dealer_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fence_vertex GROUP BY dealer_id, comp"),
    "j11_unit_shares": sql("SELECT dealer_id, unit_id, n FROM (SELECT *, sum(n) OVER (PARTITION BY dealer_id) AS own FROM (SELECT dealer_id, unit_id, count(*) AS n FROM (SELECT DISTINCT dealer_id, unit_id, x, y FROM (SELECT s.unit_id, s.x, s.y, e.dealer_id, e.comp, count(*) AS c FROM pt s JOIN fence_edge e ON (e.y1 > s.y) <> (e.y2 > s.y) AND CASE WHEN e.y2 > e.y1 THEN (s.x - e.x1) * (e.y2 - e.y1) < (s.y - e.y1) * (e.x2 - e.x1) ELSE (s.x - e.x1) * (e.y2 - e.y1) > (s.y - e.y1) * (e.x2 - e.x1) END GROUP BY ALL) WHERE c % 2 = 1) GROUP BY 1, 2)) WHERE n >= 12.5 OR n >= 0.3 * own", pt="SELECT unit_id, x - step // 2 + a * (step // 5) + step // 10 AS x, y - step // 2 + b * (step // 5) + step // 10 AS y FROM unit, grid, range(5) p(a), range(5) q(b)"),
    "a34_overlaps": sql("SELECT p.dealer_id AS a, q.dealer_id AS b, count(*) AS units, (SELECT round(count(DISTINCT unit_id) / (SELECT count(*) FROM unit), 9) FROM truth) AS covered FROM truth p JOIN truth q ON p.unit_id = q.unit_id AND p.dealer_id < q.dealer_id GROUP BY 1, 2", truth=_TRUE),
    "t2_candidate_top": sql("SELECT territory_id, near_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY territory_id ORDER BY distance, near_id) AS rank FROM (SELECT a.territory_id, b.territory_id AS near_id, round_even(sqrt(pow(a.x_km - b.x_km, 2) + pow(a.y_km - b.y_km, 2)), 4) AS distance FROM container a JOIN container b ON a.territory_id <> b.territory_id AND b.headroom > 0 AND sqrt(pow(a.x_km - b.x_km, 2) + pow(a.y_km - b.y_km, 2)) <= 40.0)) WHERE rank <= 1"),
    "j13_fence_adjacency": sql("SELECT p.dealer_id AS a, q.dealer_id AS b FROM b p JOIN b q ON p.dealer_id < q.dealer_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1", b="SELECT dealer_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fence_vertex GROUP BY dealer_id, comp").replace("SELECT p.dealer_id", "SELECT DISTINCT p.dealer_id"),
}
