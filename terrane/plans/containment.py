"""Queries on points, rings, containment, store kinds and dealer health."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import X0, Y0, sql
from terrane.operators import classify as C
from terrane.operators import spatial as S
from terrane.session import stored, table

LAT = 22.5


def kinded(spark, d):
    """Stores with dealers, upstream and kind."""
    held = C.store_dealers(B.stores(spark, d), B.fences(spark, d))
    known = C.with_upstream(held, B.main_suppliers(spark, d))
    return known.withColumn("kind", C.kind(F.col("dealers"), F.col("direct"), F.col("upstream")))


def areas(spark, d):
    return B.fences(spark, d).select("dealer_id", "comp", S.ring_area_km2(F.col("ring"), X0, Y0, LAT).alias("area_km2"))


def dealer_area(spark, d):
    return areas(spark, d).groupBy("dealer_id").agg(F.sum("area_km2").alias("area_km2"), F.count("*").alias("components"))


def centroids(spark, d):
    return S.centroids(B.fence_vertices(spark, d), ["dealer_id", "comp"])


def nearest_fence(spark, d):
    """(store_id, dealer_id, comp, km): nearest component of each store by great circle to its centroid, the first of equally near ones."""
    sites = centroids(spark, d).withColumn("fence", F.struct("dealer_id", "comp"))
    points = B.stores(spark, d).select("store_id", "x", "y")
    return S.nearest_km(points, sites, "store_id", "fence", ["dealer_id", "comp"]).select("store_id", "fence.*", "km")


def nearest_dealer(spark, d):
    """(store_id, dealer_id, km): nearest dealer of each store, on the plane, by the mean of the vertices of all its components."""
    sites = S.centroids(B.fence_vertices(spark, d), ["dealer_id"])
    return S.nearest_km(B.stores(spark, d).select("store_id", "x", "y"), sites, "store_id", "dealer_id", ["dealer_id"], flat=True)


def healths(spark, d):
    return C.health(kinded(spark, d), dealer_area(spark, d))


def classed_gaps(spark, d):
    return C.gap_classes(kinded(spark, d), nearest_fence(spark, d), B.dealers(spark, d))


def store_fence(spark, d):
    return S.contain(B.stores(spark, d), B.fences(spark, d), ["dealer_id", "comp"]).select("store_id", "dealer_id", "comp")


def dealer_index(spark, d):
    per = B.fences(spark, d).groupBy("dealer_id").agg(F.count("*").alias("components"), F.min("comp").alias("first_comp"))
    return per


def boxes(spark, d):
    return S.with_box(B.fences(spark, d)).select("dealer_id", "comp", "bx0", "by0", "bx1", "by1")


def ring_edges(spark, d):
    return B.fences(spark, d).select("dealer_id", "comp", F.posexplode(S.edges(F.col("ring"))).alias("pos", "e")).select("dealer_id", "comp", "pos", "e.*")


def first_district(spark, d):
    """First district (square of the window, by number) that holds each store."""
    n, step = B.grid(spark, d)
    square = stored(B.units(spark, d).select("district").distinct(), "districts")  # else filters on the rings are worked out for every store
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    edge = lambda k, at: F.when(k == n // 10, at + B.SIDE).otherwise(at + k * 10 * step)
    across, up = F.expr(f"district div {n // 10}"), F.expr(f"district % {n // 10}")
    x0, x1, y0, y1 = edge(across, X0), edge(across + 1, X0), edge(up, Y0), edge(up + 1, Y0)
    rings = square.select("district", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))
    points = B.stores(spark, d).select("store_id", "x", "y")
    return S.contain(points, rings, ["district"]).groupBy("store_id").agg(F.min("district").alias("district"))


def haversine(spark, d):
    """Distances from each store to the centroid of its nearest component: by great circle, on the plane and in micro-degrees."""
    j = B.stores(spark, d).select("store_id", "x", "y").join(nearest_fence(spark, d), "store_id").join(centroids(spark, d), ["dealer_id", "comp"])
    return j.select("store_id", "dealer_id", F.round("km", 6).alias("km"), F.round(F.sqrt(S.km2(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))), 6).alias("flat_km"), F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 2).alias("units"))


def direction(spark, d):
    """Where each component's centroid lies, seen from the mean of all: the axis of the larger offset."""
    c = centroids(spark, d)
    j = c.crossJoin(F.broadcast(c.agg(F.avg("mx").alias("ax"), F.avg("my").alias("ay"))))  # one row
    dx, dy = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")
    label = F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "E").otherwise("W")).otherwise(F.when(dy > 0, "N").otherwise("S"))
    return j.select("dealer_id", "comp", label.alias("direction"))


def clipped(spark, d):
    """What each component keeps north of its dealer's line; a component all south of it has no vertices."""
    f = B.fences(spark, d).withColumn("fence", F.struct("dealer_id", "comp"))
    cut = f.join(B.dealers(spark, d).select("dealer_id", F.col("cx").alias("px"), (F.col("cy") - F.expr("h div 2")).alias("py")), "dealer_id")
    out = S.clip_half_plane(cut.withColumns({"nx": F.lit(0), "ny": F.lit(1)}), "fence").select("fence.*", "y")
    kept = out.groupBy("dealer_id", "comp").agg(F.count("*").alias("vertices"), F.round(F.min("y"), 3).alias("low"), F.round(F.max("y"), 3).alias("high"))
    return f.select("dealer_id", "comp").join(kept, ["dealer_id", "comp"], "left").select("dealer_id", "comp", F.coalesce("vertices", F.lit(0)).alias("vertices"), "low", "high")


def lines(spark, d):
    return S.running_length(B.landmarks(spark, d), ["name", "seg"], "pos").groupBy("name", "seg").agg(F.count("*").alias("vertices"), F.round(F.max("along"), 3).alias("length"))


def resampled(spark, d):
    return S.resample(B.landmarks(spark, d), ["name", "seg"], "pos", 250_000.0).groupBy("name", "seg").agg(F.count("*").alias("n"), F.round(F.avg("x"), 2).alias("ax"), F.round(F.avg("y"), 2).alias("ay"))


def fitted(spark, d):
    """Least-squares line per landmark: the axis of larger variance is the free one."""
    f = S.fit_line(B.landmarks(spark, d), ["name"])
    return f.select("name", "by_x", F.round("slope", 8).alias("slope"), F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), F.round("nx", 8).alias("nx"), F.round("ny", 8).alias("ny"))


def in_one_ring(spark, d):
    """Whether each store lies in each component of the dealer of its number, by the ring's edges alone."""
    n = table(spark, d, "supplier").count()
    rings = B.fences(spark, d).select("dealer_id", "comp", S.edges(F.col("ring")).alias("e"))
    s = B.stores(spark, d).select("store_id", "x", "y", (F.col("store_id") % n).alias("dealer_id"))
    return s.join(rings, "dealer_id").select("store_id", "dealer_id", "comp", S.inside(F.col("e"), F.col("x"), F.col("y")).alias("inside"))


QUERIES = {
    "j1_store_fence": store_fence,
    "j2_dealer_index": dealer_index,
    "p2_ring_bbox": boxes,
    "w6_ring_edges": ring_edges,
    "a21_ring_area": lambda s, d: areas(s, d).select("dealer_id", "comp", F.round("area_km2", 6).alias("area_km2")),
    "a22_vertex_centroid": lambda s, d: centroids(s, d).select("dealer_id", "comp", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my")),
    "a7_territory_area": lambda s, d: dealer_area(s, d).select("dealer_id", F.round("area_km2", 6).alias("area_km2"), "components"),
    "p3_store_kind": lambda s, d: kinded(s, d).select("store_id", F.array_join(F.col("dealers").cast("array<string>"), ",").alias("dealers"), "upstream", "kind"),
    "p4_is_direct": lambda s, d: B.stores(s, d).select("store_id", C.is_direct(F.col("channel"), ["FURN", "AUTO"]).alias("is_direct")),
    "a1_coverage": lambda s, d: C.coverage(kinded(s, d)),
    "a2_oof_by_upstream": lambda s, d: C.out_of_fence_by_upstream(kinded(s, d)),
    "a2_gap_by_district": lambda s, d: C.gap_by_district(kinded(s, d)),
    "a3_kind_counts": lambda s, d: C.kind_counts(kinded(s, d)),
    "a4_dealer_health": healths,
    "a5_top_district": lambda s, d: C.top_district(kinded(s, d)),
    "t1_health_ranking": lambda s, d: C.health_ranking(healths(s, d)),
    "w2_one_per_dealer": lambda s, d: C.one_per_dealer(boxes(s, d)),
    "j6_nearest_fence": lambda s, d: nearest_fence(s, d).select("store_id", "dealer_id", "comp", F.round("km", 6).alias("km")),
    "r9_gap_classes": classed_gaps,
    "a6_gap_summary": lambda s, d: C.gap_summary(classed_gaps(s, d)),
    "t4_gap_districts": lambda s, d: C.gap_by_district(kinded(s, d)).orderBy(F.desc("n"), "district"),
    "a14_conflicts": lambda s, d: C.conflicts(kinded(s, d)),
    "j9_first_district": first_district,
    "p11_haversine": haversine,
    "p13_direction": direction,
    "p1_point_in_ring": in_one_ring,
    "p23_clip_half_plane": clipped,
    "p20_running_length": lines,
    "p21_resample": resampled,
    "p22_fit_line": fitted,
}
_HEALTH = "SELECT a.dealer_id, coalesce(stores, 0) AS stores, coalesce(n_ok, 0) AS n_ok, coalesce(n_oof, 0) AS n_oof, coalesce(n_multi, 0) AS n_multi, coalesce(n_direct_in, 0) AS n_direct_in, a.area_km2 FROM (SELECT dealer_id, sum(area_km2) AS area_km2 FROM area GROUP BY 1) a LEFT JOIN (SELECT h.dealer_id, count(*) AS stores, count(*) FILTER (WHERE kind = 'OK') AS n_ok, count(*) FILTER (WHERE kind = 'OOF') AS n_oof, count(*) FILTER (WHERE kind = 'MULTI') AS n_multi, count(*) FILTER (WHERE kind = 'DIRECT_IN') AS n_direct_in FROM (SELECT DISTINCT store_id, dealer_id FROM held) h JOIN kinded USING (store_id) GROUP BY 1) USING (dealer_id)"
_RATED = f"SELECT *, CASE WHEN stores > 0 THEN n_ok / stores ELSE 0.0 END AS ok_r, CASE WHEN stores > 0 THEN n_oof / stores ELSE 0.0 END AS oof_r FROM ({_HEALTH})"
_VERDICT = f"SELECT dealer_id, stores, n_ok, n_oof, n_multi, n_direct_in, round(CAST(ok_r AS DOUBLE), 9) AS ok_rate, round(CAST(oof_r AS DOUBLE), 9) AS oof_rate, CASE WHEN oof_r > 0.20 THEN '调查' WHEN ok_r >= 0.79 THEN '健康' ELSE '观察' END AS verdict, round(stores / area_km2, 6) AS density FROM ({_RATED})"
_ARC = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians(my / 1e6) - radians(y / 1e6)) / 2), 2) + cos(radians(y / 1e6)) * cos(radians(my / 1e6)) * pow(sin((radians(mx / 1e6) - radians(x / 1e6)) / 2), 2)))"
_NEAR = f"SELECT store_id, arg_min(dealer_id, (km, dealer_id, comp)) AS dealer_id, arg_min(comp, (km, dealer_id, comp)) AS comp, min(km) AS km FROM (SELECT store_id, dealer_id, comp, {_ARC} AS km FROM store, centroid) GROUP BY 1"
_POOLED = "SELECT store_id, arg_min(dealer_id, (d, dealer_id)) AS dealer_id FROM (SELECT store_id, dealer_id, sqrt(pow((x - mx) / 1e6 * 102.2, 2) + pow((y - my) / 1e6 * 110.574, 2)) AS d FROM store, (SELECT dealer_id, avg(x) AS mx, avg(y) AS my FROM fence_vertex GROUP BY 1)) GROUP BY 1"
_CLASSES = "SELECT k.store_id, district, CASE WHEN upstream IS NULL THEN 'no_upstream' WHEN EXISTS (SELECT 1 FROM dealer d WHERE d.dealer_id = upstream) THEN 'dealer_outside' ELSE 'other_upstream' END AS class, CASE WHEN upstream IS NULL THEN 'DATA' ELSE 'D' END AS layer, round(km, 2) > 5.0 AS structural, round(km, 2) AS nearest_km FROM kinded k JOIN near USING (store_id) WHERE kind = 'GAP'"
_RUN = "SELECT name, seg, pos, x, y, coalesce(sum(sqrt(CAST((x - px) * (x - px) + (y - py) * (y - py) AS DOUBLE))) OVER (PARTITION BY name, seg ORDER BY pos), 0) AS along FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM landmark WINDOW w AS (PARTITION BY name, seg ORDER BY pos))"
SQL = {
    "j1_store_fence": sql("SELECT * FROM held"),
    "j2_dealer_index": sql("SELECT dealer_id, count(*) AS components, min(comp) AS first_comp FROM (SELECT DISTINCT dealer_id, comp FROM fence_vertex) GROUP BY 1"),
    "p2_ring_bbox": sql("SELECT dealer_id, comp, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1 FROM fence_vertex GROUP BY 1, 2"),
    "w6_ring_edges": sql("SELECT * FROM fence_edge"),
    "a21_ring_area": sql("SELECT dealer_id, comp, round(area_km2, 6) AS area_km2 FROM area"),
    "a22_vertex_centroid": sql("SELECT dealer_id, comp, round(mx, 3) AS mx, round(my, 3) AS my FROM centroid"),
    "a7_territory_area": sql("SELECT dealer_id, round(sum(area_km2), 6) AS area_km2, count(*) AS components FROM area GROUP BY 1"),
    "p3_store_kind": sql("SELECT store_id, coalesce(dealers, '') AS dealers, upstream, kind FROM kinded"),
    "p4_is_direct": sql("SELECT store_id, contains(channel, 'FURN') OR contains(channel, 'AUTO') AS is_direct FROM store"),
    "a1_coverage": sql("SELECT *, round((ok + multi + out_of_fence) / n, 9) AS legacy_rate, round(inside / n, 9) AS coverage_rate FROM (SELECT count(*) AS n, count(*) FILTER (WHERE i AND NOT o) AS ok, count(*) FILTER (WHERE NOT i AND direct) AS normal_direct, count(*) FILTER (WHERE NOT i AND NOT direct) AS real_gap, count(*) FILTER (WHERE n_dealers > 1) AS multi, count(*) FILTER (WHERE o) AS out_of_fence, count(*) FILTER (WHERE i) AS inside FROM (SELECT *, n_dealers IS NOT NULL AS i, n_dealers IS NOT NULL AND upstream IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.store_id = k.store_id AND h.dealer_id = k.upstream) AS o FROM kinded k))"),
    "a2_oof_by_upstream": sql("SELECT upstream, count(*) AS n FROM kinded WHERE kind = 'OOF' GROUP BY 1"),
    "a2_gap_by_district": sql("SELECT district, count(*) AS n FROM kinded WHERE kind = 'GAP' GROUP BY 1"),
    "a3_kind_counts": sql("SELECT kind, count(*) AS n FROM kinded GROUP BY 1"),
    "a4_dealer_health": sql(_VERDICT),
    "a5_top_district": sql("SELECT dealer_id, arg_max(district, (n, -district)) AS district, round(max(n) / sum(n), 9) AS purity FROM (SELECT h.dealer_id, district, count(*) AS n FROM (SELECT DISTINCT store_id, dealer_id FROM held) h JOIN store USING (store_id) GROUP BY 1, 2) GROUP BY 1"),
    "t1_health_ranking": sql(f"SELECT * FROM ({_VERDICT}) ORDER BY (verdict = '调查') DESC, oof_rate DESC, dealer_id LIMIT 12"),
    "w2_one_per_dealer": sql("SELECT dealer_id, comp, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1 FROM fence_vertex WHERE comp = 1 GROUP BY 1, 2"),
    "j6_nearest_fence": sql("SELECT store_id, dealer_id, comp, round(km, 6) AS km FROM near", near=_NEAR),
    "r9_gap_classes": sql(_CLASSES, near=_NEAR),
    "a6_gap_summary": sql("SELECT CAST(grouping(class, layer, district, structural) AS INTEGER) AS g, class, layer, district, structural, count(*) AS n FROM classes GROUP BY GROUPING SETS ((class), (layer), (district), (structural), ())", near=_NEAR, classes=_CLASSES),
    "t4_gap_districts": sql("SELECT district, count(*) AS n FROM kinded WHERE kind = 'GAP' GROUP BY 1 ORDER BY n DESC, district"),
    "a14_conflicts": sql("SELECT kind, max(c) AS n, string_agg(store_id, ',' ORDER BY store_id) FILTER (WHERE r <= 5) AS head FROM (SELECT kind, store_id, row_number() OVER (PARTITION BY kind ORDER BY store_id) AS r, count(*) OVER (PARTITION BY kind) AS c FROM kinded WHERE kind IN ('OOF', 'MULTI', 'GAP')) GROUP BY 1"),
    "j9_first_district": sql("SELECT store_id, (least((x - 113000000) // step, n - 1) // 10) * (n // 10) + least((y - 22500000) // step, n - 1) // 10 AS district FROM store, grid"),
    "p11_haversine": sql("SELECT store_id, n.dealer_id, round(km, 6) AS km, round(sqrt(pow((x - mx) / 1e6 * 102.2, 2) + pow((y - my) / 1e6 * 110.574, 2)), 6) AS flat_km, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 2) AS units FROM near n JOIN store USING (store_id) JOIN centroid c ON c.dealer_id = n.dealer_id AND c.comp = n.comp", near=_NEAR),
    "p13_direction": sql("SELECT dealer_id, comp, CASE WHEN abs(dx) > abs(dy) THEN CASE WHEN dx > 0 THEN 'E' ELSE 'W' END ELSE CASE WHEN dy > 0 THEN 'N' ELSE 'S' END END AS direction FROM (SELECT dealer_id, comp, mx - (SELECT avg(mx) FROM centroid) AS dx, my - (SELECT avg(my) FROM centroid) AS dy FROM centroid)"),
    "p23_clip_half_plane": sql("SELECT dealer_id, comp, count(y) AS vertices, round(min(y), 3) AS low, round(max(y), 3) AS high FROM (SELECT dealer_id, comp, unnest(CASE WHEN a >= 0 AND b >= 0 THEN [y2::DOUBLE] WHEN a >= 0 THEN [y1 + a / (a - b) * (y2 - y1)] WHEN b >= 0 THEN [y1 + a / (a - b) * (y2 - y1), y2::DOUBLE] ELSE [NULL] END) AS y FROM (SELECT e.*, y1 - (cy - h // 2) AS a, y2 - (cy - h // 2) AS b FROM fence_edge e JOIN dealer USING (dealer_id))) GROUP BY 1, 2"),
    "p20_running_length": sql("SELECT name, seg, count(*) AS vertices, round(max(along), 3) AS length FROM run GROUP BY 1, 2", run=_RUN),
    "p21_resample": sql("SELECT name, seg, count(*) AS n, round(avg(x + (k * 250000.0::DOUBLE - along) / (t - along) * (x2 - x)), 2) AS ax, round(avg(y + (k * 250000.0::DOUBLE - along) / (t - along) * (y2 - y)), 2) AS ay FROM (SELECT *, unnest(range(CAST(ceil(along / 250000.0::DOUBLE) AS BIGINT), CAST(ceil(t / 250000.0::DOUBLE) AS BIGINT))) AS k FROM (SELECT *, lead(along) OVER w AS t, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM run WINDOW w AS (PARTITION BY name, seg ORDER BY pos)) WHERE t > along) GROUP BY 1, 2", run=_RUN),
    "p22_fit_line": sql("SELECT name, by_x, round(slope, 8) AS slope, round(px, 3) AS px, round(py, 3) AS py, round(CASE WHEN by_x THEN -slope ELSE 1 END / sqrt(1 + slope * slope), 8) AS nx, round(CASE WHEN by_x THEN 1 ELSE -slope END / sqrt(1 + slope * slope), 8) AS ny FROM (SELECT name, var_pop(x) >= var_pop(y) AS by_x, covar_pop(x, y) / greatest(var_pop(x), var_pop(y)) AS slope, avg(x) AS px, avg(y) AS py FROM landmark GROUP BY 1)"),
    "p1_point_in_ring": sql("SELECT store_id, dealer_id, comp, EXISTS (SELECT 1 FROM held h WHERE h.store_id = s.store_id AND h.dealer_id = s.dealer_id AND h.comp = f.comp) AS inside FROM (SELECT store_id, store_id % (SELECT count(*) FROM supplier) AS dealer_id FROM store) s JOIN (SELECT DISTINCT dealer_id, comp FROM fence_vertex) f USING (dealer_id)"),
}
