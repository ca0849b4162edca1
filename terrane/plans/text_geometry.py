"""Queries on instruction texts. The sentences are made from suppliers, one or more for each, in all patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import instructions as I
from terrane.session import table

# Sentences by kind, as SQL that both engines read: a is the supplier's name, b another's, k its number.
_SENTENCE = {
    "transfer": ["'把' || a || '的东部片区划给' || b", "'把' || a || '的NATION_' || k % 25 || '调整给' || b", "'把' || a || '的北半区移交给' || b", "'把' || a || '在NATION_' || k % 25 || '的门店划给' || b", "'把' || a || '整体并入' || b", "' 把' || a || '划给' || b || '的门店 '", "a || '不做了，区域都给' || b", "'请关注' || a", "'把「Supplier#00」划给' || b"],
    "ledger": ["'街道' || k % 100 || '的北部给' || a || '。'", "'把区' || k % 25 || '的单元给 ' || a", "'区' || k % 25 || '归' || a", "'街道' || k % 100", "'给' || a"],
    "zone": ["'合并 @' || a || ' @' || b", "'@' || a || ' 的北部划给 @' || b", "'拆分 @' || a || ' 沿 Brand' || k % 25", "'取消 @' || a", "'融合 @' || a", "'看看 @' || a", "'删除 @#0000'"],
    "bounds": ["'西至Brand' || k % 25 || '，北至水道；东至Brand' || k % 7 || '。'", "'南至' || a || '、南至 Brand' || k % 7", "'东至，西至' || b", "'无界'", "''"],
    "contract": ["'Brand' || (11 + k % 5) || '以南，Brand' || (21 + k % 5) || '以东'", "'Brand' || (31 + k % 5) || '以北、and5以北。'", "'甲Brand' || (41 + k % 5) || '路以西'", "'zz以南'"],
}


def _case(kind: str) -> str:
    said = _SENTENCE[kind]
    return "CASE k % " + str(len(said)) + "".join(f" WHEN {n} THEN {s}" for n, s in enumerate(said)) + " END"


def texts(spark, d, kind):
    """(k, text)"""
    return table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS a", "concat('Supplier#', lpad(CAST(s_suppkey + 1 AS STRING), 9, '0')) AS b").selectExpr("k", f"{_case(kind)} AS text")


def names(spark, d):
    return table(spark, d, "supplier").select("s_name")


def marks(spark, d):
    return table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("name")).distinct()


def transfers(spark, d):
    t = I.transfers(texts(spark, d, "transfer")).withColumns({"src": I.clean_name(F.col("src")), "dst": I.clean_name(F.col("dst"))})
    src = I.resolve(t.select("k", "src"), "src", names(spark, d), "s_name")
    return t, src


def zones(spark, d):
    """Zone operations whose references each fit one zone."""
    z = I.zone_operations(texts(spark, d, "zone"))
    said = z.select("k", F.posexplode("refs").alias("at", "ref"))
    fits = I.holders(said, "ref", names(spark, d), "s_name").where("n = 1").select("ref", F.col("first").alias("zone"))
    each = said.join(fits, "ref", "left")
    ok = each.groupBy("k").agg((F.count("zone") == F.count("*")).alias("resolved"))
    return z.join(ok, "k", "left").select("k", F.array_join("refs", "|").alias("refs"), "op", "side", "cut", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def bounds(spark, d):
    b = texts(spark, d, "bounds").select("k", F.explode(I.four_bounds(F.col("text"))).alias("side", "name"))
    return b


def streets(spark, d):
    return I.street_aliases(table(spark, d, "part").selectExpr("p_partkey AS k", "concat(p_brand, CASE p_partkey % 3 WHEN 0 THEN '街道' WHEN 1 THEN '镇' ELSE '' END) AS street"), "street", "k")


QUERIES = {
    "p5_four_bounds": bounds,
    "p6_transfer_instruction": lambda s, d: transfers(s, d)[0].select("k", "pattern", "src", "selector", "dst"),
    "p9_name_resolution": lambda s, d: transfers(s, d)[1].select("k", "src", "match", "status"),
    "p7_ledger_instruction": lambda s, d: I.ledger_entries(texts(s, d, "ledger")).select("k", "owner", "term", "side"),
    "p8_zone_operation": zones,
    "p10_street_aliases": streets,
    "p24_sided_bounds": lambda s, d: I.sided_bounds(texts(s, d, "contract"), "k", "text", marks(s, d), "name"),
}


def _said(kind: str) -> str:
    return f"said AS (SELECT k, {_case(kind)} AS text FROM (SELECT s_suppkey AS k, s_name AS a, concat('Supplier#', lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0')) AS b FROM supplier))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _clean(column: str) -> str:
    out = f"regexp_replace(trim({column}), {_quoted('^[「」' + chr(34) + chr(39) + ']+|[「」' + chr(34) + chr(39) + ']+$')}, '', 'g')"
    for ending in I.ENDINGS:
        out = f"regexp_replace({out}, '{ending}$', '')"
    return f"trim({out})"


def _groups(of) -> str:
    return "CASE pattern" + "".join(f" WHEN {k} THEN " + (f"regexp_extract(trim(text), {_quoted(I.TRANSFERS[k])}, {g})" if g else f"'{I.WHOLE}'") for k, g in enumerate(of)) + " END"


_PATTERN = "CASE" + "".join(f" WHEN regexp_matches(trim(text), {_quoted(p)}) THEN {k}" for k, p in enumerate(I.TRANSFERS)) + " END"
_MOVED = f"{_said('transfer')}, numbered AS (SELECT k, text, {_PATTERN} AS pattern FROM said), moved AS (SELECT k, CAST(pattern AS INTEGER) AS pattern, {_clean(_groups([1] * 7))} AS src, {_groups([2] * 4 + [None] * 3)} AS selector, {_clean(_groups([3] * 4 + [2] * 3))} AS dst FROM numbered)"
_SIDE = "CASE side WHEN '南' THEN '北' WHEN '北' THEN '南' WHEN '东' THEN '西' ELSE '东' END"
SQL = {
    "p5_four_bounds": f"WITH {_said('bounds')}, pair AS (SELECT k, unnest(regexp_extract_all(text, '{I.BOUND}', 1)) AS side, trim(unnest(regexp_extract_all(text, '{I.BOUND}', 2))) AS name, unnest(range(len(regexp_extract_all(text, '{I.BOUND}', 1)))) AS p FROM said) SELECT k, side, arg_max(name, p) AS name FROM pair WHERE name <> '' GROUP BY 1, 2",
    "p6_transfer_instruction": f"WITH {_MOVED} SELECT * FROM moved",
    "p9_name_resolution": f"WITH {_MOVED} SELECT k, src, CASE WHEN n = 1 THEN first WHEN e = 1 THEN src END AS match, CASE WHEN n = 0 THEN 'NONE' WHEN n = 1 OR e = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status FROM (SELECT k, src, count(s_name) AS n, min(s_name) AS first, max(CAST(s_name = src AS INTEGER)) AS e FROM moved LEFT JOIN supplier ON src <> '' AND contains(s_name, src) GROUP BY 1, 2)",
    "p7_ledger_instruction": f"WITH {_said('ledger')}, t AS (SELECT k, replace(replace(text, '把', ''), '的单元', '') AS t FROM said), r AS (SELECT k, t, trim(CASE WHEN regexp_matches(t, '(.+?)给') THEN regexp_extract(t, '(.+?)给', 1) ELSE split_part(t, '给', 1) END) AS raw FROM t) SELECT k, nullif(regexp_extract(t, '{I.OWNER}', 1), '') AS owner, nullif(CASE WHEN regexp_matches(raw, '{I.SIDE_END}') THEN trim(regexp_extract(raw, '{I.SIDE_END}', 1)) ELSE raw END, '') AS term, CASE WHEN regexp_matches(raw, '{I.SIDE_END}') THEN regexp_extract(raw, '{I.SIDE_END}', 2) END AS side FROM r",
    "p8_zone_operation": f"WITH {_said('zone')}, z AS (SELECT k, text, regexp_extract_all(text, '{I.REFERENCE}', 1) AS r FROM said), o AS (SELECT *, CASE WHEN regexp_matches(text, '{I.MERGE}') THEN CASE WHEN len(r) >= 2 THEN 'merge' END WHEN regexp_matches(text, '{I.ZONE_TRANSFER}') THEN 'transfer_direction' WHEN regexp_matches(text, '{I.SPLIT}') AND len(r) > 0 THEN 'split' WHEN regexp_matches(text, '{I.DELETE}') AND len(r) > 0 THEN 'delete' END AS op FROM z), e AS (SELECT k, unnest(r) AS ref FROM z), c AS (SELECT k, ref, (SELECT count(*) FROM supplier WHERE contains(s_name, ref)) AS n FROM e) SELECT k, array_to_string(r, '|') AS refs, op, CASE WHEN op = 'transfer_direction' THEN regexp_extract(text, '{I.ZONE_TRANSFER}', 2) END AS side, CASE WHEN op = 'split' AND regexp_matches(text, '{I.CUT}') THEN regexp_extract(text, '{I.CUT}', 1) END AS cut, coalesce(resolved, false) AS resolved FROM o LEFT JOIN (SELECT k, bool_and(n = 1) AS resolved FROM c GROUP BY 1) USING (k)",
    "p10_street_aliases": "WITH s AS (SELECT p_partkey AS k, p_brand || CASE p_partkey % 3 WHEN 0 THEN '街道' WHEN 1 THEN '镇' ELSE '' END AS street, p_brand AS core FROM part) SELECT DISTINCT alias, k FROM (SELECT k, street AS alias FROM s UNION ALL SELECT k, core FROM s UNION ALL SELECT k, substr(core, 1, length(core) - 1) FROM s)",
    "p24_sided_bounds": f"WITH {_said('contract')}, pattern AS (SELECT '([A-Za-z0-9一-鿿（）()·\\-]{{2,16}}?)以([东南西北])' AS p), x AS (SELECT k, unnest(regexp_extract_all(text, '([A-Za-z0-9一-鿿（）()·\\-]{{2,16}}?)以([东南西北])', 1)) AS x, unnest(regexp_extract_all(text, '([A-Za-z0-9一-鿿（）()·\\-]{{2,16}}?)以([东南西北])', 2)) AS side, unnest(range(len(regexp_extract_all(text, '以([东南西北])')))) AS p FROM said), m AS (SELECT DISTINCT replace(p_brand, '#', '') AS name FROM part), j AS (SELECT k, p, side, min(name) AS name FROM x JOIN m ON contains(name, x) OR (length(x) >= 3 AND contains(x, name)) GROUP BY 1, 2, 3) SELECT k, {_SIDE} AS side, arg_min(name, p) AS landmark FROM j GROUP BY 1, 2",
}
