"""Text columns: bounds, transfer, ledger and zone instructions, names and their resolution.

Substring matches are equi-joins: every part of each known name is a row of an alias table, whose size is the names' number
times the square of their length, and which is aggregated to one row per part before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.containment_index import contained

# Sentence patterns in order, name endings, zone operations and side words.
TRANSFERS = [
    "把(.+?)的(.+?)划给(.+)",
    "把(.+?)的(.+?)调整给(.+)",
    "把(.+?)的(.+?)移交(?:给)?(.+)",
    "把(.+?)在(.+?)的门店划给(.+)",
    "把(.+?)整体并入(.+)",
    "把(.+?)划给(.+)",
    "^(.+?)不(?:做|干)了[，,]?(?:区域|店|门店|全部|都)?(?:都给|都划给|并入|交给|给)(.+)",
]
SELECTED = 4  # so many of them name an area
WHOLE = "全部"
ENDINGS = ["的门店", "的店", "的围栏", "的店都", "门店", "所有店", "经销商", "区域"]
BOUND = r"([东西南北])至([^，。；、\n]+)"
REFERENCE = r"@([^\s@，。；、,;]+)"
MERGE, SPLIT, DELETE = "合并|融合|并成一个", "拆分|切开|分成两|一分为二", "取消|删除|撤销"
ZONE_TRANSFER = r"(@\S+)\s*(?:的)?(北|南|东|西)(?:部|边|侧)?(?:区域)?\s*(?:划给|给|归|并入)\s*(@\S+)"
CUT = r"沿\s*([^\s@，。；、,;]+)"
OWNER = r"(?:划给|给|归|并入)\s*([^\s，。；,;]+?)(?:$|[，。；,;])"
SIDE_END = "^(.+?)的?(北|南|东|西)(?:部|边|侧)$"
SIDED = r"([A-Za-z0-9一-鿿（）()·\-]{2,16}?)以([东南西北])"
OPPOSITE = {"南": "北", "北": "南", "东": "西", "西": "东"}


def four_bounds(text: Column) -> Column:
    """Map of side to name; of a side named twice the later one counts. Null and unmatched texts give an empty map.

    A later pair replaces an earlier one, so the pairs are read from the end and the first of each side kept.
    """
    t = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(BOUND), F.lit(1)).alias("k"), F.transform(F.regexp_extract_all(t, F.lit(BOUND), F.lit(2)), lambda v: F.trim(v)).alias("v"))
    usable = F.filter(pairs, lambda p: F.length(p["v"]) > 0)
    sides = F.array_distinct(F.transform(usable, lambda p: p["k"]))
    return F.map_from_entries(F.transform(sides, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(usable, lambda p: p["k"] == k), -1)["v"].alias("value"))))


def transfers(instructions: DataFrame, text: str = "text") -> DataFrame:
    """Adds pattern (number of the first that fits, from 0), src, selector and dst; all null for rejected texts."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    number = F.coalesce(*(F.when(t.rlike(p), k) for k, p in enumerate(TRANSFERS)))

    def group(of: list[int | None]) -> Column:
        """Group ``of[k]`` of pattern k; None stands for the whole area."""
        return F.coalesce(*(F.when(F.col("pattern") == k, F.regexp_extract(t, TRANSFERS[k], g) if g else F.lit(WHOLE)) for k, g in enumerate(of)))

    rest = len(TRANSFERS) - SELECTED
    return instructions.withColumn("pattern", number).withColumns({"src": group([1] * len(TRANSFERS)), "selector": group([2] * SELECTED + [None] * rest), "dst": group([3] * SELECTED + [2] * rest)})


def clean_name(name: Column) -> Column:
    """Without quotes and, one after the other, the endings."""
    out = F.regexp_replace(F.trim(name), "^[「」\"']+|[「」\"']+$", "")
    for ending in ENDINGS:
        out = F.regexp_replace(out, ending + "$", "")
    return F.trim(out)


def holders(asked: DataFrame, part: str, names: DataFrame, name: str) -> DataFrame:
    """(part, n, first, exact): for each distinct value of ``part`` of ``asked`` that some values of ``name`` hold, how many do, the
    first of them, and whether one is equal to it."""
    met = contained(asked, names.select(F.col(name).alias("_whole")), part, "_whole")
    return met.groupBy(part).agg(F.count("*").alias("n"), F.min("_whole").alias("first"), F.max((F.col("_whole") == F.col(part)).cast("int")).alias("exact"))


def resolve(asked: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """``asked`` with match and status: NONE if no known name has the asked one as a part, MATCHED if one has or one of many
    is equal to it, else AMBIGUOUS. Null and empty names have no match."""
    found = holders(asked.select(F.col(column).alias("part")), "part", known, name)
    j = asked.join(found, asked[column] == found["part"], "left")
    status = F.when(F.col("n").isNull(), "NONE").when((F.col("n") == 1) | (F.col("exact") == 1), "MATCHED").otherwise("AMBIGUOUS")
    match = F.when(F.col("n") == 1, F.col("first")).when(F.col("exact") == 1, F.col("part"))
    return j.withColumn("match", match).withColumn("status", status).drop("part", "n", "first", "exact")


def ledger_entries(instructions: DataFrame, text: str = "text") -> DataFrame:
    """Adds owner, term and side of "term 给 owner" sentences; a missing owner or term is null, a missing side too."""
    t = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("把"), F.lit("")), F.lit("的单元"), F.lit(""))
    owner = F.regexp_extract(t, OWNER, 1)
    raw = F.trim(F.when(t.rlike("(.+?)给"), F.regexp_extract(t, "(.+?)给", 1)).otherwise(F.split_part(t, F.lit("给"), F.lit(1))))
    sided = raw.rlike(SIDE_END)
    term = F.when(sided, F.trim(F.regexp_extract(raw, SIDE_END, 1))).otherwise(raw)
    return instructions.withColumns({"owner": F.nullif(owner, F.lit("")), "term": F.nullif(term, F.lit("")), "side": F.when(sided, F.regexp_extract(raw, SIDE_END, 2))})


def zone_operations(instructions: DataFrame, text: str = "text") -> DataFrame:
    """Adds refs (the @names in order), op (merge, transfer_direction, split, delete; null if rejected), side and cut."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = instructions.withColumn("refs", F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(1)))
    many = F.size("refs")
    op = F.when(t.rlike(MERGE), F.when(many >= 2, "merge")).when(t.rlike(ZONE_TRANSFER), "transfer_direction").when(t.rlike(SPLIT) & (many > 0), "split").when(t.rlike(DELETE) & (many > 0), "delete")
    out = out.withColumn("op", op)
    return out.withColumns({"side": F.when(F.col("op") == "transfer_direction", F.regexp_extract(t, ZONE_TRANSFER, 2)), "cut": F.when((F.col("op") == "split") & t.rlike(CUT), F.regexp_extract(t, CUT, 1))})


def street_aliases(streets: DataFrame, street: str, key: str) -> DataFrame:
    """(alias, key): full names, names without their ending, and these without their last character."""
    core = F.replace(F.replace(F.col(street), F.lit("街道"), F.lit("")), F.lit("镇"), F.lit(""))
    short = F.when(F.length(core) >= 2, F.substring(core, F.lit(1), F.length(core) - 1))
    alias = F.explode(F.array(F.col(street), core, short))
    return streets.select(alias.alias("alias"), key).where("alias IS NOT NULL AND alias <> ''").distinct()


def sided_bounds(texts: DataFrame, key: str, text: str, landmarks: DataFrame, name: str) -> DataFrame:
    """(key, side, landmark): "X以南" makes X the northern bound, and so on. X must be, be part of, or (from three characters
    on) contain a landmark's name; of several the first by name, of a side's several sentences the first that has one."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(SIDED), F.lit(1)).alias("x"), F.regexp_extract_all(t, F.lit(SIDED), F.lit(2)).alias("w"))
    said = texts.select(key, F.posexplode(found).alias("at", "f")).select(key, "at", "f.x", "f.w")
    side = F.element_at(F.create_map(*(F.lit(v) for kv in OPPOSITE.items() for v in kv)), F.col("w"))
    asked = said.select("x").distinct()
    names = landmarks.select(F.col(name).alias("landmark"))
    within = holders(asked, "x", names, "landmark").select("x", F.col("first").alias("landmark"))
    holding = contained(names, asked.where("length(x) >= 3"), "landmark", "x")
    best = within.unionByName(holding).groupBy("x").agg(F.min("landmark").alias("landmark"))
    return said.join(best, "x").withColumn("side", side).groupBy(key, "side").agg(F.min_by("landmark", "at").alias("landmark"))
