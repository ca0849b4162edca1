"""Operator 10, sharding by bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import stored

#: Bytes that a row counts besides its text.
ROW_BYTES = 8
#: A cut moves to the nearest border of its group of equal texts if that is at most this share of a shard away.
SHIFT = 1 / 32
#: Parts of groups that one task puts in order, parts by hash of doc_id that a group can have, and copies dealt out at once.
PER_PARTITION, PARTS, COPIES = 200_000, 4096, 1000


def moved_cuts(total: int, shards: int, groups: list[tuple[int, int]], shift: float = SHIFT) -> list[float]:
    """Where the prefix sums are cut: at equal targets, each moved to the nearer end of the group (start, bytes) round it, the
    first of equally near ones, if that is at most ``shift`` of a shard away."""
    target = total / shards
    out = []
    for k in range(1, shards):
        at = total * k / shards
        ends = [x for start, own in groups if start < at < start + own for x in (start, start + own)]
        near = min(ends, key=lambda x: (abs(x - at), x), default=at)
        out.append(float(near) if abs(near - at) <= shift * target else at)
    return out


def balanced_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``documents`` (doc_id, text).

    Rows stand in the order of a 64-bit hash of their text, equal texts side by side, these in order of a hash of doc_id and
    of doc_id. Totals of bytes and rows are summed for each range of hashes; prefix sums over these few totals give each
    range its start, and sums within a range the start of each row. The order is cut at equal targets of bytes, so shards
    are contiguous; a row belongs to the shard of its middle byte.

    Groups of equal texts: a cut within a group moves to the group's nearer end if that is at most SHIFT of a shard away, else
    it stays and cuts the group by rows. So a group of up to twice SHIFT is never cut, and shards differ from the target by
    twice SHIFT, or by a row, at most. One rule holds for groups of every size.

    slot counts the rows of a shard from 0 without gaps. Null text: 8 bytes, crc32 0, grouped with the empty text. Null
    doc_ids are ordinary ones; repeated rows are counted before they are put in order and dealt out again by many tasks. The
    result depends on the rows alone, not on how they are split. An empty table gives no rows. law is 'bytes'; grown_shard
    is null, as one more shard moves all cuts.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n"))
    rows = stored(rows.withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")), "sizes")
    group, keys = ["h", "text_crc32", "size"], ["h", "text_crc32", "size", "sub"]
    parts = stored(rows.groupBy(*keys).agg(F.sum("n").alias("n")), "parts")
    total, n_parts = parts.agg(F.sum(F.col("n") * F.col("size")), F.count("*")).first()

    bits = max(1, ((n_parts or 0) // PER_PARTITION).bit_length())
    parts = parts.withColumn("range", F.shiftright("h", 64 - bits))  # ordered as h is
    ranges = parts.groupBy("range").agg(F.sum("n").alias("rn"), F.sum(F.col("n") * F.col("size")).alias("rb"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2 to the bits rows at most
    ranges = ranges.select("range", F.coalesce(F.sum("rn").over(earlier), F.lit(0)).alias("rn0"), F.coalesce(F.sum("rb").over(earlier), F.lit(0)).alias("rb0"))
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(ranges, "range").withColumns({"n0": F.col("rn0") + F.coalesce(F.sum("n").over(within), F.lit(0)), "b0": F.col("rb0") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(within), F.lit(0))})
    parts = stored(parts.select(*keys, "n", "n0", "b0"), "starts")

    extents = parts.groupBy(*group).agg(F.min("b0").alias("start"), F.sum(F.col("n") * F.col("size")).alias("own"))
    inside = F.floor(F.col("start") * shards / (total or 1)) < F.ceil((F.col("start") + F.col("own")) * shards / (total or 1)) - 1
    cuts = moved_cuts(total, shards, [tuple(r) for r in extents.where(inside).select("start", "own").collect()]) if total else []  # a group for each cut at most

    before = Window.partitionBy(*keys).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("r", F.coalesce(F.sum("n").over(before), F.lit(0))).join(parts.drop("n"), keys)
    placed = placed.select("doc_id", "size", "text_crc32", "n", (F.col("n0") + F.col("r")).alias("i"), (F.col("b0") + F.col("r") * F.col("size")).alias("b"))
    columns = ["doc_id", "size", "text_crc32", (F.col("i") + F.col("c")).alias("i"), (F.col("b") + F.col("c") * F.col("size") + F.col("size") / 2).alias("middle")]
    few = placed.where(F.col("n") <= COPIES).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(columns)
    many = placed.where(F.col("n") > COPIES).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("k")
    many = many.withColumn("c", F.explode(F.sequence(F.col("k") * COPIES, F.least(F.col("n") - 1, (F.col("k") + 1) * COPIES - 1)))).select(columns)
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("middle"))) if cuts else F.lit(0)
    spots = stored(few.unionByName(many).withColumn("shard", shard.cast("int")), "spots")
    first = spots.groupBy("shard").agg(F.min("i").alias("first"))
    out = spots.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select(F.col("doc_id").cast(kind), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("i") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
