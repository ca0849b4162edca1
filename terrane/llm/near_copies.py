"""Groups of near copies by exact similarity of word shingles, over candidates from SimHash fingerprints (operator 5).

Candidates: texts whose fingerprints over all shingles are linked within 3 bits by the generalised pigeonhole, and texts that
share one of SAMPLES further fingerprints, each the SimHash of a consistent sample of SAMPLE shingles (those least under
as many hash orders). Two sets of similarity J share a given sample's shingles with chance J ** SAMPLE, so a pair of
similarity 0.8 is a candidate with chance 1 - (1 - 0.8 ** 5) ** 24 = 0.9999 at least. Candidates are verified on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import simhash
from terrane.llm.components import components
from terrane.llm.text import by_slices, spread
from terrane.session import checkpoint, freed_shuffles, ship, stored

SHINGLE, SIMILARITY, SAMPLES, SAMPLE = 5, 0.8, 24, 5
#: Odd multipliers and addends of the hash orders, fixed.
_MIX = np.random.default_rng(5).integers(0, 1 << 63, (2, SAMPLES * SAMPLE), dtype=np.uint64) | np.uint64(1)
#: Shingles that are ordered at once, and shingles of a block of keys.
PIECE, BLOCK = 1 << 12, 1 << 17


def row_key() -> Column:
    """Names a row by its id and text; a null id is an id of its own, a null text counts as ''."""
    name = F.when(F.col("doc_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.col("doc_id").cast("string")))
    return F.md5(F.concat(name, F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that an order depends on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def least(own: np.ndarray) -> np.ndarray:
    """The least value under each hash order among the distinct shingle hashes ``own`` (not empty)."""
    low = np.full(SAMPLES * SAMPLE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), PIECE):
        low = np.minimum(low, mixed(own[k : k + PIECE, None] * _MIX[0] + _MIX[1]).min(axis=0))
    return low


def marks(text: str | None) -> tuple[int, int, int, list[int]]:
    """(key of the shingle set, its size, fingerprint over all shingles, fingerprints of the samples) as signed longs."""
    hashes = simhash.shingle_hashes(text, SHINGLE)
    own = np.unique(hashes)
    if not len(own):
        return 0, 0, 0, []
    key = np.bitwise_xor.reduce(mixed(mixed(own) + np.uint64(len(own))))
    samples = least(own).reshape(SAMPLES, SAMPLE)
    bits = np.unpackbits(samples.view(np.uint8).reshape(SAMPLES, SAMPLE, 8), axis=2, bitorder="little").sum(axis=1)
    prints = np.packbits(2 * bits > SAMPLE, axis=1, bitorder="little").view(np.int64).ravel()
    return int(key.view(np.int64)), len(own), int(np.uint64(simhash.majority(hashes)).view(np.int64)), prints.tolist()


def marked(documents: DataFrame) -> DataFrame:
    """(doc_id, row, key, size, fp, samples) of every row of ``documents`` (doc_id, text). No shuffle."""
    ship(documents.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, size, fp, samples = zip(*map(marks, batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(samples, pa.list_(pa.int64()))], ["doc_id", "row", "key", "size", "fp", "samples"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", row_key().alias("row"), "text"), work, f"doc_id {kind}, row string, key bigint, size bigint, fp bigint, samples array<bigint>")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """True if the shingle sets have a similarity of SIMILARITY or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both * 5 >= (len(a) + len(b) - both) * 4


def verified(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): those pairs of ``stars`` (a, b, weight) whose ``texts`` (key, text) are similar.

    The others b of one centre a are dealt to units of BLOCK shingles as expected (weight: shingles of the centre's largest
    bucket). The centre's text is sent once for each unit, each other's text once for each pair; a task holds the shingles of
    one centre and one other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, centre, own = None, None, np.empty(0, np.uint64)
        for batch in batches:
            found, links = [], []
            for u, a, key, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                hashes = np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE))
                if (u.as_py(), a.as_py()) != (unit, centre):  # the centre comes first
                    unit, centre, own = u.as_py(), a.as_py(), hashes
                elif alike(own, hashes):
                    found.append(key.as_py())
                    links.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), pa.array(found, pa.int64())], ["a", "b"])

    blocks = F.ceil(F.col("weight") / BLOCK).cast("int")
    dealt = stars.withColumn("unit", F.xxhash64("a", blocks, F.pmod(F.xxhash64("b"), blocks)))
    centres = dealt.select("unit", "a", F.col("a").alias("key"), F.lit(0).alias("nth")).distinct()
    both = centres.unionByName(dealt.select("unit", "a", F.col("b").alias("key"), F.lit(1).alias("nth")))
    with_text = both.join(texts, "key").repartition("unit").sortWithinPartitions("unit", "a", "nth")
    return with_text.select("unit", "a", "key", "text").mapInArrow(run, "a bigint, b bigint")


def stars_of(filed: DataFrame) -> DataFrame:
    """(a, b, weight): the distinct pairs of a bucket's first key a and another key b of it whose sizes allow the similarity."""
    near = "key <> centre AND 5 * least(size, centre_size) >= 4 * greatest(size, centre_size)"
    return filed.where(near).groupBy(F.col("centre").alias("a"), F.col("key").alias("b")).agg(F.max("weight").alias("weight"))


def links_in_unit(keys: np.ndarray, labels: np.ndarray, left: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) that join the ``labels`` of rows, at least one of them ``left``, with similar shingle sets ``own``.

    All left rows are compared with all others by counting shared shingles; only links between rows whose labels the earlier
    links of the unit haven't joined are returned, so a dense group gives a link for each label and not for each pair.
    """
    sizes = np.array([len(x) for x in own])
    cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, at = np.unique(np.concatenate(own), return_inverse=True)
    flags, labels, out = np.zeros(len(names), np.int32), labels.copy(), []
    for i in np.flatnonzero(left).tolist():
        mine = at[cuts[i] : cuts[i] + sizes[i]]
        flags[mine] = 1
        both = np.add.reduceat(flags[at], cuts)
        flags[mine] = 0
        near = np.flatnonzero((both * 5 >= (sizes[i] + sizes - both) * 4) & (labels != labels[i]))
        for j in near.tolist():
            if labels[j] != labels[i]:
                out.append((int(keys[i]), int(keys[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def links_of_rest(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links within each unit of ``units`` (unit, key, label, left), found on ``texts`` (key, text).

    A unit holds BLOCK shingles of either side as expected, so a task holds a few MB of hashes and one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, {}

        def found() -> pa.RecordBatch:
            keys = np.fromiter(rows, np.int64, len(rows))
            labels, left, own = (list(x) for x in zip(*rows.values(), strict=True)) if rows else ([], [], [])
            links = links_in_unit(keys, np.array(labels, np.int64), np.array(left, bool), own) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for u, key, label, left, text in zip(*(batch.column(k) for k in range(5)), strict=True):
                if u.as_py() != unit and rows:
                    yield found()
                    rows = {}
                unit, known = u.as_py(), rows.get(key.as_py())
                if known is None:
                    rows[key.as_py()] = (label.as_py(), left.as_py(), np.unique(simhash.shingle_hashes(text.as_py(), SHINGLE)))
                elif left.as_py():
                    rows[key.as_py()] = (known[0], True, known[2])
        if rows:
            yield found()

    with_text = units.join(texts, "key").select("unit", "key", "label", "left", "text")
    return with_text.repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(run, "a bigint, b bigint")


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, row, key, label) of every row of ``documents`` (doc_id, text): rows of one label are one group.

    A group is a component of candidate pairs with a similarity of 0.8 or more. Equal shingle sets are one key and always
    one group; texts without words are one group. In each bucket every key first meets the bucket's first key. Keys that
    aren't in its component then meet all other keys of the bucket, so every candidate pair is either tested or already
    connected. They meet in units of a block of such keys and a block of all keys: texts are sent once for each unit, never
    once for each pair, and a unit gives no more links than it has labels.
    """
    freed_shuffles(ship(documents.sparkSession))  # the rounds make more than a hundred shuffles, each with files for every task
    rows = checkpoint(marked(documents))
    classes = checkpoint(rows.where("size > 0").groupBy("key").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("samples").alias("samples")))
    near = components(simhash.links(classes.select("fp").distinct())).select(F.col("node").alias("fp"), F.col("label").alias("near"))
    whole = classes.join(near, "fp", "left").select(F.xxhash64(F.lit(-1), F.coalesce("near", "fp")).alias("bucket"), "key", "size")
    sampled = classes.select("key", "size", F.posexplode("samples").alias("n", "print")).select(F.xxhash64("n", "print").alias("bucket"), "key", "size")
    filed = whole.unionByName(sampled)
    first = filed.groupBy("bucket").agg(F.min(F.struct("key", "size")).alias("c"), F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1").select("bucket", F.col("c.key").alias("centre"), F.col("c.size").alias("centre_size"), "n", "weight")
    filed = checkpoint(filed.join(first, "bucket"))
    stars = stars_of(filed)

    wanted = filed.select("key").distinct().join(rows.groupBy("key").agg(F.min("row").alias("row")), "key")
    texts = spread(documents.select(row_key().alias("row"), "text"), "row")
    texts = stored(texts.join(wanted, "row").select("key", "text").dropDuplicates(["key"]), "candidates")
    linked = checkpoint(verified(stars, texts))

    label = components(linked)
    named = filed.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    at_centre = label.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    named = named.join(at_centre, "centre", "left").withColumn("left", F.col("label") != F.coalesce("centre_label", "centre"))
    named = checkpoint(named.where("n > 2 AND key <> centre").select("bucket", "key", "label", "left", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")))
    open_ = named.where("left").select("bucket").distinct()  # buckets with a key outside their first key's component
    rest = named.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = rest.where("left").withColumn("other", every).select(F.xxhash64("bucket", "block", "other").alias("unit"), "key", "label", "left")
    sides = rest.join(rest.where("left").select("bucket", F.col("block").alias("ask")).distinct(), "bucket")
    sides = sides.select(F.xxhash64("bucket", "ask", "block").alias("unit"), "key", "label", F.lit(False).alias("left"))
    label = components(linked.unionByName(links_of_rest(asks.unionByName(sides), texts))).select(F.col("node").alias("key"), "label")
    return rows.select("doc_id", "row", "key").join(label, "key", "left").select("doc_id", "row", "key", F.coalesce("label", "key").alias("label"))
