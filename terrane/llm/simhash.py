"""Operator 5, SimHash near-duplicates by a generalised pigeonhole.

Fingerprints: bit by bit, the majority over the XXH64 hashes of all word shingles of a text. Links: fingerprints that differ
in few bits. If 64 bits are cut into m partitions with thresholds t1..tm that sum to tau - m + 1, two fingerprints within
tau bits are within t_i in some partition i; a threshold of -1 leaves a partition out. Correlated bits go to the same
partition, and a dynamic program gives each partition the threshold that makes signatures and expected candidates
cheapest, from bit statistics over all fingerprints. Each fingerprint is filed under its bits of a partition and, where the
threshold is above 0, probes all values within it. Candidates are verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.components import components
from terrane.llm.text import by_slices
from terrane.session import checkpoint, ship

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Rows of one bucket that a task compares with each other; larger buckets are cut into blocks of half as many.
BLOCK = 8192
#: Cost of comparing a candidate pair in a task, against that of moving a signature.
PAIR_COST = 0.1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the word shingles of a text, repeats included; a text of few words is one shingle, no word gives none."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = np.concatenate([[0], ends[:-1]])
    spans = zip(starts[: len(own) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(own) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit by bit the majority of ``hashes``; 0 if there are none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 if it has no word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of ``documents`` (doc_id, text); fp holds the 64 bits as a signed long. No shuffle."""
    ship(documents.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, fp bigint")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of rows in which two bits are both set) over all rows of ``fps`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS), np.int64)
        for batch in batches:
            x = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:BITS] += np.rint(x.T @ x).astype(np.int64)
            total[BITS, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4160 at most
    out = np.zeros((BITS + 1) * BITS, np.int64)
    for r in rows:
        out[r.cell] = r.n
    return int(out[BITS * BITS]), out[: BITS * BITS].reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bits into m groups of nearly equal width, correlated bits together."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        group = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left -= set(group)
        while len(group) < width:
            group.append(max(sorted(left), key=lambda b: tie[b, group].sum()))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def thresholds(n: int, share: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """(cost, threshold of each group) by dynamic programming: thresholds of -1 or more that sum to distance - m + 1."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        apart = np.array([1.0])  # distribution of the distance within the group between two rows
        for b in group:
            differ = 2 * share[b] * (1 - share[b])
            apart = np.convolve(apart, [1 - differ, differ])
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, own) in table.items():
            for t in range(-1, distance + 1):
                rows = n * (1 + (t > 0) * sum(comb(len(group), k) for k in range(t + 1))) if t >= 0 else 0
                pairs = n * n / 2 * apart[: t + 1].sum() if t >= 0 else 0
                new = cost + rows + PAIR_COST * pairs
                if used + t not in grown or new < grown[used + t][0]:
                    grown[used + t] = (new, [*own, t])
        table = grown
    return table.get(distance - len(groups) + 1, (float("inf"), []))


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition of the cheapest cut into 1 to distance + 1 partitions."""
    share = np.diag(both) / max(n, 1)
    cuts = [partitions(n, both, m) for m in range(1, distance + 2)]
    best = min((thresholds(n, share, c, distance) + (c,) for c in cuts), key=lambda x: x[0])
    return list(zip(best[2], best[1], strict=True))


def _signatures(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): fp under its own bits of each partition, and as a probe under each value within the threshold."""
    masks = [np.array(sum(1 << b for b in bits), np.uint64) for bits, _ in chosen]
    flips = [np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)] if t > 0 else [], np.uint64) for bits, t in chosen]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, out = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64), []
        for i, (_, t) in enumerate(chosen):
            if t >= 0:
                out.append((np.full(len(fp), i, np.int32), fp & masks[i], fp, np.zeros(len(fp), bool)))
                if t > 0:
                    keys = ((fp & masks[i])[:, None] ^ flips[i][None, :]).ravel()
                    out.append((np.full(len(keys), i, np.int32), keys, np.repeat(fp, len(flips[i])), np.ones(len(keys), bool)))
        part, key, own, probe = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(probe)], ["part", "key", "fp", "probe"])

    return by_slices(fps.select("fp"), work, "part int, key bigint, fp bigint, probe boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _run_links(fp: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of one large bucket, 256 rows against all at once."""
    filed, out = fp[~probe], []
    for k in range(0, len(filed), 256):
        i, j = np.nonzero(np.bitwise_count(filed[k : k + 256, None] ^ fp[None, :]) <= distance)
        differ = filed[k + i] != fp[j]
        if differ.any():
            out.append(forest(filed[k + i][differ], fp[j][differ]))
    return out


def links_in_runs(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal ``key`` (rows sorted by it), as a forest."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(key)]]))
    for s, n in zip(starts[lengths > 48].tolist(), lengths[lengths > 48].tolist(), strict=True):
        out += _run_links(fp[s : s + n], probe[s : s + n], distance)
    small = np.repeat((lengths > 1) & (lengths <= 48), lengths)
    key, fp, probe = key[small], fp[small], probe[small]
    for shift in range(1, 48):
        same = key[shift:] == key[:-shift]
        if not same.any():
            break
        near = same & ~(probe[shift:] & probe[:-shift]) & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= distance) & (fp[shift:] != fp[:-shift])
        if near.any():
            out.append((fp[shift:][near], fp[:-shift][near]))
    if not out:
        return fp[:0], fp[:0]
    return forest(np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges whose components are those of "differ in ``distance`` bits or fewer" among the distinct ``fps`` (fp).

    Buckets of more than BLOCK rows are cut into blocks, each pair of which is one unit of work; all pairs of a bucket are
    compared, but only a spanning forest leaves a task, so dense groups don't multiply rows.
    """
    n, both = bit_statistics(fps)
    rows = _signatures(fps, plan(n, both, distance))
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    cut = rows.join(sizes, ["part", "key"], "left")
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.least(own, other) * blocks + F.greatest(own, other))
    cut = cut.withColumn("block", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(pair)))
    cut = cut.select(F.xxhash64("part", "key", "block").alias("bucket"), "fp", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def found(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
            a, b = links_in_runs(key, fp.view(np.uint64), probe, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
            if len(held[0]) < 1 << 18 or held[0][0] == held[0][-1]:
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            yield found(*(h[:end] for h in held))
            held = [h[end:] for h in held]
        yield found(*held)

    return cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents`` (doc_id, text).

    Texts of equal fingerprint are pre-aggregated to one row before links are sought. component_id is the smallest doc_id
    that can be reached over links, the row's own included; null ids are passed over (null if a component has no other).
    Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows give a row each; an empty
    table gives no rows. The fingerprint is 16 lower-case hex digits of the unsigned value.
    """
    marked = checkpoint(fingerprints(documents, shingle))
    classes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(links(classes.select("fp"), distance)).select(F.col("node").alias("fp"), "label")
    labelled = classes.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(lowest, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
