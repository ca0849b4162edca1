"""Operator 6, exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks. For a block of candidates each dimension gets a list sorted by component. A query walks the
lists from their favourable ends; every vector that it meets is scored whole, and no vector not yet met can score above
the sum of the products at the places reached. It stops when that bound is below its kth score, or when it has met every
vector of the block, and not before: no depth or size ends the walk. Lists need not be walked evenly for the bound to hold,
so each step goes to the list where an entry lowers the bound most. Lists of k per block are merged.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import checkpoint, ship

SCALE, K, EVERY = 64, 20, 20
#: Vectors in a block of candidates and in a block of queries.
CANDIDATES, QUERIES = 16384, 4096
#: Entries that a list is walked at once, at first and at most (a share of the list); entries of the first round for each query.
STEP, STEPS, FIRST = 16, 64, 1024


#: Scores are shown as longs; those beyond are ranked by their own value and shown as the nearest long.
MOST = (1 << 63) - 1


def whole(vector: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x as ``v``, whole numbers as doubles, and ``raw`` false. If a product leaves the
    range of doubles, x itself and ``raw`` true. Null if the vector or a component is null or not finite."""
    col = F.col(vector) if isinstance(vector, str) else vector
    wide = F.transform(col, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    raw = F.exists(wide, lambda x: F.abs(x * scale) == float("inf"))
    floors = F.transform(wide, lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale))  # doubles from 2^52 on are whole
    return F.when(col.isNotNull() & ~bad, F.struct(F.when(raw, wide).otherwise(floors).alias("v"), raw.alias("raw")))


def integers(v: np.ndarray, raw: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Rows that :func:`whole` made as integers: int64, or Python's own if one is too large for that."""
    if not raw.any() and np.abs(v).max(initial=0) < float(1 << 62):
        return v.astype(np.int64)
    out = np.empty(v.shape, object)
    for k, (row, r) in enumerate(zip(v.tolist(), raw.tolist(), strict=True)):
        out[k] = [(int(x) * scale if abs(x) >= 1 << 52 else floor(x * scale)) if r else int(x) for x in row]
    return out


def order_key(score: int) -> tuple[int, int, str]:
    """(beyond, score, digits), which sorts as whole scores do: beyond is 0 for longs, else the sign, and digits tells scores
    beyond the range of longs apart."""
    if abs(score) <= MOST:
        return 0, score, ""
    digits = str(abs(score))
    if score > 0:
        return 1, MOST, f"{len(digits):05d}{digits}"
    return -1, -MOST, f"{99999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


class Lists:
    """A block of candidates as lists, one for each dimension and direction, each sorted from its favourable end."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        columns = np.ascontiguousarray(x.T)
        wide = columns.dtype if columns.dtype == object else np.int64
        if np.abs(columns).max() < 1 << 15:
            columns = columns.astype(np.int16)
        up = np.argsort(columns, axis=1, kind="stable")
        self.order = np.ascontiguousarray(np.stack([up, up[:, ::-1]]))  # [0] rising, for negative weights; [1] falling
        rising = np.take_along_axis(columns, up, 1).astype(wide)
        widths = np.unique(np.minimum(n, np.concatenate([STEP * 2 ** np.arange(0, 5), n * np.arange(1, STEPS + 1) // STEPS])))
        self.places = np.concatenate([[0], widths[widths > 0]])  # a walk stops at these depths
        last = np.maximum(self.places - 1, 0)
        self.values = np.stack([rising[:, last], rising[:, ::-1][:, last]])  # the least favourable value met by then

    def steps(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, place, entries so far, bound) after each step of the walk for weights ``q``, steepest steps first."""
        side, size = (q > 0).astype(int), np.diff(self.places)
        product = np.abs(q)[:, None] * np.where(side[:, None] == 1, self.values[1], -self.values[0])
        drop = product[:, :-1] - product[:, 1:]
        slope = np.minimum.accumulate(drop // size if drop.dtype == object else drop / size, axis=1)  # a step comes after those before it in its list
        at = np.argsort(-slope.ravel(), kind="stable")
        own, place = np.divmod(at, len(size))
        return own, place, np.cumsum(size[place]), product[:, 0].sum() - np.cumsum(drop.ravel()[at])


def largest(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which ``k`` entries have the largest score, equal ones the smallest place."""
    if len(score) <= k:
        return np.arange(len(score))
    kth = (np.sort(score) if score.dtype == object else np.partition(score, len(score) - k))[len(score) - k]
    above, ties = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
    return np.concatenate([above, ties[np.argsort(place[ties], kind="stable")[: k - len(above)]]])


def threshold_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K, seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best candidates of each query, other ids than its own only; ties to smaller ids.

    ``x`` and ``q`` hold integers. Scores are exact: in floats as long as these hold every sum, then in int64, then in
    Python's integers. ``seen`` collects counts of queries, of those that the bound ended, of entries read and of vectors
    scored.
    """
    n, d = x.shape
    tally = seen if seen is not None else {}
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]  # smaller ids first: position breaks ties
    reach = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * d
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
    exact = object if kind is object else np.int64
    x, q = x.astype(exact), q.astype(exact)
    lists, xs, qs = Lists(x) if n else None, x.astype(kind), q.astype(kind)
    rows, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, exact)]
    for i in range(len(q) if n else 0):
        own, place, read, bound = lists.steps(q[i])
        side = (q[i] > 0).astype(int)
        best, where, met, at, goal = np.empty(0, exact), np.empty(0, np.int64), np.zeros(n, bool), 0, FIRST
        depth = np.zeros(d, np.int64)
        while True:
            kth = best.min() if len(best) == k else None
            enough = len(bound) - np.searchsorted(bound[::-1], kth) if kth is not None else len(bound)  # steps until the bound is below the kth score
            to = max(at + 1, min(int(np.searchsorted(read, goal)) + 1, int(enough) + 1, len(bound)))
            new = np.zeros(n, bool)
            deeper = depth + np.bincount(own[at:to], minlength=d)
            for j in np.flatnonzero(deeper > depth).tolist():
                new[lists.order[side[j], j, lists.places[depth[j]] : lists.places[deeper[j]]]] = True
            depth = deeper
            new = np.flatnonzero(new & ~met)
            met[new] = True
            tally["scored"] = tally.get("scored", 0) + len(new)
            new = new[ids[new] != query_ids[i]]
            best, where = np.concatenate([best, (np.take(xs, new, axis=0) @ qs[i]).astype(exact)]), np.concatenate([where, new])
            keep = largest(best, where, k)
            best, where = best[keep], where[keep]
            at, goal = to, goal * 2
            if len(best) == k and bound[at - 1] < best.min():
                tally["ended"] = tally.get("ended", 0) + int(not met.all())
                break
            if at == len(bound) or met.all():
                break
        tally["queries"], tally["entries"] = tally.get("queries", 0) + 1, tally.get("entries", 0) + int(read[at - 1])
        rows.append(np.full(len(best), i, np.int64))
        found.append(ids[where])
        scores.append(best)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``embeddings`` (vec_id, embedding) whose vec_id is divisible by
    ``every``, the ``k`` other rows of largest integer inner product (all, if fewer), ties to smaller vec_id.

    Ranks follow the exact scores whatever the size of finite components; a score beyond the range of longs is shown as the
    nearest long. Vectors that are null, hold null or non-finite components, or have a null vec_id take no part; vectors of another
    length than the query's aren't compared, empty ones neither. Rows of one vec_id are not candidates of each other; each
    counts as a candidate of others, so a repeated row takes a place for each repeat. A vec_id that occurs in several rows
    with different vectors is a query with each of them, with equal ones once. The query set grows with the table, so both
    sides are dealt in blocks: each block of candidates meets each block of queries in one task of bounded size. No rows
    give no rows.
    """
    spark = ship(embeddings.sparkSession)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale).alias("w")).where("vec_id is not null and size(w.v) > 0")
    vectors = vectors.select("vec_id", "w.v", "w.raw")
    vectors = checkpoint(vectors.groupBy("vec_id", "v", "raw").agg(F.count("*").alias("copies")).withColumns({"d": F.size("v"), "which": F.xxhash64("v", "raw")}))
    n, nq = vectors.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    asks = vectors.where(F.col("vec_id") % every == 0)
    columns = ["b", "qb", "d", "vec_id", "which", "v", "raw", "copies", "ask"]
    candidates = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id", "which"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("ask", F.lit(False))
    asks = asks.withColumn("qb", F.pmod(F.xxhash64("vec_id", "which", F.lit(7)), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.lit(True))
    dealt = candidates.select(columns).unionByName(asks.select(columns))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["ask"].to_numpy(bool)
        x = integers(np.stack(pdf["v"].to_numpy()), pdf["raw"].to_numpy(bool), scale)
        ids, copies = pdf["vec_id"].to_numpy(np.int64), np.minimum(pdf["copies"].to_numpy(np.int64), k)
        more = np.repeat(np.flatnonzero(~own), copies[~own])  # k of the same row fill any answer
        row, found, score = threshold_top(ids[more], x[more], ids[own], x[own], k)
        beyond, shown, digits = zip(*map(order_key, score.tolist()), strict=True) if len(score) else ((), (), ())
        return pd.DataFrame({"query_id": ids[own][row], "which": pdf["which"].to_numpy(np.int64)[own][row], "vec_id": found, "score": np.array(shown, np.int64), "beyond": np.array(beyond, np.int32), "digits": np.array(digits, object)})

    found = dealt.groupBy("b", "qb", "d").applyInPandas(work, "query_id long, which long, vec_id long, score long, beyond int, digits string")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
