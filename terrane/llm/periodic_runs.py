"""Operator 12, periodic runs of words: Lyndon arrays by Baier grouping, Lyndon roots extended to runs.

Phase one of Baier's suffix sorter refines groups of suffixes from the greatest to the smallest. When a group's turn comes,
the string that its suffixes share is their longest Lyndon prefix, so the phase yields the Lyndon array directly. Every run
holds, under one of an order of words and its reverse, a Lyndon word of its period's length that is the longest at its
place. So the entries of both arrays are all candidates; longest common extensions to both sides make runs of them.

Only stretches of a text in which each window of WINDOW words occurs twice or more can hold a run of at least three periods
and LEAST words: shifted by the period, a window of the run is in the run again. Other words are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import by_slices
from terrane.session import ship

#: A run has at least LEAST words and TIMES periods. WINDOW is a third of LEAST, so that windows repeat for short periods too.
LEAST, TIMES, WINDOW = 24, 3, 8
#: Words compared at once when a common extension begins.
STEP = 32
ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of ``ranks`` (numbers from 0 without gaps).

    Groups are kept in order; ``below`` and ``above`` name a group's neighbours. Places of groups that had their turn are
    taken out of the list of places, so a place's nearest smaller suffix to the left is its neighbour there.
    """
    n, count = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(count)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, shares = list(ranks), [1] * count
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    left, right = list(range(-1, n)), list(range(1, n + 2))  # one more place at the end
    out = [0] * n
    at = count - 1
    while at >= 0:
        own, size = sorted(i for i in members[at] if group[i] == at), shares[at]
        members[at] = []
        times: dict[int, int] = {}
        for i in own:
            out[i] = size
            a, b = left[i], right[i]
            left[b] = a
            if a >= 0:
                right[a] = b
                times[a] = times.get(a, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, k in times.items():
            moved.setdefault((k, group[i]), []).append(i)
        for k, old in sorted(moved, reverse=True):  # each goes right after its old group, so more repeats end up higher
            new, after = len(members), above[old]
            members.append(moved[k, old])
            shares.append(shares[old] + k * size)
            below.append(old)
            above.append(after)
            above[old] = new
            if after < len(below):
                below[after] = new
            for i in moved[k, old]:
                group[i] = new
        at = below[at]
    return out


def extension(w: np.ndarray, a: int, b: int) -> int:
    """Length of the longest common prefix of w[a:] and w[b:], where a < b."""
    done, step, n = 0, STEP, len(w) - b
    while done < n:
        k = min(step, n - done)
        same = w[a + done : a + done + k] == w[b + done : b + done + k]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + k, step * 2
    return n


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` (2 or more) periods, in order.

    ``w`` holds numbers from 0 without gaps. Where a run of three periods holds its root the first time, the root follows
    once more whole: candidates without that, or with the same before them, are left out by hashes before any extension.
    """
    n = len(w)
    if n < max(least, times):
        return []
    found: set[tuple[int, int, int]] = set()
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, ODD))])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((w.astype(np.uint64) + np.uint64(1)) * ODD * power[:n])])
    back = w[::-1]
    for ranks in (w, w.max() - w):
        p = np.array(lyndon_lengths(ranks.tolist()), np.int64)
        i = np.flatnonzero(np.arange(n) + p * min(2, times - 1) <= n)
        if times > 2:
            with np.errstate(over="ignore"):
                i = i[(sums[i + p[i]] - sums[i]) * power[p[i]] == sums[i + 2 * p[i]] - sums[i + p[i]]]
            square = np.zeros(n, np.int64)
            square[i] = p[i]
            i = i[(i < p[i]) | (square[i - p[i]] != p[i])]
        for start in i.tolist():
            period = int(p[start])
            right = extension(w, start, start + period)
            earlier = extension(back, n - start - period, n - start)
            length = earlier + period + right
            if length >= max(least, times * period):
                found.add((start - earlier, length, period))
    return sorted(found)


def stretches(doc: np.ndarray, word: np.ndarray, least: int = LEAST, window: int = WINDOW) -> list[tuple[int, int]]:
    """(from, to) of the maximal stretches of at least ``least`` words all of whose windows occur twice or more in their
    document. ``doc`` and ``word``: number of the document and hash of each word; equal hashes by chance only add stretches."""
    n = len(word) - window + 1
    if n < 1:
        return []
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(window):
            h = h * ODD + word[k : n + k]
        h = h * ODD + doc[:n].astype(np.uint64)
    whole = doc[:n] == doc[window - 1 :]
    order = np.argsort(h, kind="stable")
    order = order[whole[order]]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    step = np.diff(again)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = [(a, b + window - 1) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return [(a, b) for a, b in cut if b - a >= least]


def text_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each of ``texts`` (lists of words)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    words = [w for t in texts for w in t]
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if times >= 3 and least >= 3 * WINDOW:
        parts = stretches(doc, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), least)
    else:
        parts = list(zip(offset.tolist(), (offset + sizes).tolist(), strict=True))
    for a, b in parts:
        names: dict[bytes, int] = {}
        w = np.fromiter((names.setdefault(x, len(names)) for x in words[a:b]), np.int64, b - a)
        if a < b:
            k = int(doc[a])
            out[k] += [(a - int(offset[k]) + s, length, p) for s, length, p in runs_of(w, least, times)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(kept).tolist()]


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES, edit: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id and RUNS of every row of ``documents`` (doc_id, text).

    runs: all maximal stretches of consecutive words with smallest period ``period`` and at least ``least`` words and
    ``times`` periods, by start and period. collapsed: the words left once each run keeps its first period only, joined by a
    space. ``edit`` may change a text's words, given doc_id as text, before runs are looked for.

    Words are runs without ASCII white space. Null, empty and blank texts have no words, no runs and an empty collapsed text.
    Repeated rows give a row each, null ids are kept, other columns ignored; no rows give no rows. Whole texts are read,
    however long; no shuffle. A task holds the words of a slice of texts, or of one longer text.
    """
    ship(documents.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
        if edit is not None:
            texts = [edit(None if d is None else str(d), t) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
        runs = text_runs(texts, least, times)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        found = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], kind)
        rest = pa.array([b" ".join(collapsed(t, own)).decode() for t, own in zip(texts, runs, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), found, rest], ["doc_id", "n_words", "runs", "collapsed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, {RUNS}")


def looped(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """``words``, of every tenth document by hash with a tail that repeats a few of them; without doc_id as they are."""
    n, h = len(words), zlib.crc32((doc_id or "").encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli; ties: smallest start, then
    period; null without runs), runs_sha256 and collapsed_sha256 of each row of :func:`periodic_runs`."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", nothing, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))  # runs come by start and period
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def run_digests(documents: DataFrame) -> DataFrame:
    """:func:`digests` of the runs of ``documents`` once every tenth has been given a loop."""
    return digests(periodic_runs(documents, edit=looped))
