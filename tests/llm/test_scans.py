"""Prefix trie, periodic runs and licence scan against brute force, with hot groups, ties, nulls, repeats and long rows."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from terrane.llm import licence_scan, periodic_runs, prefix_trie  # noqa: E402

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def trie(rows):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text) rows, by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = set(), {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        out.add((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], SHA(",".join(map(str, ends[node])))))
    return out


def turns(case):
    r = random.Random(case)
    said = ["hello", "", "ü" * 3, "what", None, "yes", "no", "x" * 50]
    rows = []
    for c in [*range(-6, 40), 10**12, 10**12 + 3]:
        for t in range(r.randrange(1, 12)):
            hot = t < 2 and c % 3 == 0
            rows.append((c, None if r.random() < 0.05 else t, "user" if t % 2 == 0 else r.choice(["bot", None]), "hello" if hot else r.choice(said)))
    rows += [(7, t % 40, "user", f"t{t % 4}") for t in range(150)]  # a third of all rows, with equal turn numbers
    rows += [(12, t, "user", f"t{t % 4}") for t in range(60)] + [(13, t, "user", f"t{t % 4}") for t in range(60)]
    rows += rows[:5] + [(None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize(("case", "segment", "bits"), [(1, 4096, 12), (2, 4, 12), (3, 5, 3), (4, 1, 1)])
def test_trie_equals_brute_force(spark, case, segment, bits):
    rows = turns(case)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, kind int").repartition(3)
    got = prefix_trie.prefix_trie(df, segment, bits).drop("node", "n_ends").collect()
    want = trie(rows)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_trie_of_nothing_and_of_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = prefix_trie.prefix_trie(spark.createDataFrame([(lone, 0, "user", "cut")], empty.schema)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in got] == [(lone, 0, 1, 1, SHA(str(lone)))]


def plain_runs(w, least, times):
    """Maximal stretches of equality with the words p earlier, of smallest period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        k = 0
        while k < len(w) - p:
            j = k
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - k + p >= max(least, times * p):
                found.setdefault((k, j - k + p), p)
            k = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def test_lyndon_lengths_equal_the_definition():
    r = random.Random(5)
    for _ in range(300):
        w = [r.randrange(3) for _ in range(r.randrange(1, 25))]
        names = {}
        w = [names.setdefault(x, len(names)) for x in w]
        for i, n in enumerate(periodic_runs.lyndon_lengths(w)):
            assert n == max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j)))


def test_runs_equal_plain_search():
    r = random.Random(6)
    for _ in range(400):
        a, w = r.choice([1, 2, 3, 30]), []
        while len(w) < 150:
            u = [r.randrange(a) for _ in range(r.randrange(1, 30))]
            w += [u[i % len(u)] for i in range(r.randrange(1, 5 * len(u)))] + [r.randrange(a) for _ in range(r.randrange(20))]
        words = [b"%d" % x for x in w]
        assert periodic_runs.text_runs([[b"one"], words, [], words[::-1]]) == [[], plain_runs(words, 24, 3), [], plain_runs(words[::-1], 24, 3)]
        names = {}
        assert periodic_runs.runs_of(np.array([names.setdefault(x, len(names)) for x in w[:60]]), 2, 2) == plain_runs(w[:60], 2, 2)


def test_run_digests_equal_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \t\n", "word", "a " * 24, "a " * 23, "a b c " * 9 + "d", ("x y " * 20 + "z ") * 4, "é é " * 30, "w " * 200_000]
    texts += [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(400))) for _ in range(120)]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(None, texts[6], 1), (None, None, 2), (6, texts[6], 3)]
    got = periodic_runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(2)).collect()
    want = []
    for doc, text, _ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = [(0, len(w), 1)] if len(w) == 200_000 else plain_runs(w, 24, 3)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        kept = set(range(len(w))) - {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], SHA("".join(f"{s},{n},{p}\n" for s, n, p in runs)), SHA(b" ".join(w[i] for i in sorted(kept)).decode())))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(x[1] > 0 for x in want) > 8
    assert periodic_runs.run_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licences_of_edge_cases(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, None), (2, ""), (3, "--- \n"), (4, "CC BY. cc-by! Cc BY"), (5, "GENERAL PUBLIC"), (6, "All rights reserved. all rights\nreserved"), (7, gpl), (7, gpl), (None, gpl),
        (8, "public license"), (9, "Licensed under CC BY-NC 4.0."), (10, "ccby all right reserved"), (11, "all rights é reserved"), (12, "x " * 200_000 + "All Rights Reserved"), (13, "released under the mit"), (14, "MIT License"),
    ]
    df = spark.createDataFrame([(*r, "a", 0) for r in rows], "doc_id long, text string, w string, hits int")
    got = sorted(map(tuple, licence_scan.licences(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    gpl_row = (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0)
    assert got == [
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 6, 3, 0, 4, "cc-by", "cc-by", 1.0), (5, 2, 0, None, None, "", "", 0.0),
        (6, 6, 2, 0, 3, "reserved", "reserved", 1.0), (7, *gpl_row), (7, *gpl_row), (8, 2, 0, None, None, "", "", 0.0), (9, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0), (10, 4, 0, None, None, "", "", 0.0),
        (11, 4, 0, None, None, "", "", 0.0), (12, 200_003, 1, 200_000, 200_000, "reserved", "reserved", 1.0), (13, 4, 0, None, None, "", "", 0.0), (14, 2, 0, None, None, "", "", 0.0), (None, *gpl_row),
    ]
    assert licence_scan.licences(df.limit(0)).collect() == []


def test_licence_index_files_rare_words_and_agrees_on_places(spark):
    entries = licence_scan.phrases()
    counts = {w: 100 if w in ("the", "license", "by") else 1 for _, _, key, _ in entries for w in key}
    for (_, _, key, _), own in zip(entries, licence_scan.index(entries, counts), strict=True):
        assert 1 <= len(own) <= 2
        assert all(key[at] == w for w, at in own)
        assert max(counts[w] for w, _ in own) <= sorted(counts[w] for w in key)[len(own) - 1]
    part = "permission is hereby granted free of charge to any person"
    got = licence_scan.licences(spark.createDataFrame([(1, part)], "doc_id int, text string")).first()
    assert got.labels == "mit"
    assert abs(got.score - 10 / 20) < 1e-9
