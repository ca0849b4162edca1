"""Exact ranks of very large components."""

from __future__ import annotations

import random
import sys
from math import floor
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from terrane.llm import topk  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def exact(x, scale=64):
    return int(x) * scale if abs(x) >= 1 << 52 else floor(x * scale)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e6, 1e9, 1e15, 1e300, 1.7e308])
def test_top_k_of_large_components_equals_python_integers(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES", 30)
    r = random.Random(int(size % 997))
    rows = [(k, [size * r.uniform(-1, 1) for _ in range(5)]) for k in range(80)]
    rows += [(80 + k, list(rows[k][1])) for k in range(10)] + [(90, [0.5] * 5), (91, [float("inf")] * 5), (92, [0.0] * 5), (93, None), (100, [size] + [0.25] * 4)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, score int")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df).collect()}
    whole = {k: [exact(x) for x in v] for k, v in rows if v is not None and k != 91}
    want = {}
    for q in (k for k in whole if k % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), k) for k, v in whole.items() if k != q)
        for place, (score, k) in enumerate(scored[:20], 1):
            want[q, place] = (k, max(-topk.MOST, min(topk.MOST, -score)))
    assert got == want
