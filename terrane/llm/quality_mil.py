"""Operator 2, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by what it says, an embedding of its words hashed
to BUCKETS, and by how it is written, counts over its bytes and repeated words; embedding and encoder are learnt together
with a gated attention (tanh times sigmoid) from document labels alone. The attention weighs the passages, and the weighted
passage representation is scored by a logistic output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.text import by_slices, held_out
from terrane.session import ship

PASSAGE = 64
#: Bounds of the fit: labelled documents, those of smallest id hash, and the bytes of their texts together (the last one may
#: pass it). Whole texts are learnt from.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 6000, 32 << 20
HIDDEN, GATE, STEPS, RATE, DECAY, BATCH = 16, 8, 250, 0.03, 1e-4, 512
CUTOFF = 0.3
#: Added to the spread of a word bucket before it is scaled by it, so that rare words don't count more than frequent ones.
RARE = 0.5
#: Passages whose bytes and word counts a task holds at once.
RUN = 256

#: Byte classes: upper case, digits, symbols, bar, exclamation and question marks, full stops and commas, other ASCII marks, non-ASCII.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,", b"\"'()+-/:;=@[\\]^_`{}~", bytes(range(128, 256))]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k
BUCKETS = 256
SURFACE = len(CLASSES) + 7
FEATURES = SURFACE + BUCKETS


def _repeated(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the same owner has had the same value before."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    again = np.zeros(len(o), bool)
    again[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    out = np.zeros(len(o), bool)
    out[order] = again  # lexsort is stable: the first in text order isn't marked
    return out


def encode_runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of each passage, document of each passage) in runs of RUN passages, in order of the texts.

    A text without words is one passage of zeros, marked so. Beside the texts only a few numbers for each word and the
    features of one run are held, so a very long text costs little more than its words.
    """
    own = [(t or "").encode().split() for t in texts]
    per_doc = np.array([len(w) for w in own], np.int64)
    words = [w for part in own for w in part]
    length = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    nth = np.arange(len(words)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = np.flatnonzero(nth % PASSAGE == 0)
    passage = np.cumsum(nth % PASSAGE == 0) - 1
    three = word.copy()
    three[:-2] = word[:-2] + word[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + word[2:] * np.uint64(0x94D049BB133111EB)
    whole = np.zeros(len(word), bool)
    whole[:-2] = doc[:-2] == doc[2:]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    n = len(first)
    share = lambda flag: np.bincount(passage, weights=flag, minlength=n)
    count = np.bincount(passage, minlength=n).astype(float)
    chars = np.bincount(passage, weights=length, minlength=n)
    rest = np.stack([chars / count / 10, share(same) / count, share(_repeated(passage, word)) / count, share(_repeated(doc, three) & whole) / count, share(_repeated(doc, word)) / count / np.log2(2 + per_doc[doc[first]]), np.log1p(count) / 5], axis=1) if n else np.zeros((0, 6))
    bucket = (word >> np.uint64(20)).astype(np.int64) % BUCKETS
    ends = np.concatenate([first, [len(words)]])
    for k in range(0, n, RUN):
        m = min(RUN, n - k)
        a, b = ends[k], ends[k + m]
        x = np.zeros((m, FEATURES))
        data = np.frombuffer(b"".join(words[a:b]), np.uint8)
        cut = np.concatenate([[0], np.cumsum(length[a:b])])
        for i in range(m):
            x[i, : len(CLASSES)] = np.bincount(_CLASS[data[cut[ends[k + i] - a] : cut[ends[k + i + 1] - a]]], minlength=len(CLASSES) + 1)[:-1]
        x[:, : len(CLASSES)] = np.sqrt(x[:, : len(CLASSES)] / chars[k : k + m, None])
        x[:, len(CLASSES) : SURFACE - 1] = rest[k : k + m]
        x[:, SURFACE:] = np.sqrt(np.bincount((passage[a:b] - k) * BUCKETS + bucket[a:b], minlength=m * BUCKETS).reshape(m, BUCKETS) / count[k : k + m, None])
        yield x, doc[first[k : k + m]]
    empty = np.flatnonzero(per_doc == 0)
    if len(empty):
        blank = np.zeros((len(empty), FEATURES))
        blank[:, SURFACE - 1] = 1
        yield blank, empty


class Bags:
    """Passages sorted by document, with what forward and backward need."""

    def __init__(self, x: np.ndarray, doc: np.ndarray):
        order = np.argsort(doc, kind="stable")
        self.x, self.doc = x[order], doc[order]
        self.first = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.bag = np.cumsum(np.diff(self.doc, prepend=-1) != 0) - 1


def hidden(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Passage representations."""
    return np.tanh(((x - p["mean"]) / p["scale"]) @ p["E"] + p["e"])


def attend(p: dict[str, np.ndarray], h: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
    """Attention weights, weighted representations and scores of bags of passage representations."""
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    a = (t * s) @ p["w"]
    a = np.exp(a - np.maximum.reduceat(a, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}


def loss_and_gradients(p: dict[str, np.ndarray], bags: Bags, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the bags' labels and its gradient for each learnt parameter."""
    f = attend(p, hidden(p, bags.x), bags.first, bags.bag)
    loss = -np.mean(y * np.log(f["y"] + 1e-300) + (1 - y) * np.log(1 - f["y"] + 1e-300))
    d = (f["y"] - y) / len(y)
    per = (d[:, None] * p["c"])[bags.bag]
    da = (per * f["h"]).sum(axis=1)
    da = f["a"] * (da - np.add.reduceat(f["a"] * da, bags.first)[bags.bag])
    gate = da[:, None] * p["w"]
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * per + dt @ p["V"].T + ds @ p["U"].T
    dx = dh * (1 - f["h"] ** 2)
    x = (bags.x - p["mean"]) / p["scale"]
    return loss, {"E": x.T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (da[:, None] * f["t"] * f["s"]).sum(axis=0), "c": f["z"].T @ d, "b": np.array([d.sum()])}


def start(x: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """First parameters for passages like ``x``, with the mean and scale of its features."""
    r = np.random.default_rng(seed)
    draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"E": draw(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1)}
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean**2, 0))
    return p | {"mean": mean, "scale": spread + np.repeat([0.02, RARE], [SURFACE, BUCKETS])}


def train(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to one label per bag (``lengths`` passages each, one after the other in ``x``) by Adam on batches."""
    p, r = start(x, seed), np.random.default_rng(seed)
    learnt = [k for k in p if k not in ("mean", "scale")]
    first, second = ({k: np.zeros_like(p[k]) for k in learnt} for _ in range(2))
    begin, order = np.cumsum(lengths) - lengths, np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(y)):
            order = r.permutation(len(y))
        own, order = order[:BATCH], order[BATCH:]
        rows = np.concatenate([np.arange(begin[k], begin[k] + lengths[k]) for k in own])
        bags = Bags(x[rows].astype(np.float64), np.repeat(np.arange(len(own)), lengths[own]))
        _, g = loss_and_gradients(p, bags, y[own])
        for k in learnt:
            grad = g[k] + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            p[k] = p[k] - RATE * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, np.ndarray] | None:
    """Parameters learnt from ``labels`` (doc_id, quality) and the texts of ``documents``; None without labelled texts.

    The sample is the first ``sample`` documents that have both a label and a text, in order of their id's hash, as long as
    the texts before one have less than ``sample_bytes`` together. Of several labels of one document the smallest counts, of
    several rows of one id the shortest text. Ids and sizes of all labelled documents meet before the sample is taken, so
    labels without a document don't thin it. Only features of this bounded sample reach the driver, as 16-bit floats.
    """
    ship(documents.sparkSession)
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    sizes = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min(F.octet_length("text").cast("long")).alias("bytes"))
    both = sizes.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # the rows of the sample
    ids = both.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") < sample_bytes)
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids.select("doc_id", "quality", "bytes")), "doc_id").where(F.octet_length("text") == F.col("bytes"))  # ``sample`` rows at most
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.concatenate([x for x, _ in encode_runs([t])]).astype(np.float16) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["quality", "x"])

    rows = by_slices(chosen, work, "quality double, x binary").toArrow()
    if not rows.num_rows:
        return None
    bags = rows["x"].to_pylist()
    order = sorted(range(len(bags)), key=lambda k: bags[k])  # the same fit whatever order rows come in
    y = rows["quality"].to_numpy()[order]
    lengths = np.array([len(bags[k]) // (2 * FEATURES) for k in order])
    joined = np.frombuffer(b"".join(bags[k] for k in order), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return train(joined, lengths, y)


def scores(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Score of each text. Only representations of passages are kept from run to run."""
    made = [(hidden(p, x), doc) for x, doc in encode_runs(texts)]
    bags = Bags(np.concatenate([h for h, _ in made]), np.concatenate([d for _, d in made]))
    return attend(p, bags.x, bags.first, bags.bag)["y"]


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``documents`` (doc_id, text) by a classifier learnt from ``labels``.

    Null, empty and blank texts are a bag of one blank passage and get a score too; without labels every score is 0.5.
    All passages of a text count, however long it is. Repeated rows give a row each. No shuffle of texts.
    """
    fitted = fit(documents, labels, sample)
    shared = documents.sparkSession.sparkContext.broadcast(fitted)  # a few thousand numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = np.full(batch.num_rows, 0.5)
        if shared.value is not None and batch.num_rows:
            y = scores(shared.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(y), pa.array((y >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, score double, predicted int")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from the rows that aren't held out."""
    out = score(documents, labels.where(~held_out("doc_id", 5, 0)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
