"""The corpus operators against libraries and brute force on small fixtures with nulls, empty texts, ties and repeats."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from terrane.llm import components, host_rules, langid, lm_scores, mixing, ngram_trie, piece_codec, pieces, quality_mil, sharding, simhash, text, token_counts, topk  # noqa: E402

TEXTS = [None, "", " ", "\n", "one", "The cat  sat\non the mat.", "The cat sat on the mat. " * 40, "日本語 テキスト 🙂 é ▁x", "a" * 5000, "## $$ 12 || " * 20, "The cat  sat\non the mat."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    data = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], None, 1, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "en", "a", 5, 1, "x"), (5, TEXTS[5], "fr", "b", 3, 1, "x")]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_codec_equals_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in piece_codec.decode(piece_codec.encode(docs)).collect():
        assert list(r.ids) == sp.encode(text[r.doc_id] or "") and r.decoded == sp.decode(list(r.ids))


def test_counts_equal_double_precision_library(docs):
    v = pieces.load(pieces.default_model())
    hf = Tokenizer(models.Unigram([(p, v.scores.get(p, 0.0)) for p in v.texts], unk_id=0, byte_fallback=True))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs).collect():
        assert r.n_tokens == (len(hf.encode(pieces.escaped(text[r.doc_id])).ids) if text[r.doc_id] else 0)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 50, 60)) for _ in range(20)]
    near = [b + " tail" * k for b in base for k in range(3)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(near)], "doc_id long, text string"))
    got = simhash.near_duplicates(df).collect()
    text = Counter((r.doc_id, r.text) for r in df.collect())
    fps = {t: brute_fingerprint(t) for _, t in text}
    assert Counter(r.fingerprint for r in got) == Counter(f"{fps[t]:016x}" for (_, t), n in text.items() for _ in range(n))
    label = {f: f for f in fps.values()}
    for _ in label:
        label = {f: min(label[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
    lowest = {}
    for (d, t) in text:
        if d is not None:
            lowest[label[fps[t]]] = min(d, lowest.get(label[fps[t]], d))
    assert all(r.component_id == lowest.get(label[int(r.fingerprint, 16)]) for r in got)


def test_plan_sums_and_large_buckets(monkeypatch):
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    for n in (10, 10**6, 10**9):
        chosen = simhash.plan(n, (bits.T @ bits) * n // 500)
        assert sorted(b for g, _ in chosen for b in g) == list(range(64)) and sum(t for _, t in chosen) == 3 - len(chosen) + 1
    fp = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fp = np.concatenate([fp, fp ^ np.uint64(5)])
    a, _ = simhash.links_in_runs(np.zeros(120, np.int64), fp, np.zeros(120, bool), 3)
    assert len(a) == 60


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}


def test_trie_finds_all_and_only_its_pairs():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 1 << 24, 20_000))
    trie = ngram_trie.BigramTrie(key >> 12, key & 4095, np.full(len(key), 0.25))
    ask = np.unique(np.concatenate([key, rng.integers(0, 1 << 24, 20_000)]))
    assert (np.isin(ask, key) == (trie.lookup(ask >> 12, ask & 4095) > 0)).all()


def test_lm_scores_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_scores, "PAIRS_PER_SHARD", 50)
    monkeypatch.setattr(lm_scores, "WORDS_PER_SHARD", 10)
    rows_ = docs.collect()
    out = lambda r: zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2
    uni, bi = Counter(), Counter()
    for r in rows_:
        if not out(r):
            w = lm_scores.tokens(r.text)
            uni.update(w)
            bi.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    text = {r.doc_id: r.text for r in rows_}
    for r in lm_scores.score(docs).collect():
        w = lm_scores.tokens(text[r.doc_id])
        p = lambda t: (uni[t] + 1) / (n + v + 1)
        full = sum(log10(bi[u, t] / ((uni[b""] if u is None else uni[u]) + lm_scores.MU) + lm_scores.MU / ((uni[b""] if u is None else uni[u]) + lm_scores.MU) * p(t)) for u, t in zip([None, *w[:-1]], w, strict=True))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(log10(p(t)) for t in w)) and abs(r.score - full) <= ngram_trie.STEP * len(w) + 1e-9


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(k, [float(x) for x in rng.normal(0, 0.2, 8)]) for k in range(300)] + [(20, None), (301, [None] * 8), (302, [float("nan")] * 8), (None, [1.0] * 8)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    x = np.floor(64 * np.array([v for _, v in data[:300]])).astype(int)
    for q in range(0, 300, 20):
        best = sorted(((-int(x[q] @ x[c]), c) for c in range(300) if c != q))[:20]
        assert [got[q, k + 1] for k in range(20)] == [(c, -s) for s, c in best]


def test_shards_are_even_gapless_and_keep_groups(spark):
    df = spark.createDataFrame([(k, f"text {k % 150} " * (k % 7)) for k in range(600)], "doc_id long, text string")
    out = sharding.balanced_shards(df, 4).toPandas()
    per = out.groupby("shard")["size"].sum()
    assert len(out) == 600 and per.max() - per.min() < 0.6 * per.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_mix_reaches_targets_and_limits(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 9), f"s{min(k % 10, 3)}") for k in range(900)], "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert g.target.iloc[0] <= 3 * g["size"].sum() + 1e-6 and abs(g.taken.sum() - g.target.iloc[0]) <= 9
    assert out.groupby("source").target.first().sum() == pytest.approx(out["size"].sum())


def test_languages_and_quality_learn(spark):
    en, fr = "the cat and the other thing were there ", "le chat est dans une autre maison que voici "
    df = spark.createDataFrame([(k, (en, fr)[k % 2] * (1 + k % 3), ("en", "fr")[k % 2]) for k in range(60)] + [(99, "123 ...", None), (100, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.language_of(df).collect()}
    assert all(got[k] == ("en", "fr")[k % 2] for k in range(60)) and got[99] == got[100] == "und"
    junk = spark.createDataFrame([(k, en * 5 if k % 2 else "## $$ ## " * 30) for k in range(80)] + [(200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    scored = {r.doc_id: r for r in quality_mil.quality(junk, labels).collect()}
    assert all(scored[k].predicted == k % 2 for k in range(80)) and 0 <= scored[200].score <= 1


def test_rules_of_edge_cases(docs):
    got = {r.doc_id: r for r in host_rules.verdicts(docs).collect()}
    assert got[0].n_words == 0 and got[6].n_repeat_words == 240 and got[6].base_failed and got[9].n_symbols == 20 * 6


def test_language_scores_equal_word_by_word_forward(docs):
    path = pieces.default_model()
    automaton, size = langid._automaton(path)
    prob = np.random.default_rng(4).dirichlet(np.ones(size), 3).T
    texts = [t for t in TEXTS if t] + ["x" * 40 + " é日本 🙂 " * 30, "many short words " * 9000]
    got = langid.LanguageScorer(path, np.log(prob)).batch(texts)
    full = np.vstack([prob, np.full((1, 3), langid.UNKNOWN)])
    for text, row in zip(texts, got, strict=True):
        want = np.zeros(3)
        for word, n in Counter(text.lower().split()).items():
            if len(word) < 100:
                forward = [np.ones(3)]
                for found in langid.matches_of(automaton, pieces.GAP + word):
                    forward.append(sum(forward[s] * full[k] for s, k in found))
                want += n * np.log(forward[-1])
        if "aaaa" not in text:  # one very long word underflows without rescaling
            assert np.allclose(row, want, rtol=1e-9)
        assert np.isfinite(row).all()


def test_pipeline_stages_keep_columns_and_drop_repeats(spark):
    words_ = "the cat and the dog were in a small house near the old river while people of this town went to market every day with their own bread and some wine so that nobody would stay at home on such a fine morning except for those who had work left from before and could not wait for it any longer".split()
    rng = np.random.default_rng(5)
    made = [" ".join(rng.permutation(words_)) for _ in range(12)]
    rows_ = [(k, t, "en", "a", len(t)) for k, t in enumerate(made)] + [(20, made[0], "en", "b", 1), (1, made[1], "en", "a", 1), (30, None, None, None, None), (31, "", "en", None, 0)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        ids = [r.doc_id for r in docs.collect()]
        if name == "rules":
            assert set(ids) == {*range(12), 20}
        if name == "deduplicate":
            assert sorted(ids) == list(range(12))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_empty_tables(spark, empty):
    for made in (token_counts.token_counts(empty), piece_codec.decode(piece_codec.encode(empty)), simhash.near_duplicates(empty), host_rules.verdicts(empty), mixing.mix(empty), sharding.balanced_shards(empty), lm_scores.score(empty), langid.language_of(empty), quality_mil.quality(empty, empty.select("doc_id", F.lit(1).alias("quality")))):
        assert made.count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_row_gets_a_result(docs):
    n = docs.count()
    for made in (token_counts.token_counts(docs), simhash.near_duplicates(docs), host_rules.verdicts(docs), mixing.mix(docs), sharding.balanced_shards(docs), lm_scores.score(docs), langid.language_of(docs)):
        assert made.count() == n


def test_fit_survives_a_hot_repeated_id(spark):
    rows = [(7, "le chat noir dort", "fr", None, None, 1, "x")] * 500 + [(k, "the black cat sleeps", "en", None, None, 1, "x") for k in range(100, 140)]
    names, log_probs, priors = langid.fit(spark.createDataFrame(rows, SCHEMA), per_language=2)
    assert names == ["en", "fr"] and log_probs.shape[1] == 2
    assert np.allclose(np.exp(priors), [40 / 540, 500 / 540])


def test_spread_keeps_rows_and_follows_the_setting(docs, empty):
    out = text.spread(docs, "doc_id")
    assert out.count() == docs.count() and text.spread(empty, "doc_id").count() == 0
    assert out.rdd.getNumPartitions() >= 4


NUMBERED = "doc_id long, text string, lang string, source string, n_chars long"


def stayed(spark, rows_):
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows_], NUMBERED)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()), key=str)


def five(text_):
    w = text_.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_deduplicate_finds_pairs_of_similarity_080(spark):
    rng = np.random.default_rng(7)
    rows_, alike = [], 0
    for k in range(60):
        words_ = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        changed = list(words_)
        for at in (20, 90, 150)[: k % 3 + 1]:
            changed[at] = "other"
        a, b = " ".join(words_), " ".join(changed)
        assert len(five(a) & five(b)) / len(five(a) | five(b)) >= 0.8
        rows_ += [(2 * k, a), (2 * k + 1, b)]
    far = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows_ += [(500, " ".join(far)), (501, " ".join(far[:120] + [f"u{x}" for x in range(80)]))]
    assert [k for k, _ in stayed(spark, rows_)] == sorted([*range(0, 120, 2), 500, 501], key=str)


def test_deduplicate_links_what_the_first_of_a_bucket_misses(spark):
    words_ = [f"w{x}" for x in range(200)]
    chain = [" ".join([*(f"z{x}" for x in range(k)), *words_[k:]]) for k in range(0, 100, 12)]
    assert len(five(chain[0]) & five(chain[-1])) / len(five(chain[0]) | five(chain[-1])) < 0.5
    assert [k for k, _ in stayed(spark, list(enumerate(chain)))] == [0]


def test_deduplicate_keeps_one_of_each_group_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 100)) for _ in range(4))
    assert stayed(spark, [(None, a), (None, a), (None, b), (3, b), (7, c), (7, d), (7, d)]) == sorted([(None, a), (3, b), (7, c), (7, d)], key=str)
    assert stayed(spark, [(1, a), (5, a + " more"), (5, b)]) == [(1, a), (5, b)]


def test_deduplicate_of_a_dense_group_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = []
    for _ in range(250):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 7)):
            own[at] = f"x{rng.integers(0, 9999)}"
        texts.append(" ".join(own))
    sets, label = [five(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                label = [label[b] if x == label[a] else x for x in label]
    assert 1 < len(set(label)) < 200
    assert [k for k, _ in stayed(spark, list(enumerate(texts)))] == sorted((label.index(x) for x in set(label)), key=str)
