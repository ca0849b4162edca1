"""The corpus queries on whole small tables: against libraries, SQL and brute force, with hot groups, ties, nulls and repeats."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import ahocorasick
import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from terrane.llm import host_rules, langid, mixing, pieces, quality_mil, queries, sharding, simhash, text, topk  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    order = [rel.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(cell, r)) for r in got.collect()) == sorted(tuple(cell(r[k]) for k in order) for r in rel.fetchall())


def test_codec_equals_library_on_the_whole_table(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.QUERIES["op9_piece_codec"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_counts_equal_library_on_the_whole_table(spark, texts):
    v = pieces.load(pieces.default_model())
    hf = Tokenizer(models.Unigram([(p, v.scores.get(p, 0.0)) for p in v.texts], unk_id=0, byte_fallback=True))
    for r in queries.QUERIES["op1_token_counts"](spark, SF).collect():
        t = texts[r.doc_id]
        assert r.n_tokens == (len(hf.encode(pieces.escaped(t)).ids) if t else 0)


def test_walk_ends_by_the_bound_on_skewed_vectors_and_meets_all_on_even_ones():
    rng = np.random.default_rng(1)
    for spread, some in ((np.geomspace(200, 0.5, 16), True), (np.full(48, 8.0), False)):
        x = np.floor(rng.normal(0, 1, (4000, len(spread))) * spread).astype(np.int64)
        ids, seen = np.arange(4000), {}
        row, found, score = topk.threshold_top(ids, x, ids[:40], x[:40], 20, seen)
        for q in range(40):
            best = sorted((-int(s), c) for c, s in enumerate(x @ x[q]) if c != q)[:20]
            assert sorted((-int(s), int(c)) for s, c in zip(score[row == q], found[row == q], strict=True)) == best
        assert seen["queries"] == 40 and (seen.get("ended", 0) == 40 and seen["scored"] < 40 * 2000) == some, seen


def test_top_k_of_ties_repeats_and_other_lengths(spark):
    data = [(k, [1.0, 0.0]) for k in range(0, 30)] + [(50, [2.0, 0.0])] * 3 + [(20, [1.0, 0.0])] + [(60, [1.0]), (80, [3.0]), (100, []), (120, [0.0, 0.0])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [0, 20, 60, 80, 120]
    assert got[0] == [(50, 8192)] * 3 + [(k, 4096) for k in range(1, 18)]
    assert got[20][:4] == [(50, 8192)] * 3 + [(0, 4096)] and len(got[20]) == 20 and all(v != 20 for v, _ in got[20])
    assert got[60] == [(80, 12288)] and got[80] == [(60, 12288)] and got[120][0] == (0, 0)


def test_mix_deals_hot_repeated_rows_one_by_one(spark):
    rows = [(7, "w " * 50, "a")] * 900 + [(k, "x y z " * (1 + k % 9), "b") for k in range(900)] + [(None, None, None), (None, "one two", None), (3, "", "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and (g.taken <= 3 * g["size"]).all()
    hot = out[(out.doc_id == 7) & (out["size"] == 50)]
    assert len(hot) == 900 and hot.taken.nunique() == 2


def test_mix_of_a_split_tie_keeps_other_columns(spark):
    rows = [(7, "w " * 50, "a", k % 2) for k in range(60)] + [(k, "x y z", "b", 5) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    keyed = mixing.keyed(df)
    out = mixing.taken(keyed, mixing.cuts(keyed.select("source", "mix"))).select("doc_id", "text", "source", "n_chars").collect()
    assert Counter(map(tuple, out)) == Counter(rows)


def plain_shards(rows, shards=24):
    """(doc_id, size, crc32, shard, slot) by sorting all rows in one list."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def sub(doc):
        return 42 % sharding.PARTS if doc is None else signed(xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)) % sharding.PARTS

    def key(row):
        t = (row[1] or "").encode()
        return signed(xxhash.xxh64_intdigest(t, 42)), zlib.crc32(t), len(t) + 8, sub(row[0]), row[0] is not None, row[0] or 0

    order = sorted(key(r) for r in rows)
    sizes = Counter()
    for o in order:
        sizes[o[:3]] += o[2]
    total, start, groups = sum(sizes.values()), 0, []
    for own in dict.fromkeys(o[:3] for o in order):
        groups.append((start, sizes[own]))
        start += sizes[own]
    cuts = []
    for k in range(1, shards):
        at = total * k / shards
        s, n = next(g for g in groups if g[0] <= at < g[0] + g[1])
        near = s if at - s <= s + n - at else s + n
        cuts.append(near if abs(near - at) <= total / shards / 32 else at)
    out, at, slots = [], 0, Counter()
    for o in order:
        shard = sum(c <= at + o[2] / 2 for c in cuts)
        out.append((o[5] if o[4] else None, o[2], o[1], shard, slots[shard]))
        slots[shard] += 1
        at += o[2]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_equal_a_plain_sort(spark, parts):
    cases = {
        "near a shard": [("same", 380)] + [(f"t{k:05d}", 1) for k in range(4000)],
        "many large": [(f"g{k:04d}", 300) for k in range(20)] + [(f"t{k:05d}", 1) for k in range(1000)],
        "one holds a third": [("hot", 3000)] + [(f"t{k:05d}" * (1 + k % 9), 1) for k in range(3000)],
        "long and blank": [("x" * 50_000, 1), ("", 5), (None, 5)] + [("é" * k, 2) for k in range(200)],
        "few": [("a", 1), ("b", 2)],
    }
    for name, groups in cases.items():
        rows = [(None if k % 97 == 0 else 7 if k % 3 == 0 else k // 2, t) for k, t in enumerate(t for t, n in groups for _ in range(n))]
        rows += rows[:1] * 2500 if name == "one holds a third" else []
        out = sharding.balanced_shards(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(parts)).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == Counter(plain_shards(rows)), name
        per, target = Counter(), sum(r.size for r in out) / 24
        for r in out:
            per[r.shard] += r.size
        assert max(abs(per[k] - target) for k in range(24)) <= target / 16 + max(r.size for r in out)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    x = np.concatenate([f for f, _ in quality_mil.encode_runs([" ".join(f"w{v}" for v in rng.integers(0, 40, n)) for n in (10, 70, 200, 65)])])
    bags = quality_mil.Bags(x, np.repeat(np.arange(4), [1, 2, 4, 2]))
    y, p = np.array([0.0, 1.0, 1.0, 0.0]), quality_mil.start(x)
    _, g = quality_mil.loss_and_gradients(p, bags, y)
    for name in g:
        for at in list(np.ndindex(p[name].shape))[:: max(1, p[name].size // 5)]:
            both = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in p.items()}
                moved[name][at] += step
                both.append(quality_mil.loss_and_gradients(moved, bags, y)[0])
            assert abs((both[0] - both[1]) / 2e-5 - g[name][at]) < 1e-6


def test_scores_weigh_all_passages_by_attention():
    rng = np.random.default_rng(4)
    texts_ = [None, "", " ".join(f"w{v}" for v in rng.integers(0, 99, 64 * 300 + 5)), "one two"]
    rows = [np.concatenate([f for f, _ in quality_mil.encode_runs([t])]) for t in texts_]
    assert [len(r) for r in rows] == [1, 1, 301, 1] and np.array_equal(rows[0], rows[1])
    p = quality_mil.start(np.concatenate(rows))
    for got, x in zip(quality_mil.scores(p, texts_), rows, strict=True):
        h = np.tanh((x - p["mean"]) / p["scale"] @ p["E"] + p["e"])
        a = np.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))) @ p["w"])
        z = (a[:, None] * h).sum(axis=0) / a.sum()
        assert got == pytest.approx(1 / (1 + np.exp(-(z @ p["c"] + p["b"][0]))), abs=1e-9)


def test_quality_of_repeated_ids_clashing_labels_and_extra_columns(spark):
    good, bad = "the cat and the other thing were there " * 5, "## $$ ## " * 30
    rows = [(k, good if k % 2 else bad, 1) for k in range(60)] + [(1, good, 2)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (2, 1), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality_mil.quality(df, labels).collect()
    assert len(out) == 360 and all(r.predicted == r.doc_id % 2 for r in out if r.doc_id != 2)
    assert quality_mil.fit(df, labels, sample=7) is not None and quality_mil.fit(df, labels.limit(0)) is None
    lost = spark.range(1000, 61_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").unionByName(labels.selectExpr("doc_id", "cast(quality as int) quality"))
    assert quality_mil.fit(df, lost, sample=20) is not None  # most labels have no document


def small_vocabulary(words):
    automaton = ahocorasick.Automaton()
    for k, w in enumerate(words):
        automaton.add_word(w, (k << 10) | len(w))
    automaton.make_automaton()
    return automaton


def segmentations(word, ids):
    """All ways to cut a word into pieces; a character that is no piece stands for itself as -1."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        piece = ids.get(word[:k], -1 if k == 1 else None)
        if piece is not None:
            for rest in segmentations(word[k:], ids):
                yield [piece, *rest]


@pytest.mark.parametrize("long_word", [64, 3, 0])
def test_language_fit_equals_sums_over_all_segmentations(monkeypatch, long_word):
    monkeypatch.setattr(langid, "LONG_WORD", long_word)
    monkeypatch.setattr(langid, "BLOCK", 3)
    monkeypatch.setattr(langid, "HELD_WORDS", 2)
    vocabulary = ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "bca", "cab"]
    ids = {w: k for k, w in enumerate(vocabulary)}
    counts = Counter({"abca": 3, "aabcab": 2, "b": 5, "axbc": 1, "cabcabcab": 4})
    prob = np.full(11, 0.1)
    prob[-1] = langid.UNKNOWN
    for _ in range(2):
        expected = np.zeros(11)
        for word, n in counts.items():
            ways = [(np.prod([prob[k] for k in way]), way) for way in segmentations(word, ids)]
            for p, way in ways:
                for k in way:
                    expected[k] += n * p / sum(x for x, _ in ways)
        prob = (expected + langid.SMOOTHING) / (expected + langid.SMOOTHING)[:-1].sum()
        prob[-1] = langid.UNKNOWN
    got = langid.fit_language(counts, small_vocabulary(vocabulary), 10, 3, 2)
    assert np.allclose(got, prob[:-1], rtol=1e-9)


def test_language_fit_is_bounded_in_bytes_and_languages(spark):
    rows = [(k, "word " * 2000, f"l{k % 40:02d}") for k in range(400)] + [(1000 + k, "le chat dort", "fr") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, probs, priors = langid.fit(df, sample_bytes=15_000, most=3)
    assert names == ["fr", "l00", "l01"] and probs.shape[1] == 3 and len(priors) == 3


def test_very_long_words_and_texts_of_no_words(spark):
    memo = text.Memo(len, 10)
    assert memo["x" * 100] == 100 and not memo and memo["ab"] == 2 and len(memo) == 1
    df = spark.createDataFrame([(1, "x" * 300_000, "en"), (2, "the cat sleeps", "en"), (3, "é" * 90_000 + " fin", "fr")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.language_of(df).collect()} == {1, 2, 3}
    assert simhash.near_duplicates(df).count() == 3


def test_pipeline_from_end_to_end(spark):
    docs, out = queries.documents(spark, SF), corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r.doc_id for r in docs.collect()}
    rows = out.collect()
    per = Counter(r.doc_id for r in rows)
    assert set(per) <= ids and max(per.values()) <= 3 and len({(r.doc_id, r.ids_sha256) for r in rows}) == len(per)


def test_pipeline_stages_keep_null_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    made = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(4)]
    df = spark.createDataFrame([(None, made[0], "en", "a", 1), (None, made[1], "en", "a", 1), (1, made[2], "en", None, 1), (1, made[3], "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, df, SF)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in df.collect())
    mixed = corpus_pipeline.mix(spark, kept, SF)
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == corpus_pipeline.COLUMNS and sum(copies.values()) == 4 and max(copies.values()) <= 3
    assert sum(n for (k, _), n in copies.items() if k is None) == 3  # source a weighs 5 of 7


def test_pipeline_stages_take_extra_columns_of_any_name(spark):
    docs = queries.documents(spark, SF)
    names = ["target", "epochs", "cut", "part", "source_size", "copies", "mix", "rules", "size", "key", "row", "label", "h", "n", "lang_pred", "score", "kept", "s", "k"]
    wide = docs.select("*", *[F.lit(7).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        plain, more = (stage(spark, df, SF) for df in (docs, wide))
        assert plain.columns == more.columns and Counter(map(tuple, plain.collect())) == Counter(map(tuple, more.collect())), name


def near_groups(rows):
    """Groups of (doc_id, text) rows by similarity 0.8 of five-word shingles, all pairs compared."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                label = [label[i] if x == label[j] else x for x in label]
    return label


def test_pipeline_equals_the_stages_applied_by_hand(spark, tmp_path):
    rng = random.Random(3)
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    word = {"en": ["the", "cat", "house", "with", "water", "green"], "de": ["und", "das", "haus", "nicht", "straße", "grün"]}
    rows = []
    for k in range(120):
        lang = "en" if k % 2 else "de"
        t = " ".join(rng.choice(word[lang]) + (str(rng.randrange(9)) if rng.random() < 0.5 else "") for _ in range(rng.choice([20, 80, 120])))
        rows.append((k, t, lang, "abc"[k % 3], len(t)))
    rows += [(200 + k, rows[k][1] + " more", rows[k][2], "a", 1) for k in range(30)] + [(300, None, None, None, None), (301, "123 !!", None, "b", 0), (302, "same line\n" * 60, "en", "b", 0)]
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    frame = lambda kept: spark.createDataFrame(kept, fields)
    said = {r.doc_id: r for r in langid.identify(frame(rows), frame(rows)).collect()}
    kept = [r for r in rows if said[r[0]].lang_pred != "und" and said[r[0]].score >= 0.5]
    assert {300, 301}.isdisjoint(r[0] for r in kept) and len(kept) >= 145
    rule = {r.doc_id: r.kept for r in host_rules.verdicts(frame(kept)).collect()}
    kept = [r for r in kept if rule[r[0]]]
    assert all(len(r[1].split()) >= 50 for r in kept) and 302 not in {r[0] for r in kept}
    label = near_groups([r[:2] for r in kept])
    first = {}
    for x, r in sorted(zip(label, kept, strict=True), key=lambda p: p[1][0]):
        first.setdefault(x, r)
    kept = list(first.values())
    assert len(kept) < len(label)
    want = Counter()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text_of = {r[0]: r[1] for r in kept}
    for r in mixing.mix(frame(kept)).collect():
        ids = sp.encode(text_of[r.doc_id])
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += r.taken // r.size
    assert got == +want
