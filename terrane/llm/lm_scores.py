"""Operator 3, language-model scoring with a sharded Elias-Fano bigram trie.

Tokens: words without ASCII white space, A-Z lower-cased, and one end per text. The model interpolates by a Dirichlet prior:
P(w | u) = (c(u, w) + MU P(w)) / (c(u) + MU) with P(w) = (c(w) + 1) / (N + V + 1). The first part, c(u, w) / (c(u) + MU), is
what the trie holds, quantised downwards; the rest needs single counts only.

No count table is ever whole in one place. Texts are tokenised into blocks of about BLOCK_TOKENS tokens, written once. A
block asks for the counts of its distinct words, each shard of the vocabulary answers from the sums of all blocks; then it
asks for its distinct pairs, and each shard builds the trie of its contexts and answers with codes. A frequent word or pair
thus counts once per block, and requests never outnumber the distinct words and pairs of all blocks. Pairs of very frequent
contexts are dealt over several shards.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.ngram_trie import BigramTrie, restore
from terrane.llm.text import ROWS, held_out
from terrane.session import ship, stored

MU = 50.0
BLOCK_TOKENS = 1 << 20
#: Distinct words and tokens, summed over blocks, that one shard answers for.
WORDS_PER_SHARD, PAIRS_PER_SHARD = 1 << 21, 1 << 21


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.dtype.char.encode() + values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    raw = zstandard.decompress(raw)
    kind = np.dtype(raw[:1].decode())
    return np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and the end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def blocks(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` (doc_id, text, held_out) in blocks: local token ids by falling frequency, words in order of hash."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    id_type = documents.select("doc_id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate(rows)
            seen = np.bincount(ids, minlength=len(local))
            order = np.argsort(-seen, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            lengths = np.array([len(r) for r in rows])
            learnt = np.bincount(ids[np.repeat(~np.array(held), lengths)], minlength=len(local))
            words = list(local)
            by_hash = np.lexsort((np.arange(len(words)), _hashes(words)))
            number += 1
            cells = [pa.array([number]), pa.array([pa.array(docs, id_type).to_pylist()], pa.list_(id_type)), pa.array([held]), pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([pack(rank[ids])]), pa.array([zstandard.compress(b"\n".join(words[k] for k in by_hash), 1)]), pa.array([pack(learnt[by_hash])]), pa.array([pack(rank[by_hash])]), pa.array([len(words)]), pa.array([len(ids)])]
            return pa.RecordBatch.from_arrays(cells, ["block", "docs", "held", "lengths", "tokens", "words", "learnt", "ranks", "n_words", "n_tokens"])

        local: defaultdict = defaultdict()
        local.default_factory = local.__len__
        rows, docs, held, size = [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for doc, text, out in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = tokens(text)
                    rows.append(np.fromiter(map(local.__getitem__, own), np.int32, len(own)))
                    docs.append(doc)
                    held.append(bool(out))
                    size += len(own)
                    if size >= BLOCK_TOKENS:
                        yield block()
                        local.clear()
                        rows, docs, held, size = [], [], [], 0
        if rows:
            yield block()

    return documents.select("doc_id", "text", "held_out").mapInArrow(run, f"block bigint, docs array<{kind}>, held array<boolean>, lengths array<int>, tokens binary, words binary, learnt binary, ranks binary, n_words bigint, n_tokens bigint")


def _ask_words(made: DataFrame, shards: int) -> DataFrame:
    """(shard, block, words, learnt): each block's words by range of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, learnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, n = zstandard.decompress(words).split(b"\n"), unpack(learnt)
                some, cut = np.unique(_hashes(own) * shards >> 32, return_index=True)  # shards that have words of the block
                parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True))
                cells = [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([zstandard.compress(b"\n".join(own[a:b]), 1) for a, b in parts], pa.binary()), pa.array([pack(n[a:b]) for a, b in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["shard", "block", "words", "learnt"])

    return made.select("block", "words", "learnt").mapInArrow(run, "shard int, block bigint, words binary, learnt binary")


def count_words(asked: DataFrame, shards: int) -> DataFrame:
    """(block, shard, counts, ids, total, known): training counts and global ids of each block's words, in the order asked."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        lists = [zstandard.decompress(w).split(b"\n") for w in pdf["words"]]
        coded = pa.chunked_array([pa.array(x, pa.binary()) for x in lists]).combine_chunks().dictionary_encode()
        at = coded.indices.to_numpy()
        totals = np.bincount(at, weights=np.concatenate([unpack(x) for x in pdf["learnt"]])).astype(np.int64)
        ids = np.arange(len(totals), dtype=np.int64) * shards + int(pdf["shard"].iloc[0]) + 1  # 0 is the start of a text
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        first = np.arange(len(pdf)) == 0
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "counts": [pack(totals[x]) for x in np.split(at, cuts)], "ids": [pack(ids[x]) for x in np.split(at, cuts)], "total": first * totals.sum(), "known": first * (totals > 0).sum()})

    return asked.groupBy("shard").applyInPandas(work, "block bigint, shard int, counts binary, ids binary, total bigint, known bigint")


class Block:
    """A block with its words' counts and ids (by local id) and its distinct pairs in the order in which they are asked."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, total: int, shards: int):
        self.docs, self.lengths = row["docs"], np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        answers = answers.sort_values("shard")
        ranks = unpack(row["ranks"])
        self.count, ids = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        self.count[ranks] = np.concatenate([unpack(x) for x in answers["counts"]])
        ids[ranks] = np.concatenate([unpack(x) for x in answers["ids"]])
        self.word = unpack(row["tokens"]).astype(np.int64)
        ends = np.cumsum(self.lengths) - 1
        starts = ends - self.lengths + 1
        context = np.concatenate([[0], self.word[:-1] + 1])  # 0: start of a text
        context[starts] = 0
        pair, self.at = np.unique(context * len(ranks) + self.word, return_inverse=True)
        context, word = pair // len(ranks), pair % len(ranks)
        self.context_count = np.concatenate([[self.count[self.word[ends[0]]]], self.count])[context]  # a start per training text, as there are ends
        self.context, self.next = np.concatenate([[0], ids])[context], ids[word]
        parts = np.clip(-(-self.context_count * 4 * shards // max(total, 1)), 1, shards)
        mixed = lambda x: (x * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 24
        self.shard = (mixed(self.context) + mixed(self.next) % parts) % shards
        self.order = np.lexsort((self.next, self.context, self.shard))
        self.asked, cuts = np.unique(self.shard[self.order], return_index=True)  # shards that have pairs of the block
        self.cuts = [*cuts.tolist(), len(self.order)]


def _rows(made: DataFrame, *more: DataFrame) -> DataFrame:
    """Blocks and the answers to them as rows of one table, to be grouped by block."""
    columns = made.select("block", "docs", "held", "lengths", "tokens", "ranks")
    for df in more:
        columns = columns.unionByName(df, allowMissingColumns=True)
    return columns


def ask_pairs(made: DataFrame, words: DataFrame, total: int, shards: int) -> DataFrame:
    """(shard, block, context, context_count, follow, word, learnt): each block's distinct pairs, contexts in order and how
    many words follow each."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["tokens"].notna()
        b = Block(pdf[own].iloc[0], pdf[~own], total, shards)
        learnt = np.bincount(b.at[np.repeat(~b.held, b.lengths)], minlength=len(b.context))
        out = []
        for n, s in enumerate(b.asked.tolist()):
            rows = b.order[b.cuts[n] : b.cuts[n + 1]]
            context = b.context[rows]
            first = np.flatnonzero(np.diff(context, prepend=-1))
            step = b.next[rows].astype(np.int64)
            out.append((s, int(pdf["block"].iloc[0]), pack(np.diff(context[first], prepend=0)), pack(b.context_count[rows][first]), pack(np.diff(np.concatenate([first, [len(rows)]])).astype(np.int32)), pack(step), pack(learnt[rows].astype(np.int32))))
        return pd.DataFrame(out, columns=["shard", "block", "context", "context_count", "follow", "word", "learnt"])

    return _rows(made, words).groupBy("block").applyInPandas(work, "shard int, block bigint, context binary, context_count binary, follow binary, word binary, learnt binary")


def answer_pairs(asked: DataFrame) -> DataFrame:
    """(block, shard, codes): each shard's trie, built from the training counts of all blocks, answers each block."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        follow = [unpack(x) for x in pdf["follow"]]
        context = np.concatenate([np.repeat(np.cumsum(unpack(x)), f) for x, f in zip(pdf["context"], follow, strict=True)])
        size = np.concatenate([np.repeat(unpack(x), f) for x, f in zip(pdf["context_count"], follow, strict=True)])
        word = np.concatenate([unpack(x) for x in pdf["word"]])
        names, own = np.unique(context, return_inverse=True)
        succ, second = np.unique(word, return_inverse=True)
        pair, first, at = np.unique(own * len(succ) + second, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([unpack(x) for x in pdf["learnt"]]), minlength=len(pair))
        left, right = context[first], word[first]
        known = counts > 0
        trie = BigramTrie(left[known], right[known], counts[known] / (size[first][known] + MU))
        codes = trie.lookup(left, right)[at]
        cuts = np.cumsum([f.sum() for f in follow])[:-1]
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "shard": pdf["shard"].to_numpy(), "codes": [pack(x) for x in np.split(codes, cuts)]})

    return asked.groupBy("shard").applyInPandas(work, "block bigint, shard int, codes binary")


def lm_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents`` (doc_id, text,
    held_out); learnt from the rows that aren't held out.

    base_score: add-one unigram log10 probability; score: log10 probability by the bigram model, ends included. Null and
    empty texts are one end token. Without training rows all counts are 0: base_score is then log10(1) per token and score
    likewise. Repeated rows are counted and scored each. An empty table gives no rows.
    """
    ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    made = stored(blocks(documents), "blocks")
    n_words, n_tokens = made.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_shards, pair_shards = 1 + (n_words or 0) // WORDS_PER_SHARD, 1 + (n_tokens or 0) // PAIRS_PER_SHARD
    words = stored(count_words(_ask_words(made, word_shards), word_shards), "words")
    total, known = (int(x or 0) for x in words.agg(F.sum("total"), F.sum("known")).first())
    words = words.select("block", "shard", "counts", "ids")
    codes = answer_pairs(ask_pairs(made, words, total, pair_shards))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own, coded = pdf["tokens"].notna(), pdf["codes"].notna()
        b = Block(pdf[own].iloc[0], pdf[~own & ~coded], total, pair_shards)
        found = np.empty(len(b.context), np.uint16)
        found[b.order] = np.concatenate([unpack(x) for x in pdf[coded].sort_values("shard")["codes"]])
        single = (b.count + 1) / (total + known + 1)
        doc = np.repeat(np.arange(len(b.lengths)), b.lengths)
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(b.lengths))
        p = restore(found)[b.at] + MU / (b.context_count[b.at] + MU) * single[b.word]
        return pd.DataFrame({"doc_id": pd.Series(b.docs, dtype=object), "held_out": b.held, "n_tokens": b.lengths, "n_known": sums(b.count[b.word] > 0).astype(np.int64), "train_tokens": total, "base_score": sums(np.log10(single)[b.word]), "score": sums(np.log10(p))})

    return _rows(made, words, codes).groupBy("block").applyInPandas(work, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(documents: DataFrame) -> DataFrame:
    """As lm_scores; rows whose crc32 of the id leaves 2 modulo 7 are held out."""
    return lm_scores(documents.select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")))
