"""Operator 1, token counts: the number of pieces of the best unigram segmentation, without building it.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming carries the best
score and its piece count. Ties go as in the public unigram tokenizers: of equal scores into one position, the piece that
starts first (the longest) stays. A character that no single-character piece covers costs the lowest piece score less 10
and counts one byte piece for each of its UTF-8 bytes. Scores are those of the vocabulary file; they are whole numbers, so
sums are exact in doubles.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm import pieces
from terrane.llm.text import Memo, by_slices
from terrane.session import ship

#: Subtracted from the lowest piece score for an unknown character, as in the public libraries.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    def __init__(self, vocabulary: pieces.Vocabulary):
        self.matches = vocabulary.automaton(lambda p: (len(p), vocabulary.scores[p]))
        self.unknown = min(vocabulary.scores.values()) - UNKNOWN_PENALTY
        self.cut = vocabulary.gap_starts
        self.line_cut = self.cut and not any("\n" in p for p in vocabulary.ids)
        self.words = Memo(lambda w: self.best(pieces.GAP + w), 700_000)
        self.bare = Memo(self.best, 50_000)

    def best(self, run: str) -> tuple[float, int]:
        """(score, pieces) of the best segmentation of an escaped text."""
        n, unknown = len(run), self.unknown
        low = float("-inf")
        score, count, single = [0.0] + [low] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0  # positions whose best is final

        def close(upto: int) -> None:
            for k in range(done + 1, upto + 1):
                if not single[k] and (x := score[k - 1] + unknown) > score[k]:
                    score[k], count[k] = x, count[k - 1] + len(run[k - 1].encode())

        for end, (length, own) in self.matches.iter(run):  # by end; for one end the longest, which starts first, first
            if end > done:
                close(end)
                done = end
            start = end + 1 - length
            if length == 1:
                single[end + 1] = True
            if (x := score[start] + own) > score[end + 1]:
                score[end + 1], count[end + 1] = x, count[start] + 1
        close(n)
        return score[n], count[n]

    def __call__(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if not self.cut:
            return self.best(pieces.escaped(text))
        if "  " not in text and pieces.GAP not in text and text[0] != " " and self.line_cut:
            parts = []
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                parts += [self.bare["\n"], self.bare[first]] if k else [self.words[first]]
                parts += map(self.words.__getitem__, rest)
        else:
            parts = [self.words[r[1:]] if r[1:2] != pieces.GAP else self.best(r) for r in pieces.RUNS.findall(pieces.escaped(text))]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """One per Python worker; its table of words lives on between tasks and is bounded."""
    return UnigramCounter(pieces.load(path))


def token_counts(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of ``documents`` (doc_id, text); further columns are not looked at.

    Null and empty texts have 0 tokens and score 0. Repeated rows give a row each; a null doc_id stays null. One narrow
    pass without a shuffle; texts of any length are handled whole.
    """
    ship(documents.sparkSession)
    path = model or pieces.default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        found = [count(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, n_tokens bigint, score double")
