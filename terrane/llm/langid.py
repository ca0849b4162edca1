"""Operator 4, language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all its
segmentations of the product of piece probabilities (forward algorithm); a text is the product of its words, lower-cased.
Piece probabilities are fitted by expectation-maximisation over the words of a sample of labelled documents.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import pieces
from terrane.llm.text import by_slices, held_out
from terrane.session import ship

#: Bounds of the fit: documents for each language, those of smallest id hash, and the bytes of their texts together (the last
#: may pass it); languages, those of most rows. Whole texts are counted.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES, MOST_LANGUAGES = 300, 8 << 20, 256
#: Characters from which on a word is fitted in logarithms, characters of it whose matches are held at once, and shorter words
#: whose matches are.
LONG_WORD, BLOCK, HELD_WORDS = 64, 1 << 16, 20_000
#: Ids put in order for each one that is sampled, as expected by their hashes.
SPARE = 3
ROUNDS, SMOOTHING = 2, 0.05
#: Probability of a character that no piece covers, in any language.
UNKNOWN = 1e-7
#: Words of which a worker keeps the scores, and the most characters of such a word.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: Words scored at once, and their most characters (longer ones are scored one by one).
CHUNK, SHORT = 8192, 24
#: An automaton's values are piece numbers times 1024 plus the piece's length.
LENGTH = 1023
UNDETERMINED = "und"


def matches_of(automaton: ahocorasick.Automaton, word: str) -> list[list[tuple[int, int]]]:
    """For each end position the (start, piece) of the pieces that end there; (start, -1) for an uncovered character."""
    ends: list[list[tuple[int, int]]] = [[] for _ in word]
    for end, packed in automaton.iter(word):
        ends[end].append((end + 1 - (packed & LENGTH), packed >> 10))
    for end, found in enumerate(ends):
        if not any(start == end for start, _ in found):
            found.append((end, -1))
    return ends


@lru_cache(maxsize=2)
def _automaton(path: str) -> tuple[ahocorasick.Automaton, int]:
    vocabulary = pieces.load(path)
    number = {p: k for k, p in enumerate(vocabulary.ids)}
    if max(map(len, number)) > LENGTH:
        raise ValueError(f"{path} has a piece of more than {LENGTH} characters")
    return vocabulary.automaton(lambda p: number[p] << 10 | len(p)), len(number)


@lru_cache(maxsize=2)
def _longest(path: str) -> int:
    return max(map(len, pieces.load(path).ids))


def matches_within(automaton: ahocorasick.Automaton, word: str, a: int, b: int, longest: int) -> list[list[tuple[int, int]]]:
    """:func:`matches_of` ``word`` for the end positions from a to b; no piece has more than ``longest`` characters."""
    back = max(0, a - longest)
    return [[(s + back, k) for s, k in found] for found in matches_of(automaton, word[back:b])[a - back :]]


def expect_long(word: str, n: int, log_p: list[float], expected: list[float], automaton: ahocorasick.Automaton, longest: int) -> None:
    """Adds ``n`` times the expected pieces of one word of any length to ``expected``: forward and backward in logarithms, two
    numbers a character and the matches of BLOCK characters at once."""
    size = len(word)
    forward = array("d", [0.0])
    for a in range(0, size, BLOCK):
        for found in matches_within(automaton, word, a, min(size, a + BLOCK), longest):
            own = [forward[s] + log_p[k] for s, k in found]
            most = max(own)
            forward.append(most + math.log(sum(math.exp(x - most) for x in own)))
    backward = array("d", [-math.inf]) * size
    backward.append(0.0)
    total = forward[size]
    for a in reversed(range(0, size, BLOCK)):
        b = min(size, a + BLOCK)
        found = matches_within(automaton, word, a, b, longest)
        for end in range(b, a, -1):
            for s, k in found[end - 1 - a]:
                x = backward[end] + log_p[k]
                expected[k] += n * math.exp(forward[s] + x - total)
                high, low = max(backward[s], x), min(backward[s], x)
                backward[s] = high if low == -math.inf else high + math.log1p(math.exp(low - high))


def fit_language(counts: Counter, automaton: ahocorasick.Automaton, size: int, longest: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities that expectation-maximisation finds for counts of words, from equal ones on; ``longest``: characters
    of the longest piece."""
    short = [w for w in counts if len(w) <= LONG_WORD]
    held = {w: matches_of(automaton, w) for w in short[:HELD_WORDS]}  # the rest is matched again in each round
    prob = np.full(size + 1, 1.0 / size)
    prob[-1] = UNKNOWN  # index -1
    for _ in range(rounds):
        p, expected = prob.tolist(), [0.0] * (size + 1)
        log_p = np.log(prob).tolist()
        for word, n in counts.items():
            if len(word) > LONG_WORD:
                expect_long(word, n, log_p, expected, automaton, longest)
                continue
            ends = held.get(word) or matches_of(automaton, word)
            forward = [1.0] + [0.0] * len(ends)
            for end, found in enumerate(ends, 1):
                forward[end] = sum(forward[s] * p[k] for s, k in found)
            backward = [0.0] * len(ends) + [1.0]
            total = forward[-1]
            if total <= 0:
                continue
            for end in range(len(ends), 0, -1):
                b = backward[end]
                for s, k in ends[end - 1]:
                    x = b * p[k]
                    backward[s] += x
                    expected[k] += n * forward[s] * x / total
        counted = np.array(expected) + SMOOTHING
        prob = counted / counted[:-1].sum()
        prob[-1] = UNKNOWN
    return prob[:-1]


def fit(documents: DataFrame, model: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE, sample_bytes: int = SAMPLE_BYTES, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, pieces x languages log probabilities, log priors) from ``documents`` (doc_id, text, lang).

    The ``most`` languages of most rows are learnt (ties: by name), each from at most ``per_language`` documents, those of
    smallest id hash, as long as the texts before one have less than ``sample_bytes`` together; rows with a null language or
    text aren't looked at. Only ids whose hash is below SPARE times the share that is wanted are put in order, each once, so
    a hot language or id sends no more than a small one; of rows of equal language and id, the shortest and then smallest
    text counts. Words are counted where the texts lie and the counts summed by word; then languages are fitted in parallel,
    from counts of bounded size. What reaches the driver is bounded by the vocabulary and one row for each language.
    """
    ship(documents.sparkSession)
    path = model or pieces.default_model()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = documents.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    seen = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(most).collect()
    priors, share = {r.lang: r.n for r in seen}, {r.lang: SPARE * per_language / max(1, r.ids) for r in seen}
    if not priors:
        return [], np.empty((0, 0)), np.empty(0)
    below = F.create_map(*[F.lit(x) for name, part in share.items() for x in (name, (1 << 63) - 1 if part >= 1 else int(2.0**63 * (2 * part - 1)))])
    few = labelled.where(F.xxhash64("doc_id") <= below[F.col("lang")]).groupBy("lang", "doc_id").agg(F.min(F.octet_length("text").cast("long")).alias("bytes"))
    ids = few.withColumns({"r": F.row_number().over(order), "before": F.sum("bytes").over(order) - F.col("bytes")})
    ids = ids.where((F.col("r") <= per_language) & (F.col("before") < sample_bytes)).select("lang", "doc_id", "bytes")
    chosen = labelled.join(F.broadcast(ids), ["lang", "doc_id"]).where(F.octet_length("text") == F.col("bytes"))  # a bounded sample
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for word in t.lower().split():
                counts[lang, word] += 1
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    words = by_slices(chosen, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, size = _automaton(path)
        counts = Counter({pieces.GAP + w: n for w, n in sorted(zip(pdf["word"], pdf["n"].tolist(), strict=True))})
        prob = fit_language(counts, automaton, size, _longest(path))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "prob": [prob.tolist()]})

    rows = sorted(words.groupBy("lang").applyInPandas(work, "lang string, prob array<double>").collect(), key=lambda r: r.lang)
    names = [r.lang for r in rows]
    if not names:
        return [], np.empty((0, 0)), np.empty(0)
    total = sum(priors[n] for n in names)
    return names, np.log(np.array([r.prob for r in rows]).T), np.log(np.array([priors[n] / total for n in names]))


class LanguageScorer:
    """Scores words by the forward algorithm for all languages at once and keeps those of the latest words."""

    def __init__(self, path: str, log_probs: np.ndarray):
        self.automaton, size = _automaton(path)
        self.longest = _longest(path)
        self.prob = np.vstack([np.exp(log_probs), np.full((1, log_probs.shape[1]), UNKNOWN)])  # -1: uncovered
        self.row: dict[str, int] = {}
        self.scores = np.zeros((KEPT_WORDS, log_probs.shape[1]), np.float64)

    def long_word(self, word: str) -> np.ndarray:
        """One word of any length, rescaled as it goes so that nothing underflows."""
        forward, scale = {0: np.ones(self.prob.shape[1])}, np.zeros(self.prob.shape[1])
        blocks = (matches_within(self.automaton, word, a, min(len(word), a + BLOCK), self.longest) for a in range(0, len(word), BLOCK))
        for end, found in enumerate(chain.from_iterable(blocks), 1):
            forward[end] = sum(forward[s] * self.prob[k] for s, k in found)
            forward.pop(end - self.longest, None)  # no later piece starts there
            if end % 16 == 0:
                by = np.maximum(forward[end], 1e-300)
                scale += np.log(by)
                forward = {k: v / by for k, v in forward.items()}
        return scale + np.log(np.maximum(forward[len(word)], 1e-300))

    def short_words(self, words: list[str]) -> np.ndarray:
        """words x languages; the automaton reads all words at once, each after a space, which no piece has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the gap
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        found = np.fromiter(chain.from_iterable(self.automaton.iter("".join(f"{pieces.GAP}{w} " for w in words))), np.int64).reshape(-1, 2)
        at = np.searchsorted(firsts, found[:, 0], side="right") - 1
        end, length, piece = found[:, 0] - firsts[at] + 1, found[:, 1] & LENGTH, found[:, 1] >> 10
        bare = np.arange(1, SHORT + 2)[:, None] <= lengths[None, :]  # ends at which no piece of one character matches
        bare[end[length == 1] - 1, at[length == 1]] = False
        bare_end, bare_at = np.nonzero(bare)
        end, at = np.concatenate([end, bare_end + 1]), np.concatenate([at, bare_at])
        start, piece = end - np.concatenate([length, np.ones(len(bare_at), np.int64)]), np.concatenate([piece, np.full(len(bare_at), -1)])
        order = np.argsort(end * len(words) + at, kind="stable")
        start, end, at, piece = start[order], end[order], at[order], piece[order]
        cuts = np.searchsorted(end, np.arange(1, SHORT + 3))
        forward = np.zeros((SHORT + 2, len(words), self.prob.shape[1]))
        forward[0] = 1.0
        for k in range(1, SHORT + 2):
            own = slice(cuts[k - 1], cuts[k])
            if own.start == own.stop:
                break
            first = np.flatnonzero(np.diff(at[own], prepend=-1))
            forward[k, at[own][first]] = np.add.reduceat(forward[start[own], at[own]] * self.prob[piece[own]], first, axis=0)
        return np.log(np.maximum(forward[lengths, np.arange(len(words))], 1e-300))

    def add(self, new: list[str]) -> None:
        """Scores of words of up to KEPT_CHARS characters."""
        short = [w for w in new if len(w) <= SHORT]
        if len(self.row) + len(new) > KEPT_WORDS:
            self.row.clear()
        for w in new:
            if len(w) > SHORT:
                self.row[w] = len(self.row)
                self.scores[self.row[w]] = self.long_word(pieces.GAP + w)
        for k in range(0, len(short), CHUNK):
            part, base = short[k : k + CHUNK], len(self.row)
            self.scores[base : base + len(part)] = self.short_words(part)
            self.row.update(zip(part, range(base, base + len(part)), strict=True))

    def long_text(self, text: str) -> np.ndarray:
        """Log probabilities of one text of any length."""
        own, out = self.sifted(text)
        for start in range(0, len(own), KEPT_WORDS // 2):
            part = own[start : start + KEPT_WORDS // 2]
            out += self.scores[self.rows(part)].sum(axis=0)
        return out

    def sifted(self, text: str) -> tuple[list[str], np.ndarray]:
        """(words whose scores are kept, log probabilities of all longer words together)."""
        own, out = text.lower().split(), np.zeros(self.prob.shape[1])
        for word in own:
            if len(word) > KEPT_CHARS:
                out += self.long_word(pieces.GAP + word)
        return [w for w in own if len(w) <= KEPT_CHARS], out

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` for at most half as many words as are kept; unknown words are scored first."""
        new = list({w for w in words if w not in self.row})
        if len(self.row) + len(new) > KEPT_WORDS:
            self.row.clear()
            new = list(set(words))
        self.add(new)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def batch(self, texts: list[str]) -> np.ndarray:
        """texts x languages log probabilities; short texts are handled together."""
        out, group, chars = np.zeros((len(texts), self.prob.shape[1])), [], 0

        def flush() -> None:
            own = [self.sifted(texts[k]) for k in group]
            out[group] = [longer for _, longer in own]
            filled = [(k, w) for k, (w, _) in zip(group, own, strict=True) if w]
            if filled:
                rows = self.rows([x for _, w in filled for x in w])
                starts = np.concatenate([[0], np.cumsum([len(w) for _, w in filled])[:-1]])
                out[[k for k, _ in filled]] += np.add.reduceat(self.scores[rows], starts, axis=0)

        for k, text in enumerate(texts):
            if len(text) > KEPT_WORDS // 2:
                out[k] = self.long_text(text)
                continue
            if chars + len(text) > KEPT_WORDS // 2 and group:
                flush()
                group, chars = [], 0
            group.append(k)
            chars += len(text)
        if group:
            flush()
        return out


_scorers: dict[str, LanguageScorer] = {}


def _scorer(key: str, path: str, log_probs: np.ndarray) -> LanguageScorer:
    """One per worker and fit, so that scored words live on between tasks."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = LanguageScorer(path, log_probs)
    return _scorers[key]


def identify(documents: DataFrame, learn: DataFrame, model: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents``, the languages learnt from ``learn`` (doc_id, text, lang).

    score is the posterior probability of the predicted language; ties go to the first language by name. Texts that are
    null or have no letter, and all texts if nothing could be learnt, are ``und`` with score 0. ``carry``: columns returned
    besides. Repeated rows give a row each. No shuffle of texts.
    """
    path = model or pieces.default_model()
    names, log_probs, priors = fit(learn, path, per_language)
    key = f"{documents.sparkSession.sparkContext.applicationId}-{abs(hash(log_probs.tobytes()))}"
    shared = documents.sparkSession.sparkContext.broadcast((log_probs.astype(np.float32), priors))  # vocabulary x languages
    kept = ["doc_id", *[c for c in carry or [] if c != "doc_id"]]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(batch.num_columns - 1).to_pylist()]
        said, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t is not None]
        if known and names:
            probs, prior = shared.value
            logs = _scorer(key, path, probs.astype(np.float64)).batch([texts[k] for k in known]) + prior
            best = logs.argmax(axis=1)
            for k, row, b in zip(known, logs, best.tolist(), strict=True):
                said[k], score[k] = names[b], 1.0 / math.fsum(np.exp(np.maximum(row - row[b], -700)).tolist())
        columns = [batch.column(i) for i in range(len(kept))] + [pa.array(said, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return by_slices(documents.select(*kept, F.col("text").alias("_text")), work, f"{fields}, lang_pred string, score double")


def language_of(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the rows that aren't held out."""
    out = identify(documents, documents.where(~held_out("doc_id", 5, 0)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
