"""Operator 9, SentencePiece encoding and decoding (merge-type vocabularies, byte fallback).

The encoding of a text is found left to right as a prefix table: for each prefix, the one token that its own encoding ends
with. An automaton lists the pieces that end there; a piece is the last token if it and the last token of the rest are
compatible, that is, if the merges of their concatenation end in just these two. Merging is local (what happens on one
side of a border that no merge crosses does not depend on the other side), so neighbours that are compatible in pairs form
the encoding of the whole, and each prefix has exactly one last token. Walking back through the table gives the ids.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import pieces
from terrane.llm.text import Memo, by_slices
from terrane.session import ship

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    def __init__(self, vocabulary: pieces.Vocabulary):
        self.vocabulary = vocabulary
        self.cut = vocabulary.gap_starts
        self.line_cut = self.cut and not any("\n" in p for p in vocabulary.ids)
        self.matches = ahocorasick.Automaton()  # only pieces that merges leave whole can be last tokens
        for piece in vocabulary.ids:
            if self.merged(piece) == [piece]:
                self.matches.add_word(piece, (len(piece), piece))
        self.matches.make_automaton()
        self.compatible = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], 500_000)
        self.words = Memo(lambda w: self.encode_run(pieces.GAP + w), 700_000)
        self.bare = Memo(self.encode_run, 50_000)
        self.raw = [bytes([vocabulary.bytes.index(i)]) if i in set(vocabulary.bytes) else b"" if i in vocabulary.control else t.replace(pieces.GAP, " ").encode() for i, t in enumerate(vocabulary.texts)]
        self.raw[vocabulary.unknown] = " ⁇ ".encode()

    def merged(self, run: str) -> list[str]:
        """What the merges make of a short run: again and again the best-scored neighbours join, of equal scores the first."""
        parts, score = list(run), self.vocabulary.scores
        while True:
            found = [(-score[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def last_tokens(self, run: str) -> list[str | None]:
        """The prefix table: entry i is the last token of the encoding of the first i characters."""
        last: list[str | None] = [None] * (len(run) + 1)
        done, compatible = 0, self.compatible
        for end, (length, token) in self.matches.iter(run):  # by end; for one end the longest first
            while done < end:
                done += 1
                if last[done] is None:  # a character that is in no piece is a token of its own
                    last[done] = run[done - 1]
            if last[end + 1] is None and (length == end + 1 or compatible[last[end + 1 - length], token]):
                last[end + 1] = token
        for k in range(done + 1, len(run) + 1):
            if last[k] is None:
                last[k] = run[k - 1]
        return last

    def encode_run(self, run: str) -> tuple[int, ...]:
        last, end, out = self.last_tokens(run), len(run), []
        while end:
            token = last[end]
            known = self.vocabulary.ids.get(token)
            out.extend([known] if known is not None else [self.vocabulary.bytes[b] for b in reversed(token.encode())])
            end -= len(token)
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.cut:
            return list(self.encode_run(pieces.escaped(text)))
        out: list[int] = []
        if "  " not in text and pieces.GAP not in text and text[0] != " " and self.line_cut:
            newline = self.vocabulary.bytes[10]
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if k:
                    out.append(newline)
                out += self.bare[first] if k else self.words[first]
                for w in rest:
                    out += self.words[w]
        else:
            for run in pieces.RUNS.findall(pieces.escaped(text)):
                out += self.words[run[1:]] if run[1:2] != pieces.GAP else self.encode_run(run)
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids: without the gap that encoding adds in front; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids or ()))
        first = next((i for i in ids or () if i not in self.vocabulary.control), None)
        if first is not None and self.vocabulary.texts[first].startswith(pieces.GAP):
            raw = raw[1:]
        return raw.decode("utf-8", "each-byte")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per Python worker; its tables live on between tasks and are bounded."""
    return PieceCodec(pieces.load(path))


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``documents`` (doc_id, text): the ids of the whole text as ``array<int>``.

    Null and empty texts have no ids (an empty array). Repeated rows give a row each. No shuffle.
    """
    ship(documents.sparkSession)
    path = model or pieces.default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        rows = [np.array(own.encode(t), np.int32) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``encoded`` (doc_id, ids); null ids decode to the empty text."""
    ship(encoded.sparkSession)
    path = model or pieces.default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.decode(i) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return by_slices(encoded.select("doc_id", "ids"), work, f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(documents: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``documents`` (doc_id, text): encode and decode in one pass over the texts."""
    ship(documents.sparkSession)
    path = model or pieces.default_model()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        rows = [own.encode(t) for t in batch.column(1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(map(own.decode, rows), pa.string())], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return by_slices(documents.select("doc_id", "text"), work, f"doc_id {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
