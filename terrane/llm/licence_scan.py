"""Operator 13 [native], licence scan by a positional rare-token index. Only DataFrame functions.

Each notice has a mandatory key phrase. The words of key phrases are ranked by how few documents of the corpus hold them
(highest IDF first), and each phrase is filed under its rarest words with their positions. The words of a file that are in
the index give, less the position filed, where a phrase would have to start; places on which all words filed for the
phrase agree are verified word by word. A verified phrase gives its notice's label, and the share of the whole notice that
stands round it gives the score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed values: (label, notice, key phrase of the notice).
NOTICES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)
#: Words that a phrase is filed under, one fewer than it has at most.
FILED = 2
#: Between words stands what is neither digit, letter a to z (once lower-cased) nor outside ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column | str) -> Column:
    """The words of a text in lower case; null texts have none. The Kelvin sign, the one other character whose lower case is
    an ASCII letter alone, is kept apart from k."""
    col = F.col(text) if isinstance(text, str) else text
    lower = F.lower(F.replace(F.coalesce(col, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lower, BREAK), "")


def phrases(base: tuple = BASE, notices: tuple = NOTICES) -> list[tuple[str, list[str], list[str], int]]:
    """(label, notice, key phrase, place of the phrase in the notice) as words; base phrases are their own notices and come first."""
    out = [(label, phrase.split(), phrase.split(), 0) for phrase, label in base]
    for label, notice, key in notices:
        n, k = notice.split(), key.split()
        out.append((label, n, k, next(i for i in range(len(n)) if n[i : i + len(k)] == k)))
    return out


def document_counts(documents: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many ``documents`` hold each word of ``vocabulary``; counts for as many words are all that reaches the driver."""
    held = F.array_distinct(F.filter(plain_words("text"), lambda w: w.isin(vocabulary)))
    counts = documents.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r.word: r.n for r in counts.collect()}


def index(entries: list, counts: dict[str, int], filed: int = FILED) -> list[list[tuple[str, int]]]:
    """(word, position) under which each phrase is filed: its rarest words by ``counts``, ties by word and position."""
    order = [sorted(((w, i) for i, w in enumerate(key)), key=lambda x: (counts[x[0]], *x)) for _, _, key, _ in entries]
    return [own[: max(1, min(filed, len(own) - 1))] for own in order]


def _starts(w: Column, places: Column, key: list[str], filed: list[tuple[str, int]]) -> Column:
    """Where ``key`` starts in words ``w``: what ``places`` (word, at) of its filed words agree on, verified."""
    def from_word(word: str, at: int) -> Column:
        return F.transform(F.filter(places, lambda x: x["word"] == word), lambda x: x["at"] - at)

    by_word = [from_word(word, at) for word, at in filed]
    agreed = reduce(F.array_intersect, by_word) if len(by_word) > 1 else by_word[0]
    phrase = F.array(*map(F.lit, key))
    return F.filter(agreed, lambda s: (s >= 0) & (F.slice(w, s + 1, len(key)) == phrase))


def _share(w: Column, starts: Column, notice: list[str], place: int) -> Column:
    """The largest share of ``notice`` that stands round one of the verified ``starts`` of its key phrase; 0 without any."""
    match = lambda s: reduce(lambda a, b: a + b, [F.coalesce((F.when(s + (i - place) >= 0, F.get(w, s + (i - place))) == word).cast("int"), F.lit(0)) for i, word in enumerate(notice)])
    return F.coalesce(F.array_max(F.transform(starts, match)), F.lit(0)) / float(len(notice))


def scan(documents: DataFrame, carry: list[str], base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """The columns ``carry`` of ``documents`` (which has text) and n_words (long), hits (array of label, base, start, share
    for each notice found: all starts and the best share) and filed words' places as ``places``.

    Two passes over the texts: one counts the documents of each phrase word, one looks up and verifies. No shuffle of texts;
    whole texts, however long. Null and empty texts have no words and no hits; no rows give no rows; repeated rows a row each.
    """
    entries = phrases(base, notices)
    counts = document_counts(documents.select("text"), sorted({w for _, _, key, _ in entries for w in key}))
    filed = index(entries, counts)
    rare = sorted({w for own in filed for w, _ in own})
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), plain_words("text").alias("w"))
    at = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(rare), F.struct(x.alias("word"), i.alias("at")))))
    inner = inner.select("row", "w", F.size("w").cast("long").alias("n_words"), at.alias("places"))
    found = [_starts(F.col("w"), F.col("places"), key, own) for (_, _, key, _), own in zip(entries, filed, strict=True)]
    inner = inner.select("row", "w", "n_words", "places", *[(F.when(F.size("places") > 0, s).otherwise(F.array().cast("array<int>"))).alias(f"s{k}") for k, s in enumerate(found)])
    hits = [F.when(F.size(f"s{k}") > 0, F.struct(F.lit(label).alias("label"), F.lit(k < len(base)).alias("base"), F.col(f"s{k}").alias("starts"), _share(F.col("w"), F.col(f"s{k}"), notice, place).alias("share"))) for k, (label, notice, _, place) in enumerate(entries)]
    out = inner.select("row", "n_words", F.array_compact(F.array(*hits)).alias("hits"), "places")
    return out.select("row.*", "n_words", "hits", "places")


def licences(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    n_base: places of base phrases; first_word, last_word: their smallest and largest start, null without any. Labels are
    distinct, sorted and joined by commas, '' without any; labels holds those of base phrases and of notices whose key
    phrase was verified. score: the largest share of a notice found, 1 for a base phrase, 0 without any label.
    """
    found = scan(documents.select("doc_id", "text"), ["doc_id"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    own = F.filter("hits", lambda x: x["base"])
    starts = F.flatten(F.transform("own", lambda x: x["starts"]))
    found = found.withColumn("own", own).withColumn("starts", starts)
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        labels(F.col("own")).alias("base_labels"), labels(F.col("hits")).alias("labels"), F.coalesce(F.array_max(F.transform("hits", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    rows = ", ".join(f"('{label}', {k < len(BASE)}, {notice!r}, {key!r}, {place})" for k, (label, notice, key, place) in enumerate(phrases()))
    return rf"""
WITH entry(label, base, notice, key, place) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (SELECT r, w, unnest(range(len(w))) AS s FROM docs),
hit AS (SELECT r, label, base, s, len(list_filter(range(1, len(notice) + 1), lambda i: s - place + i >= 1 AND w[s - place + i] = notice[i])) / CAST(len(notice) AS DOUBLE) AS share
        FROM place JOIN entry ON w[s + 1] = key[1] AND w[s + 1 : s + len(key)] = key),
best AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM docs LEFT JOIN best USING (r)
"""


SQL = _sql()
