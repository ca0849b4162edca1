"""Operator 7 [native], host-level quality rules: document rules, failure rates by host shrunk by an empirical beta prior.

Only DataFrame functions. A document's host is its ``source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import words
from terrane.session import stored

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a document's words that symbols may reach, and of its lines with a word that repeat earlier ones.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 20, 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
HAS_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words(h: Column) -> Column:
    """Positions covered by windows whose hash occurs twice or more; ``h`` has the hash of each window."""
    s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.aggregate(F.array(s), F.lit(0), lambda acc, srt: acc + _covered(srt))


def _covered(s: Column) -> Column:
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    places = F.array(F.sort_array(F.transform(twice, lambda x: x["p"])))
    return F.aggregate(places, F.lit(0), lambda acc, p: acc + F.when(F.size(p) == 0, 0).otherwise(3 + F.aggregate(F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.least(F.lit(3), F.get(p, i + 1) - x)), F.lit(0), lambda a, b: a + b)))


def document_rules(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` and, as struct ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed and failed (boolean).

    Words are runs without ASCII white space; a null text has none. n_repeat_words counts the words that stand in a
    3-word window found twice or more in the same text; windows are compared by 64-bit hash. failed adds to base_failed the
    rules on symbols and repeated lines. A narrow step: no shuffle.
    """
    inner = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    inner = inner.withColumn("w", words("t"))
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    inner = inner.withColumn("h", windows).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(HAS_WORD)))
    counts = inner.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), 0).otherwise(_repeat_words(F.col("h"))).cast("long").alias("n_repeat_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counts.select("doc.*", F.struct(*fields, base.alias("base_failed"), (base | more).alias("failed")).alias("rules"))


def host_verdicts(marked: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, n_failed, rate, host_kept) for each value of column ``host`` of ``marked`` (host, rules); null is a host of its own.

    Failure rates are shrunk to (failed + a) / (n + a + b). a and b come from the hosts' own rates by the method of moments:
    mean m over all documents, variance v between hosts weighted by size, less the part that sampling explains; a + b =
    m (1 - m) / v - 1, kept within 1 and a million. One host may hold any share of the rows: rows are pre-aggregated.
    """
    host = marked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("rules.failed").cast("long")).alias("n_failed"))
    sums = host.agg(F.sum("n").alias("n_all"), F.sum("n_failed").alias("f_all"), F.count("*").alias("hosts"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("ss"))
    m = F.col("f_all") / F.col("n_all")
    v = F.greatest((F.col("ss") - F.col("n_all") * m * m) / F.col("n_all") - m * (1 - m) * (F.col("hosts") - 1) / F.col("n_all"), F.lit(1e-9))
    prior = sums.select(m.alias("m"), F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6)).alias("strength"))
    rate = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return host.crossJoin(F.broadcast(prior)).select("host", "n", "n_failed", rate.alias("rate"), (rate <= MAX_HOST_RATE).alias("host_kept"))  # prior: one row


def with_verdicts(documents: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``documents`` (which has source and text), ``rules`` and ``kept``: false if base_failed,
    else true if the document passes the other rules and its host is not rejected.

    Rule results and ``carry`` are written once in the shared folder; hosts are aggregated from there and joined back. The
    host table is written too, so that its size is known before the join is planned: Spark broadcasts it if that is below
    its threshold, and texts are not shuffled by host; else rows meet hosts by a shuffle whose hot hosts adaptive execution
    splits. An empty table gives no rows.
    """
    marked = stored(document_rules(documents).select(*carry, F.col("source").alias("_host"), "rules"), "rules")
    hosts = stored(host_verdicts(marked, "_host").select("host", "host_kept"), "hosts")
    joined = marked.join(hosts, F.col("_host").eqNullSafe(F.col("host")), "left")
    return joined.select(*carry, "rules", (~F.col("rules.failed") & F.col("host_kept")).alias("kept"))


def verdicts(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    marked = with_verdicts(documents.select("doc_id", "source", "text"), ["doc_id"])
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return marked.select("doc_id", *[f"rules.{f}" for f in fields], "kept")


SQL_RULES = r"""
docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
win AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM (
          SELECT rid, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] AS g FROM (
            SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM (SELECT row_number() OVER () AS rid, w FROM w)))),
rep AS (SELECT rid, count(DISTINCT q) AS r FROM (SELECT rid, unnest([p, p+1, p+2]) AS q FROM win WHERE n > 1) GROUP BY rid),
counts AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
           FROM (SELECT row_number() OVER () AS rid, * FROM w) LEFT JOIN rep USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines AS more_failed FROM counts),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR more_failed) AS f FROM base GROUP BY source),
sums AS (SELECT sum(n) AS n_all, sum(f) / sum(n) AS m, count(*) AS hosts, sum(f * f / n) AS ss FROM host),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest((ss - n_all * m * m) / n_all - m * (1 - m) * (hosts - 1) / n_all, 1e-9) - 1, 1.0), 1e6) AS s FROM sums),
verdict AS (SELECT source, (f + m * s) / (n + s) <= 0.6 AS host_kept FROM host, prior)
"""
SQL = "WITH " + SQL_RULES + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR more_failed) AND host_kept AS kept
FROM base LEFT JOIN verdict ON base.source IS NOT DISTINCT FROM verdict.source
"""
