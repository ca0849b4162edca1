"""The corpus pipeline: language identification, quality rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Other
columns of its input, whatever their names, are left out first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import host_rules, langid, mixing, near_copies, piece_codec
from terrane.llm.text import spread
from terrane.session import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose predicted language is less likely than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language. Learns from the rows of the stage's input that have a language.

    Texts that are null or have no letter are rejected; repeated rows are judged alike; no rows give no rows.
    """
    docs = docs.select(COLUMNS)
    found = langid.identify(docs, docs, carry=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected. Null texts have too few words; a null host is a host of its
    own; repeated rows are judged alike; no rows give no rows."""
    return host_rules.with_verdicts(docs.select(COLUMNS), COLUMNS).where("kept").select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of the smallest doc_id.

    A null doc_id comes after all others; of rows of one id the first in order of shingle set and text stays, of repeated
    rows one. Texts are shuffled once to pick candidates and once to pick what stays.
    """
    docs = docs.select(COLUMNS)
    groups = near_copies.groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "row"))
    stay = groups.groupBy("label").agg(first.alias("s")).select("s.row")
    return spread(docs.select(*COLUMNS, near_copies.row_key().alias("row")), "row").join(stay, "row", "left_semi").dropDuplicates(["row"]).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Keys are computed again on the texts, so no text is shuffled for its cut."""
    keyed = mixing.keyed(docs.select(COLUMNS))
    cuts = mixing.cuts(stored(keyed.select("source", "mix"), "mix"))
    taken = mixing.taken(keyed, cuts).where("_taken.copies > 0")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_taken.copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every copy; a null text counts as empty, no rows give no rows."""
    return piece_codec.digests(piece_codec.round_trip(docs.select(COLUMNS)))


STAGES = [("language", language), ("rules", rules), ("deduplicate", deduplicate), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
