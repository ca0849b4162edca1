"""The queries on the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from terrane.llm import host_rules, langid, licence_scan, lm_scores, mixing, periodic_runs, piece_codec, prefix_trie, quality_mil, sharding, simhash, token_counts, topk
from terrane.session import table


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL  # noqa: E402
from corpus_pipeline import run  # noqa: E402

QUERIES = {
    "op1_token_counts": lambda spark, sf_dir: token_counts.token_counts(documents(spark, sf_dir)),
    "op2_quality_mil": lambda spark, sf_dir: quality_mil.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op3_lm_scores": lambda spark, sf_dir: lm_scores.score(documents(spark, sf_dir)),
    "op4_langid": lambda spark, sf_dir: langid.language_of(documents(spark, sf_dir)),
    "op5_simhash": lambda spark, sf_dir: simhash.near_duplicates(documents(spark, sf_dir)),
    "op6_topk": lambda spark, sf_dir: topk.top_k(table(spark, sf_dir, "embeddings")),
    "op7_host_rules": lambda spark, sf_dir: host_rules.verdicts(documents(spark, sf_dir)),
    "op8_mixing": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
    "op9_piece_codec": lambda spark, sf_dir: piece_codec.digests(piece_codec.round_trip(documents(spark, sf_dir))),
    "op10_sharding": lambda spark, sf_dir: sharding.balanced_shards(documents(spark, sf_dir)),
    "op11_prefix_trie": lambda spark, sf_dir: prefix_trie.trie_nodes(table(spark, sf_dir, "conversations")),
    "op12_periodic_runs": lambda spark, sf_dir: periodic_runs.run_digests(documents(spark, sf_dir)),
    "op13_licence_scan": lambda spark, sf_dir: licence_scan.licences(documents(spark, sf_dir)),
    "pipeline": run,
}
ORACLE_SQL = {
    "op6_topk": topk.SQL,
    "op7_host_rules": host_rules.SQL,
    "op8_mixing": mixing.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_licence_scan": licence_scan.SQL,
}
if PIPELINE_SQL:
    ORACLE_SQL["pipeline"] = PIPELINE_SQL
