"""The registered queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import centroids, debruijn, decontam, langid, packing, pii, prefixtrie, rules, simhash, subword, suffixes, tokens, warc
from oddsmith.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": lambda spark, folder: simhash.near_duplicate_report(table(spark, folder, "documents")),
    "op2_pii": lambda spark, folder: pii.report(table(spark, folder, "documents")),
    "op3_quality_rules": lambda spark, folder: rules.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op4_quality_classifier": lambda spark, folder: subword.report(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op5_decontamination": lambda spark, folder: decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")),
    "op6_language": lambda spark, folder: langid.report(table(spark, folder, "documents")),
    "op7_suffix_dedup": lambda spark, folder: suffixes.dedup_report(table(spark, folder, "documents")),
    "op8_substring_dedup": lambda spark, folder: debruijn.dedup_report(table(spark, folder, "documents")),
    "op9_packing": lambda spark, folder: packing.packed_report(table(spark, folder, "documents")),
    "op10_warc": lambda spark, folder: warc.archive_report(spark, folder),
    "op11_centroid_clustering": lambda spark, folder: centroids.clusters(table(spark, folder, "embeddings")),
    "op12_prefix_trie": lambda spark, folder: prefixtrie.trie(table(spark, folder, "conversations")),
    "op13_token_counts": lambda spark, folder: tokens.report(table(spark, folder, "documents")),
}

ORACLES: dict[str, str] = {"op10_warc": warc.ARCHIVE_SQL, "op11_centroid_clustering": centroids.CLUSTERS_SQL, "op12_prefix_trie": prefixtrie.TRIE_SQL}
