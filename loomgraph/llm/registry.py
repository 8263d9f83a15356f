"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, hard_negatives, line_filter, minhash, mixing, nbsvm, prefix_trie, quality_rules, sharding, simple8b, suffix_family, url_filters, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rendezvous_shards": sharding.op1_rendezvous_shards,
        "op2_redirect_filter": url_filters.op2_redirect_filter,
        "op3_simple8b_ids": simple8b.op3_simple8b_ids,
        "op4_minhash_components": minhash.op4_minhash_components,
        "op5_benchmark_leaks": decontamination.op5_benchmark_leaks,
        "op6_wrapper_text": wrappers.op6_wrapper_text,
        "op7_nb_svm_quality": nbsvm.op7_nb_svm_quality,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_suffix_levels": suffix_family.op10_suffix_levels,
        "op11_zfast_trie": prefix_trie.op11_zfast_trie,
        "op12_cover_tree_negatives": hard_negatives.op12_cover_tree_negatives,
        "op13_line_filters": line_filter.op13_line_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_rendezvous_shards": sharding.ORACLE,
        "op2_redirect_filter": url_filters.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
        "op11_zfast_trie": prefix_trie.ORACLE,
        "op12_cover_tree_negatives": hard_negatives.ORACLE,
        "op13_line_filters": line_filter.ORACLE,
    }
