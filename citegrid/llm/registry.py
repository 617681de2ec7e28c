"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, decontaminate, infill, line_dedup, mixing, ngram_join, quality, sharding, simhash, substring_dedup, token_files, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_url_templates": urls.op3_url_templates,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_hilbert_sharding": sharding.op5_hilbert_sharding,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_warc_index": warc.op7_warc_index,
    "op8_soft_mixing": mixing.op8_soft_mixing,
    "op9_tokeniser_fertility": quality.op9_tokeniser_fertility,
    "op10_range_coded_ids": token_files.op10_range_coded_ids,
    "op11_infill_chunks": infill.op11_infill_chunks,
    "op12_ball_tree_search": ball_tree.op12_ball_tree_search,
    "op13_simhash_covering": simhash.op13_simhash_covering,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_url_templates": urls.OP3_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_warc_index": warc.OP7_SQL,
    "op11_infill_chunks": infill.OP11_SQL,
    "op12_ball_tree_search": ball_tree.OP12_SQL,
}
