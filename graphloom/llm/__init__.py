"""Operators for preparing training text; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

_QUERIES = {
    "op1_perspective_rotation": ("chat", "op1_perspectives"),
    "op2_string_kernel_lang": ("langid", "op2_langid"),
    "op3_rarity_digest": ("digest", "op3_digest"),
    "op4_ordinal_severity": ("toxicity", "op4_severity"),
    "op5_minhash_neardup": ("neardup", "op5_minhash"),
    "op6_containment_search": ("decontam", "op6_contained"),
    "op7_bpe_codec": ("bpe", "op7_bpe"),
    "op8_line_spread": ("linededup", "op8_lines"),
    "op9_warc_chain": ("warc", "op9_warc"),
    "op10_secret_entropy": ("secrets", "op10_secrets"),
    "op11_kd_shards": ("kdshards", "op11_shards"),
    "op12_phrase_collocations": ("collocations", "op12_collocations"),
    "op13_pivot_negatives": ("negatives", "op13_negatives"),
}


def _query(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"graphloom.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _query(*v) for k, v in _QUERIES.items()}


_SQL = {
    "op1_perspective_rotation": ("chat", "OP1_SQL"), "op5_minhash_neardup": ("neardup", "OP5_SQL"), "op6_containment_search": ("decontam", "OP6_SQL"), "op8_line_spread": ("linededup", "OP8_SQL"),
    "op9_warc_chain": ("warc", "OP9_SQL"), "op12_phrase_collocations": ("collocations", "OP12_SQL"), "op13_pivot_negatives": ("negatives", "OP13_SQL"),
}


def oracle_sql() -> dict[str, str]:
    return {k: getattr(importlib.import_module(f"graphloom.llm.{m}"), name) for k, (m, name) in _SQL.items()}
