"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from millrace.llm import decontaminate, language, line_dedup, mixing, neighbours, pseudonyms, repeats, sharding, simhash, toxicity
from millrace.llm.common import importable


def _ready(query):
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_feistel": pseudonyms.op1_feistel,
        "op2_projected_tree": neighbours.op2_projected_tree,
        "op3_spaced_seeds": decontaminate.op3_spaced_seeds,
        "op4_line_join": line_dedup.op4_line_join,
        "op5_machine": toxicity.op5_machine,
        "op6_unigram": language.op6_unigram,
        "op7_suffix_radix": repeats.op7_suffix_radix,
        "op8_interleave": sharding.op8_interleave,
        "op9_mix": mixing.op9_mix,
        "op10_simhash": simhash.op10_simhash,
    }
    return {name: _ready(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_spaced_seeds": decontaminate.ORACLE,
        "op4_line_join": line_dedup.ORACLE,
        "op8_interleave": sharding.ORACLE,
        "op9_mix": mixing.ORACLE,
    }
