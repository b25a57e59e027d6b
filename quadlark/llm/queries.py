"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from ..ship import ship

_OPS = {
    "op1_simhash_near_dedup": "simhash.op1",
    "op2_lm_scoring": "maxent.op2",
    "op3_byte_bpe": "bpe.op3",
    "op4_line_dedup": "linededup.op4",
    "op5_toxicity": "toxicity.op5",
    "op6_nearest_neighbours": "ann.op6",
    "op7_source_mixing": "mixing.op7",
    "op8_language_id": "langid.op8",
    "op9_quality_rules": "quality.op9",
    "op10_token_counts": "tokencount.op10",
}


def _query(where: str):
    module, name = where.split(".")

    def run(spark, sf_dir):
        ship(spark)
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _query(v) for k, v in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be said in SQL; tests hold them against brute force, round trips or held-out labels."""
    return {}
