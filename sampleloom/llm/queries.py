"""The registered queries of this package and the SQL they are compared with."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

_QUERIES = {
    "op1_exact_dedup": ("exact_dedup", "op1_query", "OP1_SQL"),
    "op2_minhash_dedup": ("near_dedup", "op2_query", None),
    "op3_line_dedup": ("line_dedup", "op3_query", "OP3_SQL"),
    "op4_best_fit_packing": ("packing", "op4_query", None),
    "op5_url_filter": ("url_filter", "op5_query", "OP5_SQL"),
    "op6_decontaminate": ("decontaminate", "op6_query", None),
    "op7_language_id": ("language_id", "op7_query", None),
    "op8_training_order": ("training_order", "op8_query", None),
    "op9_hidden_markov": ("hidden_markov", "op9_query", None),
    "op10_token_counts": ("token_counts", "op10_query", None),
}


def _member(module: str, name: str):
    return getattr(import_module(f"sampleloom.llm.{module}"), name)


def queries() -> dict:
    return {name: _member(module, function) for name, (module, function, _) in _QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: _member(module, sql) for name, (module, _, sql) in _QUERIES.items() if sql}
