"""The corpus queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: query -> the module that has it
_MODULES = {
    "op1_url_filter": "url_filter",
    "op2_packing": "packing",
    "op3_tool_calls": "tool_calls",
    "op4_bpe_segment_tree": "bpe",
    "op5_toxicity": "toxicity",
    "op6_quality": "quality",
    "op7_simhash": "simhash",
    "op8_warc": "warc",
    "op9_cap_filters": "cap_filters",
    "op10_exact_dedup": "exact_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"bandweave.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"bandweave.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
