"""The queries of this subpackage, by the names they are registered under, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_context_mixing": "context_mixing",
    "op2_html_extract": "html_extract",
    "op3_warc": "warc",
    "op4_line_dedup": "line_dedup",
    "op5_ngram_join": "ngram_join",
    "op6_license_scan": "license_scan",
    "op7_decontaminate": "decontaminate",
    "op8_token_store": "token_store",
    "op9_mixing": "mixing",
    "op10_quality_rules": "quality",
    "op11_prefix_trie": "prefix_trie",
    "op12_bpe_automaton": "bpe",
    "op13_yinyang": "yinyang",
}


def queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = ((name, getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)) for name, module in _MODULES.items())
    return {name: sql for name, sql in found if sql}
