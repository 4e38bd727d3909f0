"""Operators for preparing training text: each numbered query applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Query name: module and, in it, the query's function (same name) and SQL (``SQL``, where it has one).
NUMBERED = {
    "op1_mixing": "mixing",
    "op2_exact_dedup": "exact_dedup",
    "op3_toxicity": "toxicity",
    "op4_warc": "warc",
    "op5_simhash_dedup": "simhash",
    "op6_bpe": "bpe",
    "op7_quality": "quality",
    "op8_media": "media",
    "op9_language_id": "langid",
    "op10_chat_format": "chat",
    "op11_sentencepiece": "pieces",
    "op12_collocations": "collocations",
    "op13_spelling_variants": "variants",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in NUMBERED.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"{__name__}.{module}") for name, module in NUMBERED.items()}
    return {name: m.SQL for name, m in modules.items() if hasattr(m, "SQL")}
