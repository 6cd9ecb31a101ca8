"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

_MODULES = ("vector_search", "near_dedup", "passages", "quality", "token_files", "token_counts", "language", "decontaminate", "bpe", "toxicity", "ball_trees", "phrases", "page_text")


def _gather(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        if what == "queries":
            out |= {k: v for k, v in vars(mod).items() if k.startswith("op") and k[2:3].isdigit() and callable(v)}
        else:
            out |= getattr(mod, "ORACLE", {})
    return out


def queries() -> dict:
    return _gather("queries")


def oracle_sql() -> dict:
    return _gather("oracle")
