"""Registered queries over the given tables, each with its SQL counterpart where SQL can state it."""

from __future__ import annotations

import importlib

PARTS = ["files", "stored", "risk", "research", "ledger", "filings", "lineage", "chat", "streams"]


def load() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for part in PARTS:
        module = importlib.import_module(f"evidentia.catalogue.{part}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
