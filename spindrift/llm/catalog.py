"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_text", "q_vectors", "q_documents")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"spindrift.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
