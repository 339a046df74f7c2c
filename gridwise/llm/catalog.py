"""Registry of the text queries opN_<name> and of the SQL that checks them."""

from __future__ import annotations

import importlib

#: Modules with ``queries()`` and ``oracle_sql()``, in the order of their numbers.
MODULES = ("q_license", "q_bpe", "q_warc", "q_suffix", "q_lines", "q_quality", "q_counts", "q_simhash", "q_decontam", "q_chat", "q_align", "q_filters", "q_language")


def _present():
    from importlib.util import find_spec

    return [importlib.import_module(f"gridwise.llm.{m}") for m in MODULES if find_spec(f"gridwise.llm.{m}")]


def queries() -> dict:
    return {k: f for m in _present() for k, f in m.queries().items()}


def oracle_sql() -> dict:
    return {k: s for m in _present() for k, s in m.oracle_sql().items()}
