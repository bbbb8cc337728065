"""Operators that prepare text and records for language models; their queries and SQL."""

from importlib import import_module

_MODULES = [import_module(f"kinolex.llm.{m}") for m in ("golden_queries", "nearcopies_queries", "linkage_queries", "vectors_queries", "lookalike_queries", "leaks_queries", "mixing_queries", "sentences_queries")]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in getattr(m, "SQL", {}).items()}
