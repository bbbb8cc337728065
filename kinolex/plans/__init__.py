"""Named queries and their SQL equivalents, gathered from this package's modules."""

from importlib import import_module

_MODULES = [import_module(f"kinolex.plans.{m}_queries") for m in ("clean", "join", "agg", "vector", "search", "eval", "packed")]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in getattr(m, "SQL", {}).items()}
