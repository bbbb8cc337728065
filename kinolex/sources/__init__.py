from kinolex.sources.tables import table  # noqa: F401
