"""Catalogue analytics over books, films and series, expressed as Spark plans."""
