"""Queries over the given tables, each with the SQL it must agree with."""

from registry import columns, jobs, layout, storage, vocabularies, words
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "columns", "jobs", "layout", "storage", "vocabularies", "words"]
