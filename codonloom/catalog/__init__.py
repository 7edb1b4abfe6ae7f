"""Queries over the test tables, each with an equivalent SQL text where SQL can say it."""

from codonloom.catalog.registry import oracles, registered

__all__ = ["oracles", "registered"]
