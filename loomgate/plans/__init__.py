"""Queries that bind the operators to tables of documents, orders and events, each with equal SQL where SQL can say it."""

from . import api, batched, sources, stores, texts  # noqa: F401  (their queries join those of bindings)
from .bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
