"""Registered queries; importing a module registers its own."""

from . import aggregates, retrieve, rules, scores, store, streams, texts  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
