"""Importing this package registers every query."""

from . import domain, graph, metrics, model, preprocess, profile, quality, select, similarity, sources, split, streaming, surface, validate  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
