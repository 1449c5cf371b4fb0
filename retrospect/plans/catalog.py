"""All queries of the library: importing the modules registers them."""

from . import bundles, cases, corpus, evaluation, records, relational, retrieval, stores, temporal, texts, traces  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
