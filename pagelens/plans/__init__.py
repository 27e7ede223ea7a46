"""Registered queries, by computation family."""

from . import damage, layout, retrieval_qa, streams, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "damage", "layout", "retrieval_qa", "streams", "text"]
