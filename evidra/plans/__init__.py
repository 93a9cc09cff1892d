"""Queries over the test tables and their SQL twins."""

from . import corpus, details, hub, parts, questions, verification
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "corpus", "details", "hub", "parts", "questions", "verification"]
