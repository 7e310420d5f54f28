"""All queries by name, and their SQL."""

from corpusmill.plans import ingest, scalar, search  # noqa: F401
from corpusmill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
