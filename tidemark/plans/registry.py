"""All queries of the library's own operators and their SQL, by name."""

from tidemark.plans import assessment, cleaning, diagnosis, entities, events, evidence, files, labels, matching, models, names, parsing, portfolio, search, serving, statistics, validation, worklists  # noqa: F401  (they register)
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
