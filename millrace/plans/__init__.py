"""Named queries over the test tables, with their SQL."""

from millrace.plans import entities, relational, rules, storage, texts
from millrace.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entities", "relational", "rules", "storage", "texts"]
