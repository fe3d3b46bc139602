"""Registered queries: operators bound to the driver tables, with oracle SQL.

Every query runs over its whole tables.  ``QUERIES`` maps a key to a function
of (spark, folder); ``ORACLE`` maps it to SQL with the same columns.
"""

from catalog.common import ORACLE, QUERIES
from catalog import corpus, evaluation, experiments, speech, storage, subwords, words  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
