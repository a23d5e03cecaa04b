"""All queries of the library by name, with the SQL that each should equal."""

from loadscape.plans import cleaning, files, graphs, joins, lookups, models, profiles, quality, scenarios, scores, series, tables  # noqa: F401
from loadscape.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
