"""All queries of the library, by name, with the SQL that says the same."""

from playtide.plans import checked, oracles, queries

QUERIES = queries.QUERIES | checked.QUERIES
ORACLES = oracles.SQL | checked.SQL

__all__ = ["ORACLES", "QUERIES"]
