"""All queries of the engine, by name, and the SQL that each is compared with."""

from shelfmark.plans.queries import QUERIES
from shelfmark.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
