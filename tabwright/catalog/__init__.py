"""Named queries over the test tables, each next to the SQL that checks it."""

from tabwright.catalog.base import COVERS, ORACLE, QUERIES, load_all

__all__ = ["COVERS", "ORACLE", "QUERIES", "load_all"]
