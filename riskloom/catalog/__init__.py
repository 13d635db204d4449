"""Every operator as a query on the test tables, with the same query in SQL to check it against."""

from riskloom.catalog import aggregates, columns, features, functions, joins, models, sources, windows
from riskloom.catalog.registry import ORACLE, QUERIES

__all__ = [
    "ORACLE", "QUERIES", "aggregates", "columns", "features", "functions", "joins", "models", "sources", "windows",
]
