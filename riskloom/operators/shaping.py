"""Columns: subset, order, append, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def to_front(df: DataFrame, *names: str) -> DataFrame:
    """The named columns first, as far as the table has them, then the rest."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def insert_at(df: DataFrame, position: int, name: str, value: Column | None = None) -> DataFrame:
    """Put a column at a position; an existing one is moved there."""
    value = df[name] if value is None else value
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:position], value.alias(name), *rest[position:])


def append_columns(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select("*", *columns)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def feature_columns(df: DataFrame, keys: tuple[str, ...] = ("rowkey", "is_risk", "id")) -> list[str]:
    """Everything but the keys and the label."""
    return [c for c in df.columns if c not in keys]


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
