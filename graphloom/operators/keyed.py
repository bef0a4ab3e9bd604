"""Key-value operations on tables with an ``id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.merging import upsert

__all__ = ["all_keys", "drop", "get_by_id", "get_by_ids", "missing_keys", "upsert"]


def all_keys(table: DataFrame, key: str = "id") -> DataFrame:
    return table.select(key)


def get_by_id(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    """The record of a key, if there is one."""
    return table.where(F.col(key) == value)


def get_by_ids(table: DataFrame, asked: DataFrame, fields: list[str] | None = None, key: str = "id") -> DataFrame:
    """``pos, id`` and the wanted fields for each key asked for, in that order; null fields where there is no record. ``asked``: pos, id."""
    wanted = fields if fields is not None else [c for c in table.columns if c != key]
    return asked.select("pos", key).join(table.select(key, *wanted), key, "left").select("pos", key, *wanted)


def missing_keys(table: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """The distinct keys that aren't stored."""
    return asked.select(key).distinct().join(table.select(key), key, "left_anti")


def drop(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)
