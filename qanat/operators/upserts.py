"""What the sinks do to a table's rows, as frames: old rows and new rows in, the table's next state out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def replace_where(old: DataFrame, new: DataFrame, replaced: Column) -> DataFrame:
    """Rows matching `replaced` go, the new rows come."""
    return old.where(~replaced).unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key the table does not hold, one per key."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of other keys, and the new rows."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))
