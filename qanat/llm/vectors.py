"""Vectors as the vector operators take them: valid rows, and classes of rows with exactly the same vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALT = 64


def valid(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, h1, h2) of the rows whose vector has a direction; identical rows once.

    Vectors that are null, empty or zero or hold null or non-finite components are left out, as are rows without a key."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0.0)
    rows = rows.where(finite & some)
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    return rows.select("id", "v", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), F.reverse(plain)).alias("h2"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, rep, n, members) of each distinct vector: its smallest id, its number of ids, its first `keep` ids.

    Copies may be a third of all rows: they are numbered in SALT parts of a class and only the first of each part go on."""
    ids = rows.select("id", "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    place = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    parts = ids.withColumn("place", F.row_number().over(place)).groupBy("h1", "h2", "salt")
    parts = parts.agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("place") <= keep, F.col("id"))).alias("ids"))
    whole = parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select("h1", "h2", F.get("ids", F.lit(0)).alias("rep"), "n", F.slice("ids", 1, keep).alias("members"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))
