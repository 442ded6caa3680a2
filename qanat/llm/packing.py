"""Packing by optimal length buckets: bucket bounds from a dynamic program over the whole histogram of lengths, then
batches of a token budget inside each bucket.

A text's length is its number of words between white space. The histogram (one row per distinct length, so at most as
many as the longest text has words) is the only thing the driver reads. The program finds, for the wanted number of
buckets, the upper bounds that need the least padding when every text is padded to the bound of its bucket. A batch of
a bucket with bound u holds floor(budget / u) texts, at least one.

Places inside a bucket are counted in shards: shard by hash of the row, number inside (bucket, shard), add what earlier
shards hold, so no bucket is numbered in one task. Null and empty texts have length 0 and lie in the first bucket;
every row is packed exactly once, repeated rows too; nothing is cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 20_000


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets, ascending, that minimise the sum of bound - length over all texts.

    lengths ascend. cost(i, j) of one bucket over the lengths i..j-1 meets the quadrangle inequality, so each layer of
    the program is found by halving, in order of distinct lengths times their logarithm."""
    n = len(lengths)
    if n == 0:
        return []
    size = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        now, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(first, min(mid - 1, last) + 1)
            cost = best[i] + lengths[mid - 1] * (size[mid] - size[i]) - (mass[mid] - mass[i])
            k = int(np.argmin(cost))
            now[mid], choice[mid] = cost[k], first + k
            stack += [(low, mid - 1, first, int(first + k)), (mid + 1, high, int(first + k), last)]
        choices.append(choice)
        best = now
    out, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
    return out[::-1]


def n_words(text: str):
    """Words between white space; 0 for null and blank."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, bound, batch, slot, padding) for every row of df; batch counts from 0 inside its bucket."""
    rows = df.select(F.col(key).alias("__key"), n_words(text).alias("n_tokens"))
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    ends = bounds(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets) or [0]
    shards = max(1, -(-int(histogram["n"].sum()) // SHARD_ROWS))
    bucket = F.lit(len(ends) - 1)
    for i, end in reversed(list(enumerate(ends[:-1]))):
        bucket = F.when(F.col("n_tokens") <= end, i).otherwise(bucket)
    rows = rows.withColumns({"bucket": bucket, "shard": F.pmod(F.xxhash64("__key"), F.lit(shards)).cast("int")})
    held = rows.groupBy("bucket", "shard").agg(F.count("*").alias("held"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("bucket", "shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "shard").orderBy("__key", "n_tokens")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1).join(held, ["bucket", "shard"])
    bound = F.get(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket"))
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1))))
    place = F.col("before") + F.col("place")
    return rows.select(
        F.col("__key").alias(key), "n_tokens", "bucket", bound.alias("bound"),
        F.floor(place / each).alias("batch"), (place % each).cast("int").alias("slot"), (bound - F.col("n_tokens")).alias("padding"),
    )
