"""Running totals, ranks, medians and look-ups whose cost does not depend on how large one key is.

A plain window puts all rows of a key into one task. Running totals are a prefix scan instead: rows are dealt by ranges
of (key, order), so a hot key covers many ranges; each range hands the total of the key it ends with to all later
ranges, and a window inside (range, key) starts from what was handed over. There is one plan for every size of input; it
starts no job of its own, counts nothing first and broadcasts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RANGE = "_range"


def _equal_tail(batch: pa.RecordBatch, keys: Sequence[str], last: Sequence[pa.Scalar]) -> int:
    """How many rows at the end of a sorted batch have the key `last`; NULLs are equal."""
    same = None
    for key, value in zip(keys, last):
        column = batch.column(key)
        one = pc.fill_null(pc.equal(column, value), False) if value.is_valid else pc.is_null(column)
        same = one if same is None else pc.and_(same, one)
    return batch.num_rows if same is None else pc.sum(same).as_py() or 0


def _carry(ranges: int, keys: Sequence[str], values: Sequence[str], last_row: Sequence[str] = ()):
    """Over the sorted rows of one range: the rows, and one row for each later range with the total of the last key, or
    with the columns `last_row` of the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last, totals, schema = None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            ends = [batch.column(k)[batch.num_rows - 1] for k in keys]
            tail = _equal_tail(batch, keys, ends)
            sums = {} if last_row else {v: pc.sum(batch.column(v).slice(batch.num_rows - tail)).as_py() for v in values}
            if last is not None and tail == batch.num_rows and all(a.equals(b) for a, b in zip(last, ends)):
                sums = {v: totals[v] if s is None else s if totals[v] is None else totals[v] + s for v, s in sums.items()}
            last, totals = ends, sums or {c: batch.column(c)[batch.num_rows - 1].as_py() for c in last_row}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([number] * batch.num_rows, pa.int64())], names=[*schema.names, RANGE])
        later = range(number + 1, ranges)
        if last is not None and len(later):
            fixed = {**{k: v.as_py() for k, v in zip(keys, last)}, **totals}
            columns = [pa.array([fixed[f.name]] * len(later), f.type) if f.name in fixed else pa.nulls(len(later), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(later), pa.int64())], names=[*schema.names, RANGE])

    return run


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], hand_last: bool = False) -> DataFrame:
    """The rows of df as `_row`, dealt by ranges of (keys, order), with their keys, order and values beside them and the
    number of their range; rows without `_row` hand the total of the key that an earlier range ends with to this one, or
    that range's last row."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key_names, order_names = [f"_key{i}" for i in range(len(keys))], [f"_order{i}" for i in range(len(order))]
    values = {f"_value_{n}": c for n, c in sums.items()}
    rows = df.select(
        F.struct(*df.columns).alias("_row"),
        *[F.col(c).alias(n) for n, c in zip(key_names + order_names, [*keys, *order])],
        *[c.alias(n) for n, c in values.items()],
    )
    by = key_names + order_names
    sorted_rows = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    # totals are wider than the values that they add up
    as_handed = [F.col(n) if hand_last else _as_total(rows.schema[n].dataType.simpleString(), n) for n in values]
    widened = sorted_rows.select("_row", *by, *as_handed)
    schema = StructType([StructField(f.name, f.dataType) for f in widened.schema.fields]).add(RANGE, LongType())
    return widened.mapInArrow(_carry(ranges, key_names, list(values), [*order_names, *values] if hand_last else ()), schema)


def _as_total(kind: str, name: str) -> Column:
    if kind.startswith("decimal"):
        precision, scale = (int(x) for x in kind[len("decimal(") : -1].split(","))
        return F.col(name).cast(f"decimal({min(38, precision + 10)},{scale})").alias(name)
    return F.col(name).cast("double" if kind in ("float", "double") else "long").alias(name)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], inclusive: bool = False) -> DataFrame:
    """Running sums per key: the rows before each row, or up to and including it.

    keys    grouping columns; NULLs group together; none = one global order
    order   columns that order the rows of a key totally (no ties)
    sums    result column -> value to sum; an empty total is NULL
    """
    dealt = in_ranges(df, keys, order, sums)
    handed = F.col("_row").isNull()
    w = (
        Window.partitionBy(RANGE, *[f"_key{i}" for i in range(len(keys))])
        .orderBy(handed.desc(), *[f"_order{i}" for i in range(len(order))])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    done = dealt.select("_row", *[F.sum(f"_value_{n}").over(w).alias(n) for n in sums]).where(~handed)
    return done.select(*[F.col("_row")[c].alias(c) for c in df.columns], *sums)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Values of the row before each row of its key, whatever range that one is in; NULL for the first row of a key."""
    dealt = in_ranges(df, keys, order, values, hand_last=True)
    w = Window.partitionBy(RANGE, *[f"_key{i}" for i in range(len(keys))]).orderBy(*[f"_order{i}" for i in range(len(order))], F.col("_row").isNotNull())
    done = dealt.select("_row", *[F.lag(f"_value_{n}").over(w).alias(n) for n in values]).where(F.col("_row").isNotNull())
    return done.select(*[F.col("_row")[c].alias(c) for c in df.columns], *values)


def numbered(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Sequential numbers 1, 2, 3, ... in one global order, without a one-task sort."""
    return running(df, [], order, {name: F.lit(1).cast("long")}, inclusive=True)


def spread_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: str, how: str = "left") -> DataFrame:
    """Join rows whose key may be hot to a table with one row per key, without copies of that table.

    Rows with a NULL key match nothing; a number drawn from spread_by deals them over all tasks instead of one. The
    adaptive skew join splits keys that hold too many rows. The hint keeps the table off the driver: what explodes or
    decompresses is far larger than Spark's estimate, by which it would be broadcast.
    """
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salt = F.when(unmatched, F.pmod(F.xxhash64(spread_by), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)).alias("_salt")
    return rows.select("*", salt).join(lookup.withColumn("_salt", F.lit(0)).hint("merge"), [*on, "_salt"], how).drop("_salt")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): the compact form every rank statistic below works on."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_median(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per key (or of everything) from `value_counts`: the mean of the two middle values.

    Partial aggregation has already folded equal values, so a hot key costs its distinct values only.
    """
    ranked = running(counts, keys, [value], {"_below": F.col("n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    below = F.coalesce("_below", F.lit(0))

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < below + F.col("n")), F.col(value)))

    joined = ranked.join(totals, list(keys)) if keys else ranked.withColumn("_total", totals.scalar())
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return (
        joined.groupBy(*keys)
        .agg(at(low).alias("_low"), at(high).alias("_high"))
        .select(*keys, ((F.col("_low").cast("double") + F.col("_high").cast("double")) / 2).alias("median"))
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
