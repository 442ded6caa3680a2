"""Helpers that several operators share: cutting lineage, connected components, walking sorted groups of Arrow rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session without either gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="qanat-llm-")
        context.setCheckpointDir(folder)
    return folder


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session passes BATCH_BYTES at most to Python at once, instead of Spark's 64 MB.

    Long texts exist several times on the way (JVM, Arrow, strings), for every task of an executor; the buffers outside the
    JVM's heap double until a batch fits, and outgrown ones stay until the next collection."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a table written to the shared folder and read again.

    A table rather than checkpoint(): it is compressed, and the plans of iterations stay small, since no constraints
    are carried on. Its files may go when the application has ended, as those of checkpoints."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/qanat-llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qanat_table = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames that cut() returned. Whatever was made from them must be a table itself by now."""
    for df in frames:
        if path := getattr(df, "_qanat_table", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges(a, b): the smallest vertex that it can reach.

    Each round points every vertex at its smallest neighbour, follows that pointer once more and contracts the edges.
    Vertices with very many edges are folded by min before the shuffle; the joins are plain equi-joins, which the
    adaptive skew join splits. Nothing but the count of remaining edges reaches the driver."""
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("component"))
    labels = cut(labels)
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("p"))
        further = near.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        up = cut(near.join(further, "p", "left").select("v", F.coalesce("pp", "p").alias("p")))
        first = up.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        second = up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(first, "a").join(second, "b").where("pa <> pb")
        left = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        step = up.select(F.col("v").alias("component"), F.col("p").alias("next"))
        found = cut(labels.join(step, "component", "left").select("v", F.coalesce("next", "component").alias("component")))
        discard(edges, labels, up)
        edges, labels = left, found
    discard(edges)
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges between local positions, a star for each of their components: (member, root), the root its smallest."""
    from collections import defaultdict

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for x in parent:
        if (r := find(x)) != x:
            out[r].append(x)
    pairs = [(x, r) for r, xs in out.items() for x in xs]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = zip(*pairs, strict=True)
    return np.array(left, np.int64), np.array(right, np.int64)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys, of about the wanted number of rows or one larger group."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(kept)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k)
            last &= np.asarray(column.to_numpy() == column[-1].as_py())
        start = int(np.argmax(last))
        if start:
            yield table.slice(0, start)
        rest = table.slice(start).combine_chunks()
        kept, size = rest.to_batches(), rest.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a text column holds about so many bytes at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on, and the next stage's tables come on top of what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
