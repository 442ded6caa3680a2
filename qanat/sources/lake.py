"""Medallion, serving and model tables as directories of columnar files.

Four kinds of write, none of which a retry can double:
- `put_batch`  replaces one `batch` partition (bronze and silver: a replayed batch replaces itself) and notes the ranges
  of its keys, so that a look-up of a few keys reads the batches that may hold them;
- `overwrite`  writes a new version folder, then commits it; several tables can be published by the same commit, and
  readers keep the version they started with until VERSIONS newer ones have come;
- `put_partitions` replaces the partitions present in the frame (daily tables);
- `publish_buckets` lets staged buckets of several tables take the place of older ones by one commit of the manifest.

The logs of commits (`commits.py`) are the only things the driver writes itself. Versions and buckets may have several
writers at once: folders are never shared, and what was computed from a state that another writer has replaced is
computed again. A partition has one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import gold_state
from ..operators.upserts import insert_new, replace_keys
from .commits import TRIES, CommitLog, Conflict, Files

BATCH = "batch"
SCHEMAS = {
    ("bronze", "events"): f"{schemas.BRONZE}, {BATCH} long",
    ("silver", "transactions"): f"{schemas.SILVER_TRANSACTIONS}, {BATCH} long",
    ("silver", "payments"): f"{schemas.SILVER_PAYMENTS}, {BATCH} long",
    ("gold", "cash_position_daily"): schemas.CASH_POSITION,
    ("gold", "payment_features"): schemas.PAYMENT_FEATURES,
    ("gold", "daily_flows"): schemas.DAILY_FLOWS,
    ("serving", "cash_position"): schemas.SERVING_POSITION,
    ("serving", "forecast"): schemas.SERVING_FORECAST,
    ("serving", "anomalies"): schemas.SERVING_ANOMALIES,
    ("serving", "models"): schemas.SERVING_MODELS,
    ("ops", "pipeline_trace"): schemas.TRACE,
    ("ops", "pipeline_runs"): schemas.RUNS,
    **{("state", t): schema for t, schema in gold_state.SCHEMAS.items()},
}
BUCKET = "_bucket"
VERSIONS = 3  # of a table that stay: the published one and those before it
# Tables in buckets by the hash of a key; the manifest says which generation of a bucket counts.
BUCKETED = {
    ("gold", "payment_features"): "company_id",
    ("gold", "daily_flows"): "company_id",
    **{("state", t): key for t, key in gold_state.KEYS.items()},
}
# Long keys whose ranges are noted for each batch.
NOTED = {("silver", "transactions"): ("event_id", "transaction_id"), ("silver", "payments"): ("event_id",)}
RANGES = 64  # ranges of a set of keys at most
NOTES = "key string, low long, high long, batch long"
# Tables kept as partitions in place; all others are versioned.
PARTITIONED = {
    ("bronze", "events"): BATCH,
    ("silver", "transactions"): BATCH,
    ("silver", "payments"): BATCH,
    ("gold", "cash_position_daily"): ("position_date", BUCKET),
    ("serving", "cash_position"): "as_of_date",
    ("ops", "pipeline_trace"): "stage",
    ("ops", "pipeline_runs"): None,
}


class Lake:
    def __init__(self, spark: SparkSession, root: str, table_format: str = "parquet", buckets: int = 256):
        """buckets: of a new lake; an older one keeps the number it has."""
        self.spark, self.root, self.format, self._buckets = spark, root.rstrip("/"), table_format, buckets
        self.files = Files(spark)

    # ------------------------------------------------------------------ places

    def path(self, layer: str, table: str, folder: str | None = None) -> str:
        base = f"{self.root}/{layer}/{table}"
        return base if folder is None else f"{base}/{folder}"

    def checkpoint(self, name: str) -> str:
        """A stream's checkpoint; it lives and dies with the lake's tables."""
        return f"{self.root}/_checkpoints/{name}"

    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.files, f"{self.root}/_log/{name}")

    def _state(self, name: str) -> dict:
        return self._log(name).latest()[1]

    def _versions(self, layer: str, table: str) -> list:
        """[version, folder] of the versions that stay, the published one first."""
        return self._state("published").get(f"{layer}.{table}", [])

    def version(self, layer: str, table: str) -> int | None:
        if (layer, table) in BUCKETED:
            held = self.manifest()["tables"].get(f"{layer}.{table}")
            return None if held is None else max(held.values(), default=0)
        held = self._versions(layer, table)
        return held[0][0] if held else None

    def progress(self, stage: str) -> int:
        """The last ingest batch a stage has finished; -1 before the first."""
        return self._state("progress").get(stage, -1)

    def advance(self, stage: str, batch: int) -> None:
        self._log("progress").commit(lambda done: done | {stage: max(batch, done.get(stage, -1))})

    # ------------------------------------------------------------------ reads

    def exists(self, layer: str, table: str) -> bool:
        if (layer, table) in PARTITIONED:
            return self.files.has_data(self.path(layer, table))
        return self.version(layer, table) is not None

    def read(self, layer: str, table: str) -> DataFrame:
        reader = self.spark.read.format(self.format)
        if (layer, table) in SCHEMAS:
            reader = reader.schema(SCHEMAS[layer, table])
        if (layer, table) in BUCKETED:
            return self.read_buckets(layer, table)
        partitioned = (layer, table) in PARTITIONED
        if BUCKET in (PARTITIONED.get((layer, table)) or ()):
            return reader.load(self.path(layer, table)).drop(BUCKET)
        return reader.load(self.path(layer, table, None if partitioned else self._versions(layer, table)[0][1]))

    def read_or_none(self, layer: str, table: str) -> DataFrame | None:
        return self.read(layer, table) if self.exists(layer, table) else None

    def read_or_empty(self, layer: str, table: str) -> DataFrame:
        found = self.read_or_none(layer, table)
        return self.spark.createDataFrame([], SCHEMAS[layer, table]) if found is None else found

    # ------------------------------------------------------------------ writes

    def _put(self, df: DataFrame, layer: str, table: str, mode: str) -> None:
        writer = df.write.format(self.format).mode(mode).option("partitionOverwriteMode", "dynamic")
        by = PARTITIONED[layer, table]
        (writer.partitionBy(*([by] if isinstance(by, str) else by)) if by else writer).save(self.path(layer, table))

    def append(self, df: DataFrame, layer: str, table: str) -> None:
        self._put(df, layer, table, "append")

    def put_partitions(self, df: DataFrame, layer: str, table: str) -> None:
        """Replace the partitions that occur in df; the others stay."""
        self._put(df, layer, table, "overwrite")

    def put_batch(self, df: DataFrame, layer: str, table: str, batch: int) -> None:
        self.put_partitions(df.withColumn(BATCH, F.lit(batch).cast("long")), layer, table)
        if keys := NOTED.get((layer, table)):
            mine = self.read(layer, table).where(F.col(BATCH) == batch)
            notes = [(k, low, high, batch) for k in keys for low, high in key_ranges(mine, k)]
            frame = self.spark.createDataFrame(notes or [("", 0, 0, batch)], NOTES).coalesce(1)
            frame.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).save(self._notes(layer, table))

    # ------------------------------------------------------------------ look-ups by key

    def _notes(self, layer: str, table: str) -> str:
        return self.path("_keys", f"{layer}_{table}")

    def holding(self, layer: str, table: str, key: str, wanted: DataFrame) -> DataFrame:
        """The rows of the batches and key ranges that may hold a wanted key.

        A batch whose ranges are not noted, because a writer died in between, is always read."""
        ranges = key_ranges(wanted, key)
        all_batches = {n.partition("=")[2] for n in self.files.names(self.path(layer, table)) if n.startswith(f"{BATCH}=")}
        noted = {n.partition("=")[2] for n in self.files.names(self._notes(layer, table)) if n.startswith(f"{BATCH}=")}
        batches = {int(b) for b in all_batches - noted}
        if noted and ranges:
            notes = self.spark.read.schema(NOTES).format(self.format).load(self._notes(layer, table)).where(F.col("key") == key)
            hit = notes.where(any_of([(F.col("low") <= high) & (F.col("high") >= low) for low, high in ranges]))
            batches |= {r[0] for r in hit.select(BATCH).distinct().collect()}
        inside = any_of([F.col(key).between(low, high) for low, high in ranges])
        return self.read(layer, table).where(F.col(BATCH).isin(sorted(batches)) & inside)

    # ------------------------------------------------------------------ buckets

    def manifest(self) -> dict:
        """{buckets, generation, through, tables: {name: {bucket: generation}}, superseded: [folder]}."""
        return self._manifest(self._state("buckets"))

    def _manifest(self, state: dict) -> dict:
        return {"buckets": self._buckets, "generation": 0, "through": None, "tables": {}, "superseded": []} | state

    def next_generation(self) -> int:
        """A generation that no other writer stages."""
        return self._log("generations").claim(self.manifest()["generation"] + 1)

    def _bucket_path(self, layer: str, table: str, generation: int, number: str | int) -> str:
        return f"{self.path(layer, table)}/g{generation:06d}/{BUCKET}={number}"

    def bucket_of(self, layer: str, table: str) -> Column:
        return gold_state.bucket(BUCKETED[layer, table], self.manifest()["buckets"])

    def read_buckets(self, layer: str, table: str, only: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: no file of another one is listed."""
        held = self.manifest()["tables"].get(f"{layer}.{table}", {})
        chosen = held if only is None else {str(b): held[str(b)] for b in only if str(b) in held}
        if not chosen:
            return self.spark.createDataFrame([], SCHEMAS[layer, table])
        paths = [self._bucket_path(layer, table, g, b) for b, g in chosen.items()]
        return self.spark.read.format(self.format).schema(SCHEMAS[layer, table]).load(paths)

    def stage(self, df: DataFrame, layer: str, table: str, generation: int) -> DataFrame:
        """Write df's buckets for a generation that nobody reads yet; returns them as written."""
        path = f"{self.path(layer, table)}/g{generation:06d}"
        rows = df.withColumn(BUCKET, self.bucket_of(layer, table)).hint("rebalance", BUCKET)  # a hot company is split
        rows.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).save(path)
        return self.spark.read.format(self.format).schema(SCHEMAS[layer, table]).load(path).drop(BUCKET)

    def publish_buckets(
        self, generation: int, touched: Mapping[tuple[str, str], Sequence[int] | None], through: int, since: int | None = None
    ) -> None:
        """Let the staged buckets of a generation count, all at once. touched: the buckets that were computed, None for
        all; one that was computed and has no rows is gone. since: the generation that they were computed from; Conflict
        if another one counts by now. What was replaced is deleted by the next call, so that readers of the state before
        can end."""
        written = {}
        for layer, table in touched:
            names = self.files.names(f"{self.path(layer, table)}/g{generation:06d}")
            written[layer, table] = sorted(n.partition("=")[2] for n in names if n.startswith(f"{BUCKET}="))
        passed = []

        def change(state: dict) -> dict:
            before = self._manifest(state)
            if since is not None and before["generation"] != since:
                raise Conflict(f"generation {before['generation']} was published while one was computed from {since}")
            tables, superseded = dict(before["tables"]), []
            for (layer, table), only in touched.items():
                name = f"{layer}.{table}"
                old = tables.get(name, {})
                gone = old if only is None else {str(b): old[str(b)] for b in only if str(b) in old}
                tables[name] = {b: g for b, g in old.items() if b not in gone} | {b: generation for b in written[layer, table]}
                superseded += [self._bucket_path(layer, table, g, b) for b, g in gone.items()]
            passed[:] = before["superseded"]
            return {"buckets": before["buckets"], "generation": generation, "through": through, "tables": tables, "superseded": superseded}

        self._log("buckets").commit(change)
        for folder in passed:
            self.files.delete(folder)

    # ------------------------------------------------------------------ tables

    def overwrite(self, df: DataFrame, layer: str, table: str) -> int:
        """Replace a whole table; its schema may change."""
        return self.publish({(layer, table): df})[f"{layer}.{table}"]

    def publish(self, tables: Mapping[tuple[str, str], DataFrame], since: Mapping[tuple[str, str], int | None] | None = None) -> dict[str, int]:
        """Write a new version of each table, then let all of them appear by one commit.

        since: the versions that the frames were computed from; Conflict, and nothing appears, if one of them is no longer
        the published one."""
        folder = f"v-{uuid.uuid4().hex}"  # no two writers share one
        for (layer, table), df in tables.items():
            df.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "static").save(self.path(layer, table, folder))
        passed = []

        def change(state: dict) -> dict:
            for (layer, table), seen in (since or {}).items():
                held = state.get(f"{layer}.{table}")
                if (held[0][0] if held else None) != seen:
                    raise Conflict(f"{layer}.{table} has a newer version than {seen}")
            after = dict(state)
            passed.clear()
            for layer, table in tables:
                held = state.get(f"{layer}.{table}", [])
                row = [[held[0][0] + 1 if held else 1, folder], *held]
                after[f"{layer}.{table}"] = row[:VERSIONS]
                passed.extend(self.path(layer, table, old) for _, old in row[VERSIONS:])
            return after

        try:
            after = self._log("published").commit(change)
        except Conflict:
            for layer, table in tables:
                self.files.delete(self.path(layer, table, folder))
            raise
        for old in passed:
            self.files.delete(old)
        return {f"{layer}.{table}": after[f"{layer}.{table}"][0][0] for layer, table in tables}

    def sweep(self, layer: str, table: str, hours: float = 24.0) -> list[str]:
        """Delete folders of versions that writers left who died before their commit; returns their names.

        hours: younger folders may belong to a writer at work."""
        listed = self.files.listed(self.path(layer, table))
        kept = {folder for _, folder in self._versions(layer, table)}  # read after the listing, which may hold one of them
        limit = (time.time() - hours * 3600) * 1000
        gone = [name for name, at in listed if name.startswith("v-") and name not in kept and at <= limit]
        for name in gone:
            self.files.delete(self.path(layer, table, name))
        return gone

    def merge_insert(self, df: DataFrame, layer: str, table: str, key: str, batch: int, keys_in: DataFrame | None = None) -> None:
        """Insert rows whose key is new, as one batch; rows that batch already holds are kept.

        `keys_in` is a cheaper frame that holds all of df's keys.
        """
        new = df.dropDuplicates([key])
        if self.exists(layer, table):
            # A replayed batch re-inserts its own rows, so only other batches hide a key.
            old = self.holding(layer, table, key, df if keys_in is None else keys_in).where(F.col(BATCH) != batch)
            new = new.join(old.select(key), key, "left_anti")
        self.put_batch(new, layer, table, batch)

    def replace_keyed(self, df: DataFrame, layer: str, table: str, keys: Sequence[str]) -> None:
        """Replace the rows of df's keys inside the table's partitions; other rows stay as they are."""
        by = PARTITIONED[layer, table]
        merged = df
        if self.exists(layer, table):
            touched = self.read(layer, table).join(df.select(by).distinct(), by, "left_semi")
            merged = replace_keys(touched, df, keys)
        # The frame reads the partitions it replaces, so it is set down before they go.
        stage = self.path("_staged", f"{layer}_{table}_{uuid.uuid4().hex}")
        merged.write.format(self.format).mode("overwrite").option("partitionOverwriteMode", "static").save(stage)
        self.put_partitions(self.spark.read.format(self.format).schema(merged.schema).load(stage), layer, table)
        self.files.delete(stage)

    def replace_by_key(self, df: DataFrame, layer: str, table: str, keys: Sequence[str]) -> int:
        """A versioned table with the rows of df's keys replaced, in the version that counts when it is committed."""
        for _ in range(TRIES):
            seen = self.version(layer, table)
            old = self.read_or_none(layer, table)
            merged = df if old is None else replace_keys(old, df, keys)
            try:
                return self.publish({(layer, table): merged}, since={(layer, table): seen})[f"{layer}.{table}"]
            except Conflict:  # another writer's rows are merged now
                continue
        raise Conflict(f"{layer}.{table} changes faster than it can be replaced")

    def insert_absent(self, df: DataFrame, layer: str, table: str, keys: Sequence[str]) -> None:
        """Append rows whose keys the table does not hold: the first row of a key stays.

        The first key is a long; rows are written in its order, so that the ranges of the new keys are all that is read of
        the older files."""
        if self.exists(layer, table):
            ranges = key_ranges(df, keys[0])
            old = self.read(layer, table).where(any_of([F.col(keys[0]).between(low, high) for low, high in ranges]))
            by = PARTITIONED[layer, table]
            if by in keys:  # only the partitions that the new rows go to
                old = old.where(F.col(by).isin([r[0] for r in df.select(by).distinct().collect()]))
            df = insert_new(old, df, keys)
        self.append(df.sortWithinPartitions(*keys[:1]), layer, table)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def key_ranges(rows: DataFrame, key: str) -> list[tuple[int, int]]:
    """At most RANGES intervals that cover the keys of a frame: its span is cut evenly, each piece as narrow as its keys."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    width = (high - low) // RANGES + 1
    piece = F.floor((F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
    found = rows.where(F.col(key).isNotNull()).groupBy(piece.alias("_piece")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    return sorted((r["low"], r["high"]) for r in found.collect())
