"""Decision logs, publishing and imports as Structured Streaming queries.

State tables are snapshots in buckets of their keys, as many as the table's size asks for: a micro-batch rewrites the buckets that its keys
fall into, in new folders, and then publishes a version that names each bucket's folder. A restart
opens what is there and goes on from the checkpoint; a batch that runs again changes nothing.
Order is event time (ts, seq), not arrival.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tagweave.operators.decisions import latest_decisions
from tagweave.sources.ingest import insert_new


class Snapshot:
    """A table in buckets by a hash of ``keys``; readers see complete versions only.

    A version is a file that names the folder of each bucket, with its bytes. It is written under another name and then
    renamed, and never changed. One stream writes a snapshot. The last ``keep`` versions stay readable;
    folders that none of them names are removed.

    A table begins with ``buckets``. When they hold more than ``bucket_bytes`` each, on average, the next batch writes
    the table into twice as many (or as many times that as it takes). So a table is written anew once for each time that it doubles, and
    otherwise a batch rewrites about ``bucket_bytes`` for each bucket that its keys fall into, however large the table is.
    """

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, keys: list[str], buckets: int = 16, keep: int = 3, bucket_bytes: int = 128 << 20):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.keep, self.bucket_bytes = spark, path.rstrip("/"), empty.schema, keys, buckets, keep, bucket_bytes
        self._known: dict[str, dict] = {}  # versions never change
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        at = self._path(f"{self.path}/versions")
        if not self.fs.exists(at):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(at)) if n.endswith(".json"))

    def version(self, name: str | None = None) -> dict:
        """How many ``buckets`` a version has, and the ``folders`` and ``bytes`` of those with rows."""
        name = name or next(reversed(self.versions()), None)
        if name and name not in self._known:
            self._known[name] = json.loads(self.spark.read.text(f"{self.path}/versions/{name}", wholetext=True).first()[0])
        return self._known[name] if name else {"buckets": self.buckets, "folders": {}, "bytes": {}}

    def folders(self, version: str | None = None) -> dict[str, str]:
        """The folder of each bucket; none before the first write."""
        return self.version(version)["folders"]

    def read(self, only: set[str] | None = None) -> DataFrame:
        paths = [f for b, f in self.folders().items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))

    def replace(self, df: DataFrame) -> None:
        now = self.version()
        self._publish(self._write(df, self._wanted(now)))

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``combine(old, batch)`` makes the new rows of the buckets that the batch's keys fall into."""
        now = self.version()
        buckets = self._wanted(now)
        touched = {str(r[0]) for r in self.bucketed(batch, buckets).select("_bucket").distinct().collect()}
        if not touched:
            return
        if buckets != now["buckets"]:
            self._publish(self._write(combine(self.read(), batch), buckets))
            return
        new = self._write(combine(self.read(touched), batch), buckets)
        for part in ("folders", "bytes"):
            new[part] = {b: x for b, x in now[part].items() if b not in touched} | new[part]
        self._publish(new)

    def _wanted(self, version: dict) -> int:
        buckets, total = version["buckets"], sum(version["bytes"].values())
        while total > buckets * self.bucket_bytes:
            buckets *= 2
        return buckets

    def _write(self, df: DataFrame, buckets: int) -> dict:
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        self.bucketed(df.select([f.name for f in self.schema]), buckets).write.partitionBy("_bucket").parquet(at)
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(at)) if f.isDirectory()]
        folders = {n.partition("=")[2]: f"{at}/{n}" for n in names if n.startswith("_bucket=")}
        return {"buckets": buckets, "folders": folders, "bytes": {b: self.fs.getContentSummary(self._path(f)).getLength() for b, f in folders.items()}}

    def _publish(self, new: dict) -> None:
        had = self.versions()
        name = f"{int(had[-1][:12]) + 1 if had else 0:012d}.json"
        draft = self._path(f"{self.path}/versions/{name}.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        at = self._path(f"{self.path}/versions/{name}")
        if self.fs.exists(at) or not self.fs.rename(draft, at):  # a local disk would rename over it
            raise RuntimeError(f"version {name} of {self.path} is there already")
        self._known[name] = new
        for old in had[: -self.keep + 1 or None] if self.keep > 1 else had:
            self.fs.delete(self._path(f"{self.path}/versions/{old}"), False)
        used = {f.rsplit("/", 2)[-2] for v in self.versions() for f in self.folders(v).values()}
        for f in self.fs.listStatus(self._path(f"{self.path}/data")):
            if f.getPath().getName() not in used:
                self.fs.delete(f.getPath(), True)


def _run(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> None:
    q = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()


def stream_decisions(source: DataFrame, target: Snapshot, checkpoint: str) -> None:
    """Latest decision of each key; ``clear`` rows stay as tombstones so that a late older decision does not come back."""

    columns = ["user_id", "item_id", "ts", "seq", "action"]

    def each(batch: DataFrame, _: int) -> None:
        target.merge(batch.select(columns), lambda old, new: latest_decisions(old.select(columns).unionByName(new)))

    _run(source, each, checkpoint)


def stream_successful(source: DataFrame, target: Snapshot, checkpoint: str) -> None:
    """A failed write leaves the latest successful one in place."""
    stream_decisions(source.filter("status = 'ok'"), target, checkpoint)


def stream_refresh_catalog(source: DataFrame, rebuild: Callable[[], DataFrame], target: Snapshot, checkpoint: str, trigger: dict | None = None) -> None:
    """A full rebuild whenever something came in; in service with ``{"processingTime": "5 minutes"}``."""
    _run(source, lambda batch, _: None if batch.isEmpty() else target.replace(rebuild()), checkpoint, trigger)


def stream_insert(source: DataFrame, target: Snapshot, keys: list[str], prepare: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """A key that is there already adds nothing, so a retry or a rerun is harmless."""

    def each(batch: DataFrame, _: int) -> None:
        target.merge(prepare(batch), lambda old, new: old.unionByName(insert_new(old, new, keys)))

    _run(source, each, checkpoint)


def stream_import(source: DataFrame, events: Snapshot, tags: Snapshot, links: Snapshot, prepare: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Listings with their tags: new events (key, ...), then the names they bring (tag_id, tag_name), then the links (key, tag_id).

    ``prepare`` makes good rows with ``tags`` of a batch. A tag's number is made from its name, so batches need no common counter. Each of the three
    adds only what is not there, so a batch that failed between them is completed when it runs again; as in the batch import, listings
    that are there already get links that they lack.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = prepare(batch).persist()
        try:
            events.merge(rows, lambda old, new: old.unionByName(insert_new(old, new.select(old.columns), ["key"])))
            named = rows.select("key", F.explode("tags").alias("tag_name")).distinct().withColumn("tag_id", F.xxhash64("tag_name"))
            tags.merge(named.select("tag_id", "tag_name"), lambda old, new: old.unionByName(insert_new(old, new, ["tag_name"]).select(old.columns)))
            links.merge(named.select("key", "tag_id"), lambda old, new: old.unionByName(insert_new(old, new, ["key", "tag_id"]).select(old.columns)))
        finally:
            rows.unpersist()

    _run(source, each, checkpoint)


def stream_publish(source: DataFrame, target: Snapshot, checkpoint: str, delay: str = "1 hour") -> None:
    """Calls (publish_key, user_id, seq, ts, ...) as they arrive: a key is stored once, for the user of its first call.

    A call that is delivered again within ``delay`` (publish_key, user_id and seq are the same) is dropped by the stream's own state, which the
    watermark bounds; calls that come later than the watermark are left out. What is left meets the stored keys: within a batch the earliest
    call by (ts, seq) counts, and a key that is there keeps its owner and content.
    """
    once = source.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["publish_key", "user_id", "seq"])

    def each(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("publish_key").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "publish_key"]), F.struct("ts", "seq")).alias("r")).select("publish_key", "r.*")
        target.merge(first, lambda old, new: old.unionByName(insert_new(old, new.select(old.columns), ["publish_key"])))

    _run(once, each, checkpoint)


STACK = StructType([StructField("user_id", LongType()), StructField("depth", IntegerType()), StructField("item_id", StringType()), StructField("action", StringType())])


#: Steps of a block of an undo stack.
BLOCK = 64


class UndoStack(StatefulProcessor):
    """A stack of decisions for each user; ``undo`` pops it. Emits the depth and the top after each batch.

    The state is one value (``height``: how many blocks lie below, and the upper end of the stack, at most two blocks) and a map from place to block. So a user costs
    a read and a write in a batch, however many their steps and however deep the stack; a block is written when it is full and read
    when a user has undone all above it. With ``ttl_ms`` a visit ends when nothing came for so long.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        steps = [StructField("item_ids", ArrayType(StringType())), StructField("actions", ArrayType(StringType()))]
        self.height = handle.getValueState("height", StructType([StructField("below", IntegerType()), *steps]), self.ttl_ms)
        self.steps = handle.getMapState("steps", StructType([StructField("place", IntegerType())]), StructType(steps), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        had = self.height.get()
        below, steps = (had[0], list(zip(had[1], had[2]))) if had else (0, [])
        for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
            if r.action != "undo":
                steps.append((r.item_id, r.action))
            elif steps:
                steps.pop()
                if not steps and below:
                    below, steps = self.taken(below - 1)
        while len(steps) > 2 * BLOCK:
            self.steps.updateValue((below,), split(steps[:BLOCK]))
            below, steps = below + 1, steps[BLOCK:]
        if steps:
            self.height.update((below, *split(steps)))
        elif had:
            self.height.clear()
        top = steps[-1] if steps else (None, None)
        yield Row(user_id=key[0], depth=below * BLOCK + len(steps), item_id=top[0], action=top[1])

    def taken(self, place: int) -> tuple[int, list]:
        """Takes a block out of the map: how many lie below it, and its steps. If its time is over, so is that of all below it."""
        got = self.steps.getValue((place,)) if self.steps.containsKey((place,)) else None
        if got is None:
            self.steps.clear()
            return 0, []
        self.steps.removeKey((place,))
        return place, list(zip(*got))

    def close(self) -> None:
        pass


def split(steps: list) -> tuple[list, list]:
    return [s[0] for s in steps], [s[1] for s in steps]


def stream_undo(source: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Rows have to arrive in order (within a batch they are sorted). Needs the RocksDB state store."""
    return source.groupBy("user_id").transformWithState(statefulProcessor=UndoStack(ttl_ms), outputStructType=STACK, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def undo_twin(log: DataFrame) -> DataFrame:
    """The batch result that the last emissions of ``stream_undo`` equal."""
    from tagweave.operators.decisions import fold_undo

    left = fold_undo(log)
    top = left.groupBy("user_id").agg((F.max("pos") + 1).alias("depth"), F.max_by("item_id", "pos").alias("item_id"), F.max_by("action", "pos").alias("action"))
    return log.select("user_id").distinct().join(top, "user_id", "left").select("user_id", F.coalesce("depth", F.lit(0)).alias("depth"), "item_id", "action")
