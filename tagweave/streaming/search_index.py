"""A search index that follows a stream of changed items, without being built anew.

Each batch appends a version: what is known of its items now (or that they are gone), and the terms of those that are there. A reader takes
an item's last version only, and counts the corpus' figures (items, average length, document frequencies) from what is left, so
the posting lists it gets are those of a full build. Compaction writes the last versions as one and drops the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import recommend as R

DOC = "item_id string, campus string, item_type string, is_active int, starts_at timestamp, length int, deleted boolean, v long"
TERM = "item_id string, campus string, item_type string, is_active int, starts_at timestamp, length int, counts array<struct<term:string,tf:int>>, v long"


class SearchIndex:
    """Versions of ``docs`` and ``terms`` below ``path``; one stream writes it. Versions only grow, and a version that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[int]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(int(f.getPath().getName().removeprefix("v=")) for f in self.fs.listStatus(at) if f.getPath().getName().removeprefix("v=").isdigit()) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        """Those that are whole, from the last compacted one on."""
        since = max(self._names("since"), default=0)
        return [v for v in self._names("whole") if v >= since]

    def append(self, items: DataFrame, version: int) -> None:
        """``items``: a row for each changed item (item_id, campus, item_type, is_active, starts_at, search_text, deleted)."""
        rows = items.withColumn("length", F.size(R.terms(F.col("search_text"))))
        self._write(rows.select("item_id", "campus", "item_type", "is_active", "starts_at", "length", "deleted"), R.item_terms(items.filter("not deleted")), version)

    def _write(self, docs: DataFrame, terms: DataFrame, version: int) -> None:
        for name, df in (("docs", docs), ("terms", terms)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/v={version}")
        self.fs.mkdirs(self._at(f"{self.path}/whole/{version}"))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/v={v}" for v in self.versions()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def docs(self) -> DataFrame:
        """The items as they are now, with the version that says so."""
        rows = self._read("docs", DOC)
        columns = [c for c in rows.columns if c != "item_id"]
        return rows.groupBy("item_id").agg(F.max_by(F.struct(*columns), "v").alias("r")).select("item_id", "r.*").filter("not deleted")

    def terms(self) -> DataFrame:
        return self._read("terms", TERM).join(self.docs().select("item_id", "v"), ["item_id", "v"], "left_semi")

    def lists(self, shard_items: int = R.SHARD_ITEMS) -> DataFrame:
        """What ``recommend.build_index`` makes of the items as they are now."""
        docs = self.docs()
        items = self.terms().drop("v")
        return R.posting_lists(items, docs.groupBy("campus").agg(F.count("*").alias("n")), shard_items).join(R.figures(items), "term")

    def compact(self) -> None:
        """The items as they are now become the only version, numbered as the last one was, plus a half step (versions of a stream are even)."""
        have = self.versions()
        if len(have) < 2:
            return
        version = have[-1] + 1
        self._write(self.docs().drop("v"), self.terms().drop("v"), version)
        self.fs.mkdirs(self._at(f"{self.path}/since/{version}"))
        for v in self._names("whole"):
            if v < version:
                for name in ("whole/", "docs/v=", "terms/v="):
                    self.fs.delete(self._at(f"{self.path}/{name}{v}"), True)


def stream_index(source: DataFrame, index: SearchIndex, checkpoint: str, trigger: dict | None = None, compact_at: int = 8):
    """Start following ``source`` (rows of changed items; within a batch the row with the largest ``seq`` counts). Returns the running query.

    In service with the default, a batch every five minutes; an index of ``compact_at`` versions is compacted before the next one is added.
    """

    def each(batch: DataFrame, n: int) -> None:
        if len(index.versions()) >= compact_at:
            index.compact()
        last = batch.groupBy("item_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "item_id"]), "seq").alias("r")).select("item_id", "r.*")
        index.append(last, 2 * n)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()
