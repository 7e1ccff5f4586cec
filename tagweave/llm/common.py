"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and one machine runs all (tests) a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that ``materialize`` has written and nobody has released.
WRITTEN: list[str] = []


def release(spark: SparkSession, *keep: DataFrame, but: Iterable[str] = ()) -> None:
    """Remove the tables that ``materialize`` has written, except those that ``keep`` reads and the folders ``but``.

    Other results that still read them must be done.
    """
    used = {f.rsplit("/", 1)[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
    for path in [p for p in WRITTEN if p.rpartition("/")[2] not in used and p not in set(but)]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes from a stream sorted by ``key``; the rows of a key stay together."""
    parts, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append(batch)
        n += batch.nbytes
        if n < size:
            continue
        t = pa.Table.from_batches(parts)
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield t.slice(0, cut)
        parts = t.slice(cut).combine_chunks().to_batches()
        n = sum(x.nbytes for x in parts) if cut else 0
    if parts:
        yield pa.Table.from_batches(parts)
