"""A training corpus in five stages, each on all that the one before kept.

toxicity: documents that the classifier rejects go. near_dedup: one document of each group of
near copies stays. substring_dedup: passages of 50 words or more that stand in an earlier
document go from the text. mixing: sources are read again to meet the mixture's weights, and the readings are
put into its order (no document is dropped). packing: every reading gets its place in a batch, and keeps its text.

Each row of the table is a document, also where its doc_id is null or stands in several rows.
The first stage gives rows a key of their own (``ROW``, in ascending doc_id), which the stages
after it join by; mixing drops it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import mixing, packing, toxicity
from tagweave.llm.common import WRITTEN, materialize, partitions, read, release
from tagweave.llm.near_dup import near_duplicates
from tagweave.llm.substring_dedup import dedup_words

#: Passages of at least so many words are removed from later documents.
PASSAGE_WORDS = 50
#: A source is read at most so often.
MAX_REPEATS = 2.0
#: The key of a row.
ROW = "_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own in ascending doc_id, null last. Rows of one id are spread over tasks, too."""
    if ROW in docs.columns:
        return docs
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns), F.col(ROW)]
    placed = docs.withColumn(ROW, F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
    return materialize(placed.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def content() -> Column:
    """What a document is dealt by: the same in each run, and not one value for all rows of an id."""
    return F.xxhash64("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rejected = toxicity.score(docs, index, ROW).filter("predicted = 1").select(ROW)
    return docs.join(rejected, ROW, "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id stays."""
    docs = numbered(docs)
    copies = near_duplicates(docs, ROW).filter(F.col(ROW) != F.col("class_id")).select(ROW)
    return docs.join(copies, ROW, "left_anti").select(docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a removed passage stay as they are, white space included."""
    docs = numbered(docs)
    cut = dedup_words(docs, ROW, length=PASSAGE_WORDS).filter("n_removed > 0").select(ROW, "kept")
    text = F.coalesce("kept", "text")
    return docs.join(cut, ROW, "left").withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document, in the order of the mixture; each document is read at least once."""
    docs = numbered(docs)
    readings = mixing.mix(docs, ROW, max_repeats=MAX_REPEATS, dealt_by=content()).select(ROW, F.col("mix_key").alias("_key"))
    return docs.join(readings, ROW).orderBy("_key", ROW).select([c for c in docs.columns if c != ROW])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in batches: each reading with its text, bucket, shard, batch and position."""
    return packing.pack(docs, dealt_by=content(), keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again; what a stage has written besides is removed when it is done."""
    before = list(WRITTEN)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, docs, but=before)
    return docs


#: Toxicity, sampling and the dynamic program have no SQL; see tests/llm.
ORACLE_SQL = None
