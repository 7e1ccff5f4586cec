"""The unified catalog of events and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["item_id", "item_type", "title", "description", "tags", "campus", "starts_at", "is_active", "location", "meeting_details", "is_demo", "created_at"]


def tag_names(bridge: DataFrame, tags: DataFrame) -> DataFrame:
    return bridge.join(F.broadcast(tags), "tag_id").select("owner_id", "tag_name")


def listed(names: DataFrame) -> DataFrame:
    """Distinct tag names of each owner, ordered, as one text; aggregated before any join."""
    return names.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("tag_name")), ", ").alias("tags"))


def with_tags(items: DataFrame, owner: str, item_tags: DataFrame) -> DataFrame:
    """Untagged items stay, with an empty text."""
    return items.join(item_tags.withColumnRenamed("owner_id", owner), owner, "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def catalog(events: DataFrame, groups: DataFrame, event_tags: DataFrame, group_tags: DataFrame) -> DataFrame:
    """``event_tags`` and ``group_tags`` are (owner_id, tag_name)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    stamp = F.lit(None).cast("timestamp")

    def shape(df: DataFrame, kind: str, key: str, title: str, starts: Column, details: Column, created: Column) -> DataFrame:
        cols = [F.concat(F.lit(f"{kind}:"), key).alias("item_id"), F.lit(kind).alias("item_type"), text(title).alias("title"), text("description").alias("description"), F.col("tags"), F.col("campus"), starts.alias("starts_at"), F.col("is_active"), F.lit("").alias("location"), details.alias("meeting_details"), F.col("is_demo"), created.alias("created_at")]
        return df.select(*cols, F.concat_ws(" | ", text(title), text("description"), "tags").alias("search_text"))

    e = shape(with_tags(events, "event_id", listed(event_tags)), "event", "event_id", "title", F.col("starts_at"), F.lit(""), F.col("created_at"))
    g = shape(with_tags(groups, "group_id", listed(group_tags)), "group", "group_id", "name", stamp, text("meeting_details"), stamp)
    return e.unionByName(g)


def iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias(c)


def catalog_select(df: DataFrame) -> DataFrame:
    return df.select(*(iso(c) if c.endswith("_at") else F.col(c) for c in COLUMNS))


def upcoming(as_of: Column) -> Column:
    return F.coalesce(F.col("starts_at") >= as_of, F.lit(False))


def catalog_order(as_of: Column) -> list[Column]:
    """Future events, groups, the rest; then start, newest, id. Instants are sorted, not texts."""
    rank = F.when((F.col("item_type") == "event") & upcoming(as_of), 0).when(F.col("item_type") == "group", 1).otherwise(2)
    return [rank, F.col("starts_at").asc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("item_id")]


def order_catalog(df: DataFrame, as_of: Column, n: int = 5000) -> DataFrame:
    return df.orderBy(*catalog_order(as_of)).limit(n)


def link_by_rules(items: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(title A and tag in set A) or (title B and tag in set B) ...: a rule table and equi joins instead of a nested loop."""
    return items.join(F.broadcast(rules), "title").join(F.broadcast(tags), "tag_name").select("item_id", "tag_id").distinct()
