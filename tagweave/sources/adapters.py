"""The driver's tables as the model's tables: events, groups, tags, profiles, decisions, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")

    def events(self) -> DataFrame:
        home = self.raw("customer").join(F.broadcast(self.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
        date = F.col("o_orderdate").cast("timestamp")
        return self.raw("orders").join(home, F.col("o_custkey") == F.col("c_custkey")).select(
            (F.col("o_orderkey") + 1).alias("event_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("description"), F.when(F.col("o_orderkey") % 101 != 0, date).alias("starts_at"),
            (date - F.expr("interval 30 days")).alias("created_at"), F.col("n_name").alias("campus"), (F.col("o_orderstatus") != "F").cast("int").alias("is_active"), (F.col("o_orderkey") % 50 == 0).alias("is_demo"),
        )

    def groups(self) -> DataFrame:
        return self.raw("part").select(
            (F.col("p_partkey") + 1).alias("group_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("meeting_details"),
            F.concat(F.lit("NATION_"), F.col("p_partkey") % 25).alias("campus"), F.lit(1).alias("is_active"), (F.col("p_partkey") % 50 == 0).alias("is_demo"),
        )

    def event_tag_names(self) -> DataFrame:
        return self.raw("lineitem").select((F.col("l_orderkey") + 1).alias("owner_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag_name")).distinct()

    def group_tag_names(self) -> DataFrame:
        return self.raw("part").select((F.col("p_partkey") + 1).alias("owner_id"), F.explode(F.concat(F.split("p_name", " "), F.array("p_type"))).alias("tag_name")).distinct()

    def tags(self) -> DataFrame:
        """The tag dimension is small: names are distinct before they are numbered."""
        names = self.event_tag_names().select("tag_name").union(self.group_tag_names().select("tag_name")).distinct()
        return names.select(F.row_number().over(Window.orderBy("tag_name")).cast("long").alias("tag_id"), "tag_name")

    def event_tags(self) -> DataFrame:
        return self.event_tag_names().join(F.broadcast(self.tags()), "tag_name").select("owner_id", "tag_id")

    def group_tags(self) -> DataFrame:
        return self.group_tag_names().join(F.broadcast(self.tags()), "tag_name").select("owner_id", "tag_id")

    def profiles(self) -> DataFrame:
        nation = F.broadcast(self.raw("nation"))
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(self.raw("part"), F.col("c_custkey") == F.col("p_partkey")).select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("major"), F.col("p_type").alias("bio"), F.lit("").alias("availability"), F.col("n_name").alias("campus"), F.split("p_name", " ").alias("interests"),
        )

    def log(self) -> DataFrame:
        action = F.when(F.col("event_type").isin("purchase", "click"), "interested").when(F.col("event_type") == "signup", "clear").otherwise("pass")
        item = F.concat(F.lit("event:"), F.get_json_object("props", "$.k").cast("long") + 1)
        return self.raw("events").select("user_id", item.alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"))

    def listings(self) -> DataFrame:
        i = F.col("doc_id")
        start = F.date_format(F.timestamp_seconds(F.unix_timestamp(self.as_of) + i * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return self.raw("documents").select(
            F.when(i % 97 == 0, "bad").otherwise(F.md5(i.cast("string").cast("binary"))).alias("event_id"), F.when(i % 97 == 3, " ").otherwise(F.substring("text", 1, 60)).alias("title"), F.when(i % 97 == 1, "tomorrow").otherwise(start).alias("start_time"),
            F.when(i % 97 == 2, "javascript:alert(1)").otherwise(F.concat(F.lit("https://example.org/e/"), i)).alias("source_url"), F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("description"),
            F.when(i % 10 == 0, "").otherwise(F.concat(F.lit("About "), "source")).alias("short_description"), F.when(i % 20 != 0, F.col("source")).alias("organizer_name"), (i % 7 == 0).alias("all_day"),
            F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("venue_name"), F.lit(None).cast("string").alias("address"), (i % 2 == 0).alias("is_online"), (F.col("lang") == "en").alias("is_umd"),
            F.lit(None).cast("string").alias("created_at"), F.lit("1997-12-01T00:00:00Z").alias("last_seen_at"), F.array("lang", "source", "lang").alias("tags"),
        )
