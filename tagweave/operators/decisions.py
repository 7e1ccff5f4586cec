"""Decisions of users on items: latest state, upsert, clear, history, undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("interested", "pass")


def latest_decisions(log: DataFrame) -> DataFrame:
    """One row for each user and item, the last by (ts, seq). ``clear`` is kept as a tombstone."""
    last = F.max_by(F.struct("action", "ts", "seq"), F.struct("ts", "seq"))
    return log.groupBy("user_id", "item_id").agg(last.alias("x")).select("user_id", "item_id", "x.*")


def current(log: DataFrame) -> DataFrame:
    return latest_decisions(log).filter("action <> 'clear'")


def upsert_decisions(swipes: DataFrame, batch: DataFrame, catalog: DataFrame, campus: str) -> tuple[DataFrame, DataFrame]:
    """(new swipes with outcome, rejects): only items of the campus' catalog count, active or not."""
    known = catalog.filter(F.col("campus") == campus).select("item_id")
    newest = latest_decisions(batch)
    good = newest.join(known, "item_id", "left_semi")
    old = swipes.select("user_id", "item_id", F.lit(True).alias("had"))
    put = good.join(old, ["user_id", "item_id"], "left").withColumn("outcome", F.when(F.col("had"), "updated").otherwise("inserted")).drop("had")
    kept = swipes.join(good.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn("outcome", F.lit("kept"))
    return kept.unionByName(put), newest.join(known, "item_id", "left_anti")


def clear_decisions(swipes: DataFrame, keys: DataFrame) -> DataFrame:
    return swipes.join(keys.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def drop_decided(items: DataFrame, swipes: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    return items.join(swipes.select(*keys).distinct(), list(keys), "left_anti")


def history(swipes: DataFrame) -> DataFrame:
    return swipes.filter(F.col("action").isin(*ACTIONS)).select("user_id", "item_id", "action")


def history_map(swipes: DataFrame, prefix: str) -> DataFrame:
    """A map of prefixed ids to actions for each user."""
    entry = F.struct(F.concat(F.lit(prefix), "item_id"), "action")
    return history(swipes).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("decisions"))


def recent_exclusions(swipes: DataFrame, n: int = 500) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item_id")
    return swipes.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)


def fold_undo(log: DataFrame) -> DataFrame:
    """What is left of each user's decisions: ``undo`` pops the newest one of the visit. (user_id, pos, item_id, action)

    The stack's height after each step is the running sum of pushes less pops, lifted by its least value below
    zero so far, as an undo without a decision does nothing. A decision is left if the height never
    falls below its own again. Both are running values over a user's sorted steps, so no list of them is built.
    """
    steps = Window.partitionBy("user_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("_sum", F.sum(F.when(F.col("action") == "undo", -1).otherwise(1)).over(steps))
    rows = rows.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(steps)))
    rows = rows.withColumn("_least", F.min("_height").over(later))
    left = rows.filter((F.col("action") != "undo") & (F.col("_least").isNull() | (F.col("_least") >= F.col("_height"))))
    return left.select("user_id", (F.col("_height") - 1).cast("int").alias("pos"), "item_id", "action")


def user_counters(users: DataFrame, open_items: DataFrame, swipes: DataFrame) -> DataFrame:
    """Available and saved items of each user, two digits at least.

    Available is the number of open items of the user's campus less those decided: no user x item join.
    """
    total = open_items.groupBy("campus").agg(F.count("*").alias("open"))
    place = open_items.select("item_id", F.col("campus").alias("item_campus"))
    seen = swipes.join(place, "item_id", "left").join(users.select("user_id", "campus"), "user_id")
    done = seen.groupBy("user_id").agg(F.count_if(F.col("item_campus") == F.col("campus")).alias("decided"), F.count_if(F.col("action") == "interested").alias("saved"))
    out = users.select("user_id", "campus").join(F.broadcast(total), "campus", "left").join(done, "user_id", "left")
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("user_id", two(zero(F.col("open")) - zero(F.col("decided"))).alias("available"), two(zero(F.col("saved"))).alias("saved"))
