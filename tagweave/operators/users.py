"""Users and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scalars as S

FIELDS = ["name", "major", "bio", "availability"]
#: The name of a user without one, and the profile that a user begins with and is reset to.
DEFAULT_NAME = "New student"
DEFAULT_PROFILE = {"name": "Alex Morgan", "major": "Computer Science", "bio": "Finding my people, one new thing at a time.", "availability": "Weekday evenings & weekends"}
DEFAULT_INTERESTS = ["Technology", "Outdoors", "Board games"]


def identities(users: DataFrame) -> DataFrame:
    return users.select("user_id", "app_user_key")


def ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Keys that do not resolve to exactly one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n <> 1")


def ensure_users(users: DataFrame, keys: DataFrame) -> DataFrame:
    """Users with the missing keys added; new ids are hashes of the key (repeatable, no global order)."""
    new = keys.select("app_user_key").distinct().join(users, "app_user_key", "left_anti")
    return users.select("user_id", "app_user_key").unionByName(new.select(F.xxhash64("app_user_key").alias("user_id"), "app_user_key"))


def ensure_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Users without a profile get the default one, without interests; others stay as they are."""
    new = users.select("user_id").join(profiles.select("user_id"), "user_id", "left_anti")
    return profiles.select("user_id", *FIELDS).unionByName(new.select("user_id", *(F.lit(DEFAULT_PROFILE[c]).alias(c) for c in FIELDS)))


def read_profiles(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` is (user_id, tag_name); empty names get the default, interests are distinct and ordered."""
    interests = names.groupBy("user_id").agg(F.array_sort(F.collect_set("tag_name")).alias("interests"))
    text = lambda c, d: S.or_else(F.col(c), F.lit(d)) if d else F.coalesce(F.col(c), F.lit(""))
    out = profiles.join(interests, "user_id", "left")
    return out.select("user_id", *(text(c, DEFAULT_NAME if c == "name" else "").alias(c) for c in FIELDS), F.coalesce("interests", F.array().cast("array<string>")).alias("interests"))


def update_profile(profiles: DataFrame, names: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, names): ``changes`` (user_id, the fields, interests; one row a user) are applied as a whole.

    The fields are set, and a user's tag names (user_id, tag_name) are replaced by the distinct ones given, none included.
    Changes of users without a profile do nothing.
    """
    known = changes.join(profiles.select("user_id"), "user_id", "left_semi")
    new = known.select("user_id", F.struct(*FIELDS).alias("new"))
    out = profiles.join(new, "user_id", "left").select("user_id", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS))
    given = known.select("user_id", F.explode(F.array_distinct("interests")).alias("tag_name"))
    return out, names.select("user_id", "tag_name").join(known.select("user_id"), "user_id", "left_anti").unionByName(given)


def reset_users(profiles: DataFrame, names: DataFrame, swipes: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The default profile with its interests and no decisions for the given users; what they published stays."""
    who = users.select("user_id").distinct()
    fresh = who.select("user_id", *(F.lit(DEFAULT_PROFILE[c]).alias(c) for c in FIELDS), F.array(*(F.lit(x) for x in DEFAULT_INTERESTS)).alias("interests"))
    now, tags = update_profile(profiles, names, fresh)
    return now, tags, swipes.join(who, "user_id", "left_anti")


def lookup(requests: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """A found / not found status for each request; secrets are never in ``target``."""
    return requests.join(target, key, "left").withColumn("status", F.when(F.col("user_id").isNotNull(), "found").otherwise("not found"))


def user_function(users: DataFrame, name: str = "get_user_by_id") -> str:
    """Register a SQL table function over ``users``: its row for an id, without secrets. Returns the function's name."""
    spark, view = users.sparkSession, f"{name}_users"
    users.select("user_id", "name", "email", "username").createOrReplaceTempView(view)
    spark.sql(f"""create or replace temporary function {name}(p_user_id bigint) returns table (user_id bigint, name string, email string, username string)
      return select user_id, name, email, username from {view} where user_id = p_user_id""")
    return name


def accept_in_order(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The rows that are accepted one after another, a row being refused if one of its ``keys`` is held by an accepted earlier row.

    By rounds, not row by row: a row that is the first open one of each of its keys is accepted, as nothing earlier can hold them;
    open rows that share a key with it are refused; the rest stays open. The first open row is accepted in each round, and among rows in
    no particular order a few rounds settle all. ``order`` is unique; null keys conflict with nothing.
    """
    open_, accepted = rows.select(order, *keys).checkpoint(), None
    while not open_.isEmpty():
        marked = open_
        for k in keys:  # aggregated before the join, so a key that many rows ask for is one row
            marked = marked.join(open_.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}")), k, "left")
        now = marked.filter(reduce(lambda a, b: a & b, (F.coalesce(F.col(f"_first_{k}") == F.col(order), F.col(k).isNull()) for k in keys))).select(order, *keys).checkpoint()
        accepted = now if accepted is None else accepted.unionByName(now)
        rest = open_.join(now.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(now.select(k), k, "left_anti")
        open_ = rest.checkpoint()
    return rows.select(order, *keys).limit(0) if accepted is None else accepted


def create_users(target: DataFrame, batch: DataFrame) -> DataFrame:
    """SUCCESS or ERROR for each row of the batch (seq, email, username), as if each were created by a statement of its own, in order.

    Both must be new: neither in ``target`` nor taken by an earlier row that succeeded. A refused row takes nothing.
    """
    free = batch
    for c in ("email", "username"):
        free = free.join(target.select(c).distinct(), c, "left_anti")
    accepted = accept_in_order(free, ["email", "username"])
    rows = batch.join(target.select("email", F.lit(True).alias("_had")).distinct(), "email", "left").join(accepted.select("email", F.col("seq").alias("_by")), "email", "left")
    taken = F.col("_had").isNotNull() | (F.col("_by") < F.col("seq"))
    status = F.when(F.coalesce(F.col("_by") == F.col("seq"), F.lit(False)), "SUCCESS").when(F.coalesce(taken, F.lit(False)), "ERROR: email already exists").otherwise("ERROR: username already exists")
    return rows.select("seq", "email", "username", status.alias("status"))


def create_profiles(users: DataFrame, batch: DataFrame) -> DataFrame:
    known = users.select("user_id", F.lit(True).alias("known")).distinct()
    return batch.join(known, "user_id", "left").withColumn("status", F.when(F.col("known"), "SUCCESS").otherwise("ERROR: user does not exist")).drop("known")
