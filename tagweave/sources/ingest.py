"""Ingest: read and normalise listings, insert what is new, keep tags and bridges."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.functions import scalars as S
from tagweave.functions.validate import messages

LISTING = "event_id string, title string, start_time string, source_url string, description string, short_description string, organizer_name string, all_day boolean, venue_name string, address string, is_online boolean, is_umd boolean, created_at string, last_seen_at string, tags array<string>"


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; a broken line gets ``_corrupt`` and nulls."""
    return spark.read.schema(f"{LISTING}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def normalize_listings(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds the stored fields and ``errors``, a list that is empty for a good listing."""
    start = S.offset_timestamp(F.col("start_time"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    # Message texts.
    errors = messages(
        (~ok(F.col("event_id").rlike("^[a-f0-9]{32}$")) | ~ok(S.trim(F.col("title")) != ""), "Invalid event identity/title."), (start.isNull(), "Invalid event timestamp."), (~S.is_https(F.col("source_url")), "Event source must use HTTPS."),
    )
    hosted = F.concat(F.lit("Hosted by "), S.or_else(F.col("organizer_name"), F.lit("the event organizer")), F.lit(". See the official listing for details."))
    text = S.or_else(F.col("description"), F.col("short_description"), hosted)
    day = F.when(ok(F.col("all_day")), f"\n\n{S.ALL_DAY}").otherwise("")
    created = F.coalesce(F.try_to_timestamp(S.or_else(F.col("created_at"), F.col("last_seen_at"))), as_of)
    return df.select(
        F.concat(F.lit(S.IMPORT_PREFIX), "event_id").alias("key"), S.trim(F.col("title")).alias("title"), F.concat(F.lit("Official listing: "), "source_url", F.lit("\n\n"), text, day).alias("description"),
        S.or_else(F.col("venue_name"), F.col("address"), F.when(ok(F.col("is_online")), "Online"), F.lit("Location listed on official event page")).alias("location"), start.alias("starts_at"),
        F.when(ok(F.col("is_umd")), S.HOME_CAMPUS).otherwise(S.NEAR_CAMPUS).alias("campus"), created.alias("created_at"), F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), S.trim), lambda t: t != "")).alias("tags"), errors.alias("errors"),
    )


def quarantine(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size(errors) == 0).drop(errors), df.filter(F.size(errors) > 0)


def assert_valid(df: DataFrame, errors: str = "errors") -> DataFrame:
    """All or nothing: the first bad row fails the job."""
    return df.filter(F.when(F.size(errors) > 0, F.raise_error(F.concat_ws(" ", F.lit("Invalid row; nothing imported:"), errors))).otherwise(F.lit(True))).drop(errors)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError("Duplicate IDs in file; nothing imported.")
    return df


def unnest_json(df: DataFrame, column: str, schema: str, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.explode(F.from_json(column, schema)))


def flatten_variant(df: DataFrame, column: str) -> DataFrame:
    """A row for each entry of the JSON text in ``column``, whatever its kind: (the other columns, index, key, value).

    Of an array, ``index`` counts from 0 and ``key`` is null; of an object, both are set, by name. ``value`` is a VARIANT. Other values, broken and
    null texts have no rows.
    """
    rest = [c for c in df.columns if c != column]
    found = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.try_parse_json(F.col(column).outer())))
    return found.select(*rest, F.col("pos").alias("index"), "key", "value")


def add_columns(spark: SparkSession, table: str, columns: dict[str, tuple[str, object]]) -> None:
    """ALTER TABLE ... ADD COLUMN with defaults, for those that are not there yet: files written before read as the default, stored NULLs stay."""
    had = {c.lower() for c in spark.table(table).columns}
    new = [f"{c} {kind}" + ("" if default is None else f" DEFAULT {default!r}") for c, (kind, default) in columns.items() if c.lower() not in had]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target``; one of each key."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def merge_insert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE ... WHEN NOT MATCHED THEN INSERT: existing rows stay as they are."""
    return target.unionByName(insert_new(target, source, keys), allowMissingColumns=True)


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """``name`` counts the rows in order from ``start`` + 1 on, without one task for all: partitions are ranges of
    ``order``, and each adds the sizes of those before it (one small row for each partition)."""
    part = F.spark_partition_id()
    placed = df.repartitionByRange(order).sortWithinPartitions(order).select("*", part.alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long")).alias("_nth")).checkpoint()
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("before") + F.col("_nth") + 1 + start).cast("long")).drop("_part", "_nth", "before")


def upsert_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with the missing names added; only the new ones are numbered, on from the highest id."""
    new = names.select("tag_name").distinct().join(tags, "tag_name", "left_anti")
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last")).first()["last"]
    return tags.select("tag_id", "tag_name").unionByName(numbered(new, "tag_name", "tag_id", last).select("tag_id", "tag_name"))


def canonical_tags(tags: DataFrame) -> DataFrame:
    """One id for each name, though the dimension may hold duplicates."""
    return tags.groupBy("tag_name").agg(F.min("tag_id").alias("tag_id"))


def link_tags(items: DataFrame, tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """New (owner_id, tag_id) pairs of items (owner_id, tags array)."""
    named = items.select("owner_id", F.explode("tags").alias("tag_name")).distinct()
    return named.join(canonical_tags(tags), "tag_name").select("owner_id", "tag_id").join(bridge, ["owner_id", "tag_id"], "left_anti")


def replace_tags(bridge: DataFrame, items: DataFrame, tags: DataFrame) -> DataFrame:
    """The owners in ``items`` get exactly the given tags; ``tags`` holds all names already."""
    kept = bridge.join(items.select("owner_id").distinct(), "owner_id", "left_anti")
    return kept.unionByName(link_tags(items, tags, bridge.limit(0)))


def import_listings(rows: DataFrame, before: DataFrame, path: str, as_of: Column) -> DataFrame:
    """Write what ``before`` holds and the new ones of ``rows`` to ``path``, all or nothing; returns the report, one row.

    ``rows`` are normalised listings with ``errors``, ``before`` has the same columns but that one. The figures are observed while the table is
    written, so nothing is read twice: rows of both sides are grouped by key, the stored row wins, and one write counts all. The
    table is written beside ``path`` and takes its name only if no row had an error; otherwise it is removed and the error raised.
    """
    spark, mine = rows.sparkSession, F.col("key").startswith(S.IMPORT_PREFIX)
    fields = [c for c in before.columns if c != "key"]
    both = before.select("key", F.lit(1).alias("_had"), F.lit("").alias("_error"), F.struct(*fields).alias("_row")).unionByName(
        rows.select("key", F.lit(0).alias("_had"), F.array_join("errors", " ").alias("_error"), F.struct(*fields).alias("_row"))
    )
    one = both.groupBy("key").agg(F.sum("_had").alias("_had"), (F.count("*") - F.sum("_had")).alias("_came"), F.max("_error").alias("_error"), F.max_by("_row", "_had").alias("_row")).select("*", "_row.*")
    home = mine & (F.col("campus") == S.HOME_CAMPUS)
    seen = Observation("import")
    watched = one.observe(
        seen, F.sum("_came").alias("file_rows"), F.count_if(mine & (F.col("_had") == 0)).alias("inserted"), F.count_if(mine).alias("total"), F.count_if(home).alias("home"),
        F.count_if(home & (F.col("starts_at") >= as_of)).alias("upcoming_home"), F.count_if(mine & (F.col("_had") > 1)).alias("duplicate_keys"), F.max("_error").alias("error"),
    )
    draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    watched.select("key", *fields).write.parquet(draft)
    report, at = seen.get, spark._jvm.org.apache.hadoop.fs.Path
    fs = at(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    if report["error"]:
        fs.delete(at(draft), True)
        raise ValueError(f"nothing imported: {report['error']}")
    if fs.exists(at(path)) or not fs.rename(at(draft), at(path)):
        fs.delete(at(draft), True)
        raise ValueError(f"{path} is there already")
    names = ["file_rows", "inserted", "total", "home", "upcoming_home", "duplicate_keys"]
    return spark.createDataFrame([tuple(report[n] or 0 for n in names)], ", ".join(f"{n} long" for n in names))


def align_schema(df: DataFrame, spec: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns with a typed default; present ones, nulls included, stay."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in spec.items() if c not in df.columns})


def draft_key(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dedup_drafts(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Equal drafts have one key; the first of each stays."""
    first = Window.partitionBy("publish_key").orderBy(order)
    return df.withColumn("publish_key", draft_key(*columns)).withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def item_number(*key: str) -> Column:
    """A positive number for a natural key."""
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 63) - 1).cast("long"))


ITEM = ["publish_key", "kind", "user_id", "title", "description", "location", "meeting_details", "starts_at", "campus", "is_active", "is_demo", "created_at"]


def publish(items: DataFrame, tags: DataFrame, bridge: DataFrame, batch: DataFrame, as_of: Column, campus: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, tags, bridge, cards) after the calls of ``batch``, each as if made alone, in order of ``seq``.

    ``batch`` is checked drafts: publish_key, user_id, kind, title, description, location, meeting_details, date, time, tags, seq.
    A key (of its kind) is stored once, with all columns of its first call that succeeds. A call succeeds if the key is its user's, and if the card can
    be read back: an event must not be past. Any other call changes nothing and has no card. Each successful call replaces the
    item's tags, a retry too, and returns the card: the stored item with the call's tags, as a decoder shows it. ``bridge`` is (owner_id, tag_id), and an
    item's number is made from its kind and key.
    """
    key = ["kind", "publish_key"]
    event = F.col("kind") == "event"
    calls = batch.withColumn("starts_at", F.when(event, S.campus_to_utc(F.col("date"), F.col("time"))))
    open_ = ~event | F.coalesce(F.col("starts_at") >= as_of, F.lit(False))
    given = ["user_id", "title", "description", "location", "meeting_details", "starts_at"]
    first = calls.filter(open_).groupBy(*key).agg(F.min_by(F.struct(*given, "seq"), "seq").alias("r")).select(*key, "r.*").join(items, key, "left_anti")
    details = lambda c, kind: F.when(F.col("kind") == kind, F.col(c)).otherwise("").alias(c)
    new = first.select(*key, "user_id", "title", "description", "location", details("meeting_details", "group"), "starts_at", F.lit(campus).alias("campus"), F.lit(1).alias("is_active"), F.lit(False).alias("is_demo"), as_of.alias("created_at"), F.col("seq").alias("since"))
    known = items.select(*ITEM, F.lit(None).cast("long").alias("since")).unionByName(new.withColumn("since", F.col("since").cast("long")))
    done = calls.select(*key, "user_id", "seq", "tags").join(known, [*key, "user_id"]).filter(open_ & (F.col("since").isNull() | (F.col("seq") >= F.col("since"))))
    last = done.groupBy(*key).agg(F.max_by("tags", "seq").alias("tags")).select(item_number(*key).alias("owner_id"), "tags")
    all_tags = upsert_tags(tags, last.select(F.explode("tags").alias("tag_name")))
    shown = F.array_join(S.parse_tags(F.array_join(F.array_sort(F.array_distinct("tags")), ", ")), ",")
    text = S.trim(F.col("description"))
    cards = done.select(
        *key, "user_id", "seq", F.concat(F.lit(S.REMOTE_PREFIX), S.item_id(F.col("kind"), item_number(*key))).alias("id"), S.trim(F.col("title")).alias("title"), S.ellipsis(S.strip_source(text)).alias("description"), S.source_url(text).alias("source_url"), "location", "meeting_details",
        "starts_at", F.when(event, S.campus_date(F.col("starts_at"))).otherwise("").alias("date"), F.when(event, S.campus_time(F.col("starts_at"))).otherwise("").alias("time"), "campus", shown.alias("tags"),
    )
    return known.select(*ITEM), all_tags, replace_tags(bridge, last, all_tags), cards


def audit_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


STATE = "struct<version:int,items:array<struct<id:string,kind:string,title:string>>,profile:struct<name:string>,decisions:map<string,string>>"


def explode_state(df: DataFrame, column: str = "state") -> tuple[DataFrame, DataFrame]:
    """(items, decisions) of the documents that pass the checks."""
    s = F.from_json(column, STATE)
    good = (s["version"] == 1) & s["items"].isNotNull() & s["profile"].isNotNull() & s["decisions"].isNotNull()
    good = good & F.forall(s["items"], lambda i: i["kind"].isin("group", "event") & i["id"].isNotNull() & i["title"].isNotNull()) & F.forall(F.map_values(s["decisions"]), lambda v: v.isin("pass", "interested"))
    ok = df.withColumn("s", s).filter(F.coalesce(good, F.lit(False)))
    rest = [c for c in df.columns if c != column]
    return ok.select(*rest, F.explode("s.items").alias("i")).select(*rest, "i.*"), ok.select(*rest, F.explode("s.decisions").alias("item_id", "action"))


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/whole")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def write_catalog(df: DataFrame, path: str, keep: int = 2) -> int:
    """Materialise a catalog as a new version, one folder for each campus and type, rows in order of start in each file.

    A version counts once it is whole, so readers see the one before until then, and those who have begun with it can go on: the last
    ``keep`` versions stay. A campus' search reads its folder only, and skips the row groups of other times. One writer at a time.
    """
    spark, at = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    fs, had = _versions(spark, path)
    version = had[-1] + 1 if had else 0
    spread = df.repartition("campus", "item_type", F.pmod(F.xxhash64("item_id"), F.lit(8)))  # up to eight files a folder, so that a large campus is not one task's
    spread.sortWithinPartitions("campus", "item_type", "starts_at").write.mode("overwrite").partitionBy("campus", "item_type").parquet(f"{path}/data/{version}")
    fs.mkdirs(at(f"{path}/whole/{version}"))
    for old in had[: len(had) + 1 - keep]:
        fs.delete(at(f"{path}/whole/{old}"), True)
        fs.delete(at(f"{path}/data/{old}"), True)
    return version


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version."""
    return spark.read.parquet(f"{path}/data/{_versions(spark, path)[1][-1]}")


def seed_rows(campuses: DataFrame, as_of: Column) -> DataFrame:
    """Inline demo events for each campus; days count from ``as_of``."""
    # Fixed values.
    rows = [("Demo: Beginner AI Hackathon", "Iribe Center", 3), ("Demo: K-pop Dance Workshop", "Stamp Student Union", 4)]
    inline = F.explode(F.array(*(F.struct(F.lit(t).alias("title"), F.lit(p).alias("location"), F.lit(d).alias("days")) for t, p, d in rows)))
    return campuses.select("campus", inline.alias("r")).select("campus", "r.title", "r.location", (as_of + F.make_dt_interval("r.days")).alias("starts_at"))
