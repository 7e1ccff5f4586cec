"""Scalar rules as Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Prefixes, sentences and labels that have to equal the ones in stored data.
REMOTE_PREFIX = "snowflake:"
IMPORT_PREFIX = "umd-import:"
HOME_CAMPUS, NEAR_CAMPUS = "UMD", "NEAR_UMD"
ALL_DAY = "All-day event; check the official listing for attendance hours."
SOURCE = r"^Official listing: (https://\S+)\n\n"
TOPICS = [
    ("board game|game night|catan", "dice"),
    ("coffee|café|cafe", "coffee"),
    ("food|cook|chef|culture", "food"),
    ("art|draw|creative|sketch", "palette"),
    ("hik|trail|adventure|scenic", "mountain"),
    ("yoga|fitness|wellness", "sun"),
    (r"tech|computer|hack|code|cs\b", "code"),
]
DEFAULT_TOPIC = "sparkles"
SPACES = r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$"


def trim(c: Column) -> Column:
    """White space at both ends, no-break space and byte order mark included."""
    return F.regexp_replace(c, SPACES, "")


def or_else(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def parse_tags(c: Column, most: int = 8, length: int = 30) -> Column:
    """Lenient: distinct trimmed parts, the first ``most``, then cut (without a second look for duplicates)."""
    parts = F.array_distinct(F.filter(F.transform(F.split(c, ","), trim), lambda t: t != ""))
    return F.transform(F.slice(parts, 1, most), lambda t: F.substring(t, 1, length))


def tag_preview(tags: Column) -> Column:
    return F.slice(tags, 1, 3)


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_time(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))


ITEM_ID = rf"^{REMOTE_PREFIX}(event|group):([1-9]\d{{0,18}})$"


def item_kind(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ITEM_ID, 1), F.lit(""))


def item_number(c: Column) -> Column:
    """As text: 19 digits can exceed a long."""
    return F.nullif(F.regexp_extract(c, ITEM_ID, 2), F.lit(""))


def item_id(kind: str, number: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}{kind}:"), number.cast("string"))


def valid_publish_key(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def profile_query(major: Column, interests: Column, bio: Column) -> Column:
    """Search text of a profile; null if all parts are empty."""
    names = F.array_join(F.filter(F.transform(interests, trim), lambda t: t != ""), ", ")
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.nullif(F.concat_ws(". ", part("Major: ", trim(major)), part("Interests: ", names), part("About me: ", trim(bio))), F.lit(""))


def source_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, SOURCE, 1), F.lit(""))


def strip_source(c: Column) -> Column:
    return F.regexp_replace(c, SOURCE, "")


def all_day(c: Column) -> Column:
    return c.contains(ALL_DAY)


def ellipsis(c: Column, most: int = 2000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def campus_date(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd")


def campus_time(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "HH:mm")


def campus_to_utc(date: Column, time: Column) -> Column:
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date, time), "yyyy-MM-dd HH:mm"), ZONE)


def offset_timestamp(c: Column) -> Column:
    """The instant of a text that ends in Z or a signed offset, else null."""
    return F.when(c.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(c))


def is_https(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")) == "https", F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c.cast("string") == "true", F.lit(False))


def is_one(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double") == 1, F.lit(False))


def clock_12h(time: Column) -> Column:
    ok = time.rlike(r"^\d{1,2}:\d{1,2}$")
    h, m = F.split(time, ":")[0].cast("int"), F.split(time, ":")[1].cast("int")
    return F.when(ok, F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.when(h >= 12, " PM").otherwise(" AM"))).otherwise("")


def schedule(kind: Column, details: Column, date: Column, time: Column, whole_day: Column) -> Column:
    day = F.try_to_date(date, "yyyy-MM-dd")
    when = F.when(whole_day, "All day").otherwise(or_else(clock_12h(time), F.lit("Time to come")))
    event = F.when(day.isNull(), "Date to come").otherwise(F.concat(F.date_format(day, "MMM d, yyyy"), F.lit(" · "), when))
    return F.when(kind == "group", or_else(details, F.lit("Meeting details to come"))).otherwise(event)


def short_schedule(kind: Column, details: Column, date: Column, time: Column, whole_day: Column) -> Column:
    day, clock = F.try_to_date(date, "yyyy-MM-dd"), clock_12h(time)
    text = F.date_format(day, "EEE, MMM d")
    event = F.when(day.isNull(), "Date to come").when(whole_day, F.concat(text, F.lit(", all day"))).when(clock != "", F.concat(text, F.lit(" at "), clock)).otherwise(text)
    return F.when(kind == "group", or_else(details, F.lit("Meets regularly"))).otherwise(event)


def topic_of(tags: Column, title: Column) -> Column:
    text, out = F.concat(F.array_join(tags, " "), F.lit(" "), title), None
    for pattern, topic in TOPICS:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise(DEFAULT_TOPIC)


def initials(name: Column) -> Column:
    words = F.slice(F.filter(F.split(trim(name), r"\s+"), lambda w: w != ""), 1, 2)
    return or_else(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), F.lit("T"))
