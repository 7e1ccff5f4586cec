"""Golden examples of the scalar rules and checks."""

import collections
import json
import math
import random
import re
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.functions import scalars as S
from tagweave.functions import validate as V
from tagweave.operators import catalog as C
from tagweave.operators import feed as P
from tagweave.operators import recommend as R
from tagweave.operators import users as U
from tagweave.sources import ingest as I
from tagweave.streaming import streams as X


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_tags(spark):
    assert one(spark, S.parse_tags(F.lit(" Coding , Social, Coding, , Outdoors"))) == ["Coding", "Social", "Outdoors"]
    assert one(spark, F.size(S.parse_tags(F.lit("a,b,c,d,e,f,g,h,i")))) == 8
    assert one(spark, V.bad_tags(F.array(F.lit("a,b"))))


def test_dates(spark):
    assert [one(spark, S.valid_date(F.lit(x))) for x in ("2026-02-30", "2028-02-29", "2026-2-3")] == [False, True, False]
    assert [one(spark, S.valid_time(F.lit(x))) for x in ("23:59", "24:00", "7:00")] == [True, False, False]
    at = F.lit("2026-10-05T22:00:00Z").cast("timestamp")
    assert (one(spark, S.campus_date(at)), one(spark, S.campus_time(at))) == ("2026-10-05", "18:00")
    assert one(spark, S.offset_timestamp(F.lit("tomorrow"))) is None


def test_draft_errors(spark):
    empty = [F.lit(x) for x in ("", "", "", "", "")]
    assert len(one(spark, V.draft_errors(F.lit("event"), *empty))) == 4
    assert one(spark, V.draft_errors(F.lit("group"), F.lit("x"), F.lit(" "), *empty[2:])) == ["Add a group description."]


def test_ids(spark):
    good, bad = "snowflake:event:7", ["event:7", "snowflake:event:07", "snowflake:people:7", "snowflake:event:12345678901234567890"]
    assert one(spark, S.item_kind(F.lit(good))) == "event" and one(spark, S.item_number(F.lit(good))) == "7"
    assert all(one(spark, S.item_kind(F.lit(b))) is None for b in bad)


def test_extraction(spark):
    draft = {"kind": "event", "title": "T", "description": "", "location": "", "date": "2026-02-30", "time": "25:00", "meetingDetails": "", "tags": [], "reviewNotes": []}
    text = lambda *d: F.lit(json.dumps({"drafts": list(d)}))
    assert one(spark, V.extraction_error(text(draft))) is None
    found = one(spark, V.extracted_drafts(text(draft)))[0]
    assert found["date"] == "" and found["time"] == "" and len(found["reviewNotes"]) >= 3
    assert one(spark, V.extraction_error(text(*[draft] * 6))) == "Invalid extraction envelope"
    assert one(spark, V.extraction_error(text(draft | {"tags": [7]}))) == "Invalid tags"
    assert one(spark, V.extraction_error(text(draft, draft | {"title": "x" * 101, "tags": None}))) == "Invalid title"
    assert one(spark, V.extraction_error(text(draft | {"kind": "people", "title": 7}))) == "Invalid draft kind"
    assert one(spark, V.extraction_error(text(draft | {"reviewNotes": ["n"] * 11}))) == "Invalid reviewNotes"
    assert one(spark, V.extraction_error(F.lit(json.dumps({"drafts": [7]})))) == "Invalid draft kind"


def test_texts(spark):
    assert one(spark, S.initials(F.lit("Alex Morgan"))) == "AM" and one(spark, S.initials(F.lit(" "))) == "T"
    a = [F.lit(x) for x in ("event", "", "2026-10-09", "19:00")]
    assert one(spark, S.schedule(*a, F.lit(False))) == "Oct 9, 2026 · 7:00 PM"
    assert one(spark, S.short_schedule(*a, F.lit(False))) == "Fri, Oct 9 at 7:00 PM"
    long = F.concat(F.lit("Official listing: https://example.org/x\n\n"), F.repeat(F.lit("b"), 5356))
    assert len(one(spark, S.ellipsis(S.strip_source(long)))) == 2000 and one(spark, S.source_url(long)) == "https://example.org/x"
    assert one(spark, V.render_prompt(F.lit('say "hi"'))).endswith('"say \\"hi\\""')


def test_merge(spark):
    old = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "item_id string, title string, pos int")
    new = spark.createDataFrame([("b", "B2", 0), ("c", "C", 1)], "item_id string, title string, pos int")
    assert [r["title"] for r in P.merge_cards(old, new).orderBy("is_existing", "pos").collect()] == ["C", "A", "B2"]


def test_import_rejects(spark, tmp_path):
    base = {"event_id": "a" * 32, "title": "T", "start_time": "2026-10-05T22:00:00Z", "source_url": "https://example.org"}
    rows = [base, base | {"event_id": "bad"}, base | {"start_time": "tomorrow"}, base | {"source_url": "javascript:alert(1)"}, base | {"title": ""}]
    (tmp_path / "x.jsonl").write_text("\r\n".join(map(json.dumps, rows)) + "\n\n")
    got = I.normalize_listings(I.read_listings(spark, str(tmp_path / "x.jsonl")), F.current_timestamp())
    ok, bad = I.quarantine(got)
    assert (ok.count(), bad.count()) == (1, 4)


def test_all_or_nothing(spark):
    rows = spark.createDataFrame([("a", []), ("b", ["Invalid event timestamp."])], "key string, errors array<string>")
    assert [r["key"] for r in I.assert_valid(rows.filter("key = 'a'")).collect()] == ["a"]
    with pytest.raises(Exception, match="nothing imported: Invalid event timestamp"):
        I.assert_valid(rows).collect()
    assert I.assert_unique(rows, ["key"]) is rows
    with pytest.raises(ValueError, match="Duplicate IDs"):
        I.assert_unique(rows.unionByName(rows), ["key"])


def test_new_tags_go_on_from_the_highest_id(spark):
    had = spark.createDataFrame([(7, "b"), (9, "d")], "tag_id long, tag_name string")
    names = spark.createDataFrame([(f"t{i:03d}",) for i in range(300)] + [("b",), ("d",)], "tag_name string").repartition(6)
    got = {r["tag_name"]: r["tag_id"] for r in I.upsert_tags(had, names).collect()}
    assert got == {"b": 7, "d": 9} | {f"t{i:03d}": 10 + i for i in range(300)}
    assert I.upsert_tags(had, names.limit(0)).count() == 2


def test_import_is_one_write(spark, tmp_path):
    row = lambda key, campus, *errors: (key, campus, datetime(2026, 1, 1 + int(key[-1])), list(errors))
    schema = "key string, campus string, starts_at timestamp, errors array<string>"
    come = spark.createDataFrame([row("umd-import:1", "UMD"), row("umd-import:2", "NEAR_UMD"), row("umd-import:3", "UMD"), row("umd-import:3", "UMD"), row("other:9", "UMD")], schema)
    had = spark.createDataFrame([row("umd-import:1", "OLD"), row("umd-import:4", "UMD")], schema).drop("errors")
    now, path = F.lit("2026-01-05").cast("timestamp"), f"file://{tmp_path}/table"
    assert I.import_listings(come, had, path, now).first().asDict() == {"file_rows": 5, "inserted": 2, "total": 4, "home": 2, "upcoming_home": 1, "duplicate_keys": 0}
    assert sorted((r["key"], r["campus"]) for r in spark.read.parquet(path).collect()) == [("other:9", "UMD"), ("umd-import:1", "OLD"), ("umd-import:2", "NEAR_UMD"), ("umd-import:3", "UMD"), ("umd-import:4", "UMD")]
    with pytest.raises(ValueError, match="nothing imported: bad"):
        I.import_listings(come.unionByName(spark.createDataFrame([row("umd-import:5", "UMD", "bad")], schema)), had, f"{path}2", now)
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_catalog_versions(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    I.write_catalog(catalog_of(spark, 20), path)
    reader = I.read_catalog(spark, path)
    I.write_catalog(catalog_of(spark, 30), path)
    assert reader.count() == 20 and I.read_catalog(spark, path).count() == 30
    assert I.write_catalog(catalog_of(spark, 5), path) == 2 and {p.name for p in (tmp_path / "catalog/data").iterdir()} == {"1", "2"}


def test_publish_call_by_call(spark):
    """Owners, past events, retries that bring other tags, and a key for each kind."""
    base = {"publish_key": "a", "user_id": 1, "kind": "event", "title": " T ", "description": "Official listing: https://example.org/x\n\nBody", "location": "L", "meeting_details": "m", "date": "2026-05-01", "time": "18:30", "tags": ["x", "y"], "seq": 2}
    calls = [base | {"seq": 1, "date": "2020-01-01"}, base, base | {"seq": 3, "user_id": 2}, base | {"seq": 4, "title": "other", "tags": ["z", "z"], "date": "2020-01-01"}, base | {"seq": 5, "kind": "group", "user_id": 2}, base | {"seq": 6, "publish_key": "b", "tags": []}]
    batch = spark.createDataFrame(calls, "publish_key string, user_id long, kind string, title string, description string, location string, meeting_details string, date string, time string, tags array<string>, seq long")
    none = spark.createDataFrame([], "publish_key string, kind string, user_id long, title string, description string, location string, meeting_details string, starts_at timestamp, campus string, is_active int, is_demo boolean, created_at timestamp")
    had, links = spark.createDataFrame([(7, "x")], "tag_id long, tag_name string"), spark.createDataFrame([], "owner_id long, tag_id long")
    items, tags, bridge, cards = I.publish(none, had, links, batch, F.lit("2026-01-01").cast("timestamp"), "UMD")
    got = {r["seq"]: (r["title"], r["description"], r["source_url"], r["date"], r["time"], r["tags"], r["meeting_details"]) for r in cards.collect()}
    shown = ("T", "Body", "https://example.org/x", "2026-05-01", "18:30")
    assert got == {2: (*shown, "x,y", ""), 4: (*shown, "z", ""), 5: (*shown[:3], "", "", "x,y", "m"), 6: (*shown, "", "")}
    named = lambda b, n: sorted((r["kind"], r["publish_key"], r["tag_name"]) for r in items.withColumn("owner_id", I.item_number("kind", "publish_key")).join(b, "owner_id").join(n, "tag_id").collect())
    assert named(bridge, tags) == [("event", "a", "z"), ("group", "a", "x"), ("group", "a", "y")] and items.count() == 3
    items, tags, bridge, cards = I.publish(items, tags, bridge, batch.filter("seq = 4").withColumn("tags", F.array(F.lit("x"))), F.lit("2026-01-01").cast("timestamp"), "UMD")
    assert cards.count() == 1 and ("event", "a", "x") in named(bridge, tags) and ("event", "a", "z") not in named(bridge, tags)


def test_undo_touches_only_the_top():
    """State calls of a step do not grow with the stack's height."""
    from collections import namedtuple

    step, calls = namedtuple("Step", "ts seq item_id action"), []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Places(dict):
        def __getattr__(self, name):
            def call(k=None, v=None):
                calls.append(name)
                return {"containsKey": lambda: k in self, "getValue": lambda: self.get(k), "updateValue": lambda: self.update({k: v}), "removeKey": lambda: self.pop(k, None), "clear": lambda: dict.clear(self)}[name]()

            return call

    u, most = X.UndoStack(), {}
    u.height, u.steps = Value(), Places()
    want = []
    r = random.Random(1)
    for n in range(3000):
        rows = [step(n, k, f"i{n}-{k}", "undo" if r.random() < 0.3 else "pass") for k in range(2)]
        for x in rows:
            want = want[:-1] if x.action == "undo" else [*want, (x.item_id, x.action)]
        before = len(calls)
        out = next(iter(u.handleInputRows((1,), iter(rows), None)))
        most[len(calls) - before] = n
        assert (out.depth, out.item_id, out.action) == (len(want), *(want[-1] if want else (None, None)))
    assert len(want) > 1000 and max(most) <= 4


CATALOG = "item_id string, item_type string, title string, campus string, starts_at timestamp, created_at timestamp, is_active int, is_demo boolean, search_text string"


def catalog_of(spark, n, **change):
    rows = [{"item_id": f"group:{i:04d}", "item_type": "group", "title": "t", "campus": "A", "starts_at": None, "created_at": None, "is_active": 1, "is_demo": False, "search_text": "chess " * (1 + i % 3)} | change for i in range(n)]
    return spark.createDataFrame(rows, CATALOG)


def swipes_of(spark, pairs):
    return spark.createDataFrame([(u, i, "pass", k) for k, (u, i) in enumerate(pairs)], "user_id long, item_id string, action string, seq long").withColumn("ts", F.timestamp_seconds("seq"))


def test_exclusions_come_before_the_cut(spark):
    items = catalog_of(spark, 700)
    profiles = spark.createDataFrame([(u, "A", "chess", ["x"], "") for u in (1, 2)], "user_id long, campus string, major string, interests array<string>, bio string")
    now, index = F.lit("2026-01-01").cast("timestamp"), R.build_index(items)
    best = [r["item_id"] for r in R.recommend(profiles.filter("user_id = 1"), index, now, 700).orderBy("rank").collect()]
    swipes = swipes_of(spark, [(1, i) for i in best[:60]])  # the whole top 50 and more is decided
    got = R.recommend_for_users(profiles, profiles, swipes, index, items, now)
    ranks = lambda u: [(r["item_id"], r["rank"]) for r in got.filter(f"user_id = {u}").orderBy("rank").collect()]
    assert ranks(1) == [(i, k + 1) for k, i in enumerate(best[60:110])] and ranks(2) == [(i, k + 1) for k, i in enumerate(best[:50])]
    # Only the last 500 decisions go into the search; older ones are dropped afterwards.
    swipes = swipes_of(spark, [(1, i) for i in best[:520]])
    got = R.recommend_for_users(profiles, profiles, swipes, index, items, now)
    assert [x for x, _ in ranks(1)] == best[520:550]


def test_decks(spark):
    items = catalog_of(spark, 8).unionByName(catalog_of(spark, 2, campus="B").withColumn("item_id", F.concat("item_id", F.lit("b"))))
    users = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C")], "user_id long, campus string")
    ranked = spark.createDataFrame([(1, "group:0005", 1), (1, "group:0002", 2), (1, "group:0003", 3)], "user_id long, item_id string, rank long")
    swipes, now = swipes_of(spark, [(1, "group:0002"), (1, "group:0000"), (3, "group:0000b")]), F.lit("2026-01-01").cast("timestamp")
    positions = P.catalog_positions(items, now)
    got = P.deck(positions, users, swipes, ranked, size=4).orderBy("user_id", "place").collect()
    deck = lambda u: [r["item_id"][-5:] for r in got if r["user_id"] == u]
    assert (deck(1), deck(2), deck(3), deck(4)) == ([":0005", ":0003", ":0001", ":0004"], [":0000", ":0001", ":0002", ":0003"], ["0001b"], [])
    fan = P.preview_fan(items, positions, swipes, users, now).orderBy("user_id", "place").collect()
    fan = {u: [r["item_id"][-5:] for r in fan if r["user_id"] == u] for u in (1, 2, 3, 4)}
    assert fan == {1: [":0001", ":0003", ":0004"], 2: [":0000", ":0001", ":0002"], 3: ["0000b", "0001b"], 4: []}  # too few are left for 3: all of the feed
    assert C.order_catalog(items, now, 3).count() == 3


def test_pruned_search_equals_scoring_everything(spark):
    """Over several shards, chunks and rounds; few of queries x items are scored."""
    r = random.Random(5)
    vocabulary = [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(200)]
    rows = [(f"{k}:{i}", k, c, 1 if r.random() < 0.9 else 0, None if k == "group" else datetime(2025 + r.randrange(3), 1, 1), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 9, 30])))) for i in range(1500) for k, c in [(r.choice(["event", "group"]), r.choice("AAAB"))]]
    items = spark.createDataFrame(rows, "item_id string, item_type string, campus string, is_active int, starts_at timestamp, search_text string").repartition(4)
    profiles = spark.createDataFrame([(u, r.choice("ABC"), r.choice(vocabulary), [r.choice(vocabulary), "x"], r.choice(["", *vocabulary]), r.choice(["all", "event", "group"])) for u in range(150)], "user_id long, campus string, major string, interests array<string>, bio string, kind string")
    now, index = F.lit("2026-01-01").cast("timestamp"), R.build_index(items, shard_items=300).cache()
    assert index.filter("campus = 'A'").select("shard").distinct().count() == 4
    got = R.recommend(profiles, index, now, 7, chunk_queries=20, first=2).collect()
    post = {}
    for p in R.build_postings(items).collect():
        idf = math.log(1 + (p["n_items"] - p["df"] + 0.5) / (p["df"] + 0.5))
        post.setdefault((p["campus"], p["term"]), []).append((p["item_id"], idf * p["tf"] * 2.2 / (p["tf"] + 1.2 * (0.25 + 0.75 * p["length"] / p["avg_length"]))))
    open_ = {i: k for i, k, _, active, at, _ in rows if active and (k == "group" or at >= datetime(2026, 1, 1))}
    want = []
    for u in R.asked(profiles).collect():
        scores = collections.Counter()
        for t in set(re.findall("[a-z0-9]+", u["query"].lower())):
            for i, w in post.get((u["campus"], t), []):
                if i in open_ and u["kind"] in ("all", open_[i]):
                    scores[i] += w
        want += [(u["user_id"], i, s, k + 1) for k, (s, i) in enumerate(sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:7])]
    assert sorted((x["user_id"], x["item_id"], x["rank"]) for x in got) == sorted((u, i, k) for u, i, _, k in want)
    assert all(abs(a - b) < 1e-9 for a, b in zip([x["score"] for x in sorted(got, key=lambda x: (x["user_id"], x["rank"]))], [s for _, _, s, _ in sorted(want, key=lambda x: (x[0], x[3]))]))
    queries = R.asked(profiles).dropDuplicates(["q1", "q2"]).withColumn("need", F.lit(7))
    scored = R.best_items(queries, index, now, first=2).agg(F.sum("scored")).first()[0]
    assert scored < queries.count() * items.count() / 10


def test_whole_decks_with_kinds_and_pins(spark):
    r = random.Random(7)
    rows = [(f"{k}:{i}", k, "t", c, None if k == "group" or r.random() < 0.2 else datetime(2026, 1 + r.randrange(3), 1 + r.randrange(3), 5), r.choice([None, datetime(2025, 1 + r.randrange(3), 1)]), 1, False, "") for i in range(160) for k, c in [(r.choice(["event", "group"]), r.choice("AAAB"))]]
    items, now = spark.createDataFrame(rows, CATALOG).repartition(3), F.lit("2026-02-01").cast("timestamp")
    live = [x for x in rows if x[4] is None or x[4] >= datetime(2026, 2, 1)]
    rank = lambda x: 0 if x[1] == "event" and x[4] else 1 if x[1] == "group" else 2
    order = sorted(live, key=lambda x: (rank(x), x[4] or datetime.max, -x[5].timestamp() if x[5] else float("inf"), x[0]))
    users = [(u, r.choice("ABC"), r.choice(["all", "event", "group"]), r.choice([None, r.choice(rows)[0]])) for u in range(40)]
    swipes = [(u, i) for u in range(40) for i in {r.choice(rows)[0] for _ in range(r.choice([0, 1, 30, 400]))}]
    ranked = [(u, i, k + 1) for u in range(0, 40, 2) for k, i in enumerate(r.sample([x[0] for x in rows], 12))]
    positions = P.catalog_positions(P.live_items(items, now), now).cache()
    frames = spark.createDataFrame(users, "user_id long, campus string, kind string, pinned string"), swipes_of(spark, swipes), spark.createDataFrame(ranked, "user_id long, item_id string, rank long")
    want = {}
    for u, campus, kind, pinned in users:
        cards = [x[0] for x in order if x[3] == campus and kind in ("all", x[1]) and (u, x[0]) not in swipes]
        picks = [i for v, i, _ in ranked if v == u]
        want[u] = sorted(cards, key=lambda i: (i != pinned, picks.index(i) if i in picks else len(picks)))
    for size in (None, 5, 1):
        got = {u: [] for u, *_ in users}
        for x in sorted(P.deck(positions, *frames, size).collect(), key=lambda x: (x["user_id"], x["place"])):
            got[x["user_id"]].append(x["item_id"])
            assert x["place"] == len(got[x["user_id"]])
        assert got == {u: w[:size] for u, w in want.items()}


def test_creates_in_order(spark):
    r = random.Random(2)
    for n, keys in ((0, 3), (1, 1), (60, 8), (300, 60), (300, 4)):
        batch = [(s, r.choice([None, *map(str, range(keys))]) if r.random() < 0.1 else str(r.randrange(keys)), str(r.randrange(keys))) for s in range(n)]
        had = [("0", "u"), ("e", "1")]
        emails, names, want = {e for e, _ in had}, {u for _, u in had}, {}
        for s, e, u in batch:
            want[s] = "ERROR: email already exists" if e in emails else "ERROR: username already exists" if u in names else "SUCCESS"
            if want[s] == "SUCCESS":
                emails |= {e} - {None}
                names.add(u)
        target, rows = (spark.createDataFrame(x, c) for x, c in ((had, "email string, username string"), (batch, "seq long, email string, username string")))
        assert {x["seq"]: x["status"] for x in U.create_users(target, rows.repartition(3)).collect()} == want
    # A row that is refused takes nothing: the username of the first stays free.
    rows = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u1")], "seq long, email string, username string")
    assert [x["status"][:7] for x in U.create_users(spark.createDataFrame([("a", "x")], "email string, username string"), rows).orderBy("seq").collect()] == ["ERROR: ", "SUCCESS"]


def test_results_are_refused_as_a_whole(spark):
    good = {"request_id": 1, "rank": 1, "item_id": "group:1", "item_type": "group", "title": "T", "description": "d", "tags": "a", "campus": "A", "starts_at": None, "is_active": "1", "is_demo": "false"}
    bad = [{"title": " "}, {"item_type": "people"}, {"title": None}, {"description": "x" * 20_001}, {"tags": "x" * 1001}, {"item_id": "x" * 181}, {"item_id": ""}]
    rows = [good, good | {"rank": 2, "item_id": "group:2"}, good | {"rank": 3}] + [good | {"request_id": 2 + i} | b for i, b in enumerate(bad)] + [good | {"request_id": 2 + i, "rank": 9, "item_type": "people"} for i in range(len(bad))]
    schema = "request_id long, rank long, item_id string, item_type string, title string, description string, tags string, campus string, starts_at string, is_active string, is_demo string"
    results, now = spark.createDataFrame(rows, schema), F.lit("2026-01-01").cast("timestamp")
    errors = {r["request_id"]: r["error"] for r in P.result_errors(results).collect()}
    field, card = "Invalid search field.", "Invalid card identity."
    assert errors == {2: "Missing card title.", 3: card, 4: field, 5: field, 6: field, 7: field, 8: card}
    many = results.limit(1).withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5001).cast("long"))))
    assert P.result_errors(many).first()["error"] == "Invalid search response." and P.result_errors(many.filter("rank > 1")).count() == 0
    gone = spark.createDataFrame([(1, "snowflake:group:1")], "request_id long, excluded_id string")
    cards = lambda **k: [(r["id"], r["color"]) for r in P.decode_results(results, "A", now, **k).orderBy("color").collect()]
    assert cards() == [("snowflake:group:1", 0), ("snowflake:group:2", 1)] and cards(excluded=gone) == [("snowflake:group:2", 0)]


def test_snapshot_survives_a_restart(spark, tmp_path):
    schema = "user_id long, item_id string, ts long, seq long, action string"
    empty, source = spark.createDataFrame([], schema), f"{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        target = X.Snapshot(spark, f"file://{tmp_path}/table", empty, ["user_id", "item_id"], buckets=4)
        X.stream_decisions(spark.readStream.schema(schema).parquet(source), target, f"{tmp_path}/checkpoint")
        return target, sorted((r["user_id"], r["item_id"], r["action"]) for r in target.read().collect())

    put((1, "a", 1, 1, "pass"), (2, "b", 1, 2, "pass"))
    assert run()[1] == [(1, "a", "pass"), (2, "b", "pass")]
    target, again = run()  # nothing new: the table is opened, not emptied
    assert again == [(1, "a", "pass"), (2, "b", "pass")]
    before, reader = target.folders(), target.read()
    put((1, "a", 2, 3, "interested"), (1, "a", 0, 4, "pass"))
    target, now = run()
    assert now == [(1, "a", "interested"), (2, "b", "pass")] and reader.count() == 2  # an older version stays readable
    assert sum(target.folders()[b] != f for b, f in before.items()) == 1  # only the bucket of the key is written again
    target.merge(spark.createDataFrame([(1, "a", 2, 3, "interested")], schema), lambda old, new: X.latest_decisions(old.unionByName(new)))  # a batch that runs twice
    assert sorted((r["user_id"], r["action"]) for r in target.read().collect()) == [(1, "interested"), (2, "pass")]
    for i in range(5):
        target.replace(spark.createDataFrame([(i, "x", 1, 1, "pass")], schema))
    assert len(target.versions()) == 3 and len(list((tmp_path / "table/data").iterdir())) == 3 and target.read().first()["user_id"] == 4


def test_snapshot_gets_more_buckets_as_it_grows(spark, tmp_path):
    schema = "user_id long, item_id string, ts long, seq long, action string"
    empty = spark.createDataFrame([], schema)
    opened = lambda: X.Snapshot(spark, f"file://{tmp_path}/table", empty, ["user_id", "item_id"], buckets=2, keep=2, bucket_bytes=6000)
    add = lambda rows: opened().merge(spark.createDataFrame(rows, schema).coalesce(1), lambda old, new: X.latest_decisions(old.unionByName(new)))
    latest = lambda: {(r["user_id"], r["item_id"]): r["action"] for r in opened().read().collect()}
    want, seen = {}, []
    for b in range(4):
        rows = [(u, f"item {u * 7919 % 1000}", b, b, ("pass", "interested")[(u + b) % 2]) for u in range(300 * b, 300 * b + 600)]
        want |= {(u, i): a for u, i, _, _, a in rows}
        before = opened().read()
        n = before.count()
        add(rows)
        seen.append(opened().version()["buckets"])
        assert latest() == want and before.count() == n  # the version before stays readable
    assert seen == sorted(seen) and seen[0] == 2 and seen[-1] > 2
    now = opened().version()
    assert set(now["bytes"]) == set(now["folders"]) and all(int(b) < now["buckets"] for b in now["folders"])
    table = opened()
    table.merge(empty, lambda old, new: old)
    assert table.version() == now  # an empty batch writes nothing
    size = table._wanted(now)
    add([(10**6, "x", 9, 9, "pass")])
    if size == now["buckets"]:
        assert sum(opened().folders().get(b) != f for b, f in now["folders"].items()) <= 1
    opened().replace(empty)
    assert opened().read().count() == 0 and opened().folders() == {}


def test_undo_over_several_batches(spark, tmp_path):
    rows = [(u, t, t, f"i{t}", "undo" if (u * t) % 3 == 2 else "pass") for u in range(5) for t in range(40)]
    log = spark.createDataFrame(rows, "user_id long, ts long, seq long, item_id string, action string")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(4):
            log.filter((F.col("ts") >= 10 * i) & (F.col("ts") < 10 * i + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        put = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")
        X.stream_undo(source).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("depth", "item_id", "action"), "batch").alias("x")).select("user_id", "x.*")
    assert out.select("batch").distinct().count() == 4 and sorted(map(tuple, last.collect())) == sorted(map(tuple, X.undo_twin(log).collect()))


def test_undo_makes_few_state_calls():
    """A user costs a read and a write in a batch, however many steps; blocks below are met when the stack grows or shrinks by one."""
    from collections import Counter
    from types import SimpleNamespace

    calls = Counter()

    class Kept:
        def __init__(self, *_):
            self.d, self.v = {}, None

        def get(self):
            calls["get"] += 1
            return self.v

        def update(self, v):
            calls["update"] += 1
            self.v = v

        def containsKey(self, k):
            calls["block"] += 1
            return k in self.d

        def getValue(self, k):
            return self.d[k]

        def updateValue(self, k, v):
            calls["block"] += 1
            self.d[k] = v

        def removeKey(self, k):
            del self.d[k]

        def clear(self):
            self.d, self.v = {}, None

    stack, made = X.UndoStack(), []
    stack.init(SimpleNamespace(getValueState=lambda *a: Kept(), getMapState=lambda *a: made.append(Kept()) or made[-1]))
    want, seq = [], 0
    for batch in (["pass"] * 50, ["pass"] * 500, ["undo"] * 3 + ["pass"] * 2, ["undo"] * 300, ["undo"] * 185, ["undo"], ["pass"] * 200 + ["undo"] * 230, ["undo"] * 40, ["undo"] * 3, ["pass"]):
        rows = []
        for action in batch:
            seq += 1
            rows.append(SimpleNamespace(ts=seq, seq=seq, item_id=f"i{seq}", action=action))
            if action != "undo":
                want.append((f"i{seq}", action))
            elif want:
                want.pop()
        calls.clear()
        got = next(iter(stack.handleInputRows((7,), iter(reversed(rows)), None)))
        assert (got.user_id, got.depth, got.item_id, got.action) == (7, len(want), *(want[-1] if want else (None, None)))
        assert calls["get"] == 1 and calls["update"] <= 1 and calls["block"] <= 2 + len(batch) // X.BLOCK
    assert not made[0].d and want == [(f"i{seq}", "pass")]


def test_deep_undo_over_several_batches(spark, tmp_path):
    """Stacks of several blocks, in the real state: what batches leave below is found again when later ones undo."""
    at = lambda t: t * 7 % 11 < 4 if t < 900 else t * 7 % 11 < 9
    rows = [(u, t, t, f"i{t}", "undo" if at(t + u) else "pass") for u in range(3) for t in range(1200)]
    log = spark.createDataFrame(rows, "user_id long, ts long, seq long, item_id string, action string")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(4):
            log.filter((F.col("ts") >= 300 * i) & (F.col("ts") < 300 * i + 300)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        put = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")
        X.stream_undo(source).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key)
    out = spark.read.parquet(f"{tmp_path}/out").cache()
    for i in range(4):
        assert sorted(map(tuple, out.filter(F.col("batch") == i).drop("batch").collect())) == sorted(map(tuple, X.undo_twin(log.filter(F.col("ts") < 300 * i + 300)).collect()))
    assert out.agg(F.max("depth")).first()[0] > 2 * X.BLOCK


def test_runs_of_decisions(spark):
    """A run of decided positions gives what a row for each of its items gives, and is never made into these rows."""
    items = spark.range(9000).selectExpr("concat('event:', id) item_id", "'event' item_type", "'T' title", "'A' campus", "timestamp'2026-02-01' + make_interval(0, 0, 0, id % 40) starts_at", "1 is_active", "id % 7 = 0 is_demo", "timestamp'2026-01-01' created_at")
    now = F.lit("2026-01-01").cast("timestamp")
    positions = P.catalog_positions(P.live_items(items, now), now).cache()
    users = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A")], "user_id long, campus string")
    runs = spark.createDataFrame([(1, 3, 7714), (2, 3, 5000), (2, 4000, 6000), (2, 6002, 7000), (3, 1, 7714)], "user_id long, low long, high long")
    some = spark.createDataFrame([(2, "event:1"), (3, "event:7"), (4, "event:5000")], "user_id long, item_id string")
    each = runs.join(positions.filter("kind = 'all'"), F.col("pos").between(F.col("low"), F.col("high"))).select("user_id", "item_id").union(some).distinct()
    sort = lambda df: sorted(tuple(r) for r in df.collect())
    picks = spark.createDataFrame([(2, "event:8", 1), (2, "event:45", 2), (4, "event:90", 1)], "user_id long, item_id string, rank long")
    for size in (3, None):
        got = sort(P.deck(positions, users, some, picks, size, runs))
        assert got == sort(P.deck(positions, users, each, picks, size)) and {r[0] for r in got} == {1, 2, 4}
    assert sort(P.preview_fan(items, positions, some, users, now, runs=runs)) == sort(P.preview_fan(items, positions, each, users, now))


def test_whole_decks_are_not_shuffled(spark):
    """What a whole deck shuffles is a row for each gap and block of positions, not for each result."""
    positions = spark.range(1, 10001).selectExpr("'A' campus", "'all' kind", "concat('event:', id) item_id", "id pos")
    users = spark.range(40).selectExpr("id user_id", "'A' campus", "'all' kind", "10000L n", "0L head")
    taken = spark.range(40).selectExpr("id user_id", "explode(array(1, 4096, 4097, 9999)) low").selectExpr("user_id", "low", "low high")
    gaps = P.free_gaps(users, taken)
    assert gaps.count() == 40 * 3
    got = P.free_items(gaps, positions).cache()
    assert got.count() == 40 * 9996 and got.selectExpr("max(place)", "min(place)").first()[:] == (9996, 1)
    assert got.filter("user_id = 7 and item_id = 'event:4098'").first()["place"] == 4095
    plan = P.free_items(gaps, positions)._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan.split("Join")[0]


def test_gaps_are_shuffled_once(spark):
    """A gap over many blocks is one row where it is shuffled: blocks are found after it met its order. Nothing is lost at their ends."""
    positions = spark.range(1, 1001).selectExpr("'A' campus", "'all' kind", "concat('event:', id) item_id", "id pos")
    users = spark.range(30).selectExpr("id user_id", "'A' campus", "'all' kind", "1000L n", "0L head")
    taken = spark.range(30).selectExpr("id user_id", "id * 17 + 1 low", "id * 20 + 10 high")
    gaps = P.free_gaps(users, taken).cache()
    free = P.free_items(gaps, positions, stretch=10)
    each = gaps.withColumn("pos", F.explode(F.sequence("low", "high"))).selectExpr("user_id", "concat('event:', pos) item_id", "pos + shift place")
    assert sorted(map(tuple, free.collect())) == sorted(map(tuple, each.collect())) and each.count() > 25000
    plan = P.free_items(P.free_gaps(users, taken), positions, stretch=10)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate" in line and "low#" in line]


def test_equal_items_are_searched_as_one(spark):
    """Items of equal content have equal scores: a query looks at the contents, and the names decide among items."""
    items = catalog_of(spark, 700)
    profiles = spark.createDataFrame([(1, "A", "chess", ["x"], "")], "user_id long, campus string, major string, interests array<string>, bio string")
    now, index = F.lit("2026-01-01").cast("timestamp"), R.build_index(items, shard_items=300)
    assert [r["item_id"] for r in R.recommend(profiles, index, now).orderBy("rank").collect()] == [f"group:{i:04d}" for i in range(2, 700, 3)][:50]
    queries = R.asked(profiles).withColumn("need", F.lit(50))
    assert R.best_items(queries, index, now).first()["scored"] <= 9  # three contents in each of three shards


def test_terms_are_counted_in_the_row(spark):
    items = catalog_of(spark, 2, search_text="Chess and GO, chess").unionByName(catalog_of(spark, 1, search_text="").withColumn("item_id", F.lit("none")))
    rows = R.item_terms(items)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["item_id"]: [tuple(c) for c in r["counts"]] for r in rows.collect()} == {"none": [], **{f"group:{i:04d}": [("and", 1), ("chess", 2), ("go", 1)] for i in range(2)}}
    assert {tuple(r) for r in R.figures(rows).collect()} == {(t, 2, 3, 8 / 3) for t in ("and", "chess", "go")}
    assert R.build_index(items).count() == 3 and R.build_index(items.limit(0)).count() == 0


def test_rows_of_the_index_are_bounded(spark):
    """However many items hold a term, a row of its list has 256 of them at most, and a query still finds the best of all rows."""
    items = catalog_of(spark, 700)
    index = R.build_index(items)
    assert [r[0] for r in index.select(F.size("items").alias("n")).orderBy("n").collect()] == [188, 256, 256]
    each = index.selectExpr("inline(items)").select("item_id", "tf", "length").collect()
    assert sorted(map(tuple, each)) == [(f"group:{i:04d}", 1 + i % 3, 1 + i % 3) for i in range(700)]
    profiles = spark.createDataFrame([(1, "A", "chess", ["x"], "")], "user_id long, campus string, major string, interests array<string>, bio string")
    best = [r["item_id"] for r in R.recommend(profiles, index, F.lit("2026-01-01").cast("timestamp"), 600).orderBy("rank").collect()]
    assert best == sorted((f"group:{i:04d}" for i in range(700)), key=lambda i: (-(int(i[6:]) % 3), i))[:600]


def test_a_shard_is_written_in_small_batches(spark):
    """A shard's lists leave a task piece by piece, with every posting once."""
    schema = pa.schema([("campus", pa.string()), ("shard", pa.int32()), ("term", pa.string()), ("items", pa.list_(pa.struct([("item_id", pa.string()), ("tf", pa.int32())])))])
    counts = [[{"term": f"t{j}", "tf": j + 1} for j in range(1 + i % 7)] for i in range(100)]
    items = pa.table({"campus": ["A"] * 100, "shard": pa.array([0] * 100, pa.int32()), "item_id": [f"i{i}" for i in range(100)], "counts": counts})
    batches = list(R._lists(items, schema, block=8, rows=5))
    assert len(batches) > 10 and max(b.num_rows for b in batches) <= 5 and max(len(r["items"]) for b in batches for r in b.to_pylist()) <= 8
    got = sorted((r["term"], x["item_id"], x["tf"]) for b in batches for r in b.to_pylist() for x in r["items"])
    assert got == sorted((c["term"], f"i{i}", c["tf"]) for i in range(100) for c in counts[i])


def test_lists_that_nobody_asks_for_stay(spark):
    """Of 2,000 terms, the lists of those that a campus asks for go to the search, and hardly any others."""
    index = spark.range(2000).selectExpr("array('A', 'B')[int(id % 2)] campus", "concat('t', id) term")
    wanted = spark.range(0, 2000, 50).selectExpr("'A' campus", "concat('t', id) term")
    asked = wanted.groupBy("campus").agg(F.bitmap_construct_agg(R.term_bit("term")).alias("asked"))
    got = {tuple(r) for r in R.asked_lists(index, asked).select("campus", "term").collect()}
    assert {tuple(r) for r in wanted.collect()} <= got and len(got) < 50


def test_stream_files_follow_the_input(spark, tmp_path):
    """A larger table makes more files in each micro-batch, not larger ones; nothing is lost."""
    from tagweave.plans import queries as Q
    from tagweave.sources.adapters import Tables

    t = Tables(spark, str(tmp_path))
    spark.range(20000).selectExpr("id", "sha2(string(id), 256) text").write.parquet(f"{tmp_path}/x.parquet")
    df = t.raw("x")
    assert Q.files_of(t, df, 4) == 1 and Q.files_of(t, df, 4, 1 << 16) >= 4
    source = Q.as_stream(t, df, "x", file_bytes=1 << 16)
    source.writeStream.format("memory").queryName("followed").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("followed").selectExpr("count(distinct id)").first()[0] == 20000
