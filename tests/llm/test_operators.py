"""The operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagweave.llm import chat, common, fingerprints, media, mixing, packing, repeats, toxicity, url_filter
from tagweave.llm import queries as llm_queries
from tagweave.llm.components import connected_components
from tagweave.llm.near_dup import _parts, near_copies, near_duplicates
from tagweave.llm.substring_dedup import dedup_words
from tagweave.llm.suffix import suffix_arrays
from tagweave.llm.suffix_dedup import dedup_bytes

DOCS = "doc_id long, text string, source string, kept string, spans string"


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeated lines, nulls, empty and very long texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = text(40), text(18), text(200)
    out = [None, "", " ", "a", f"{text(70_000)} {passage} {text(60_000)} {passage}", base, base, base + " x", text(3000), "aaaa" * 100, (line + "\n") * 30]
    out += [f"{text(30)} {passage} {text(20)}" for _ in range(12)] + [f"{line}\n{text(25)}" for _ in range(150)]
    out += ["w " * 900, "w " * 700 + "x", "w " * 1000 + passage, "a b c " * 300, "b c a " * 300 + line, "zz" * 400]
    words = base.split()
    for _ in range(12):
        w = list(words)
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return [(7 * i, t, f"s{i % 3}", "k", "s") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(4)


def brute(rows, units, length, by_position):
    first, out = {}, {}
    for d, t in sorted((r[0], r[1]) for r in rows):
        u = units(t or "")
        step = np.zeros(len(u) + length + 1, int)
        for i in range(len(u) - length + 1):
            key = u[i : i + length] if isinstance(u, bytes) else tuple(u[i : i + length])
            at = first.setdefault(key, (d, i))
            if at[0] < d or by_position and at < (d, i):
                step[i : i + length] = 1
        out[d] = [x for x, gone in zip(u, step) if not gone]
    return out


@pytest.mark.parametrize("bounds", [{}, {"frequent": 2, "group_rows": 3}, {"frequent": 1, "group_rows": 1}])
def test_bytes(docs, rows, bounds):
    want = brute(rows, lambda t: t.encode(), 100, True)
    got = {r["doc_id"]: r for r in dedup_bytes(docs, **bounds).collect()}
    assert {d: bytes(r["kept"]) for d, r in got.items()} == {d: bytes(k) for d, k in want.items()}
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got.values())


@pytest.mark.parametrize("unit,length", [("bytes", 10), ("words", 4)])
def test_long_texts_are_cut_into_parts(monkeypatch, unit, length):
    """Each window is in one part, with its place in the document, whatever the words' sizes."""
    monkeypatch.setattr(repeats, "PIECE", 64)
    r = random.Random(14)
    for _ in range(40):
        texts = [" ".join("x" * r.choice([1, 2, 3, 9, 80, 300]) + str(k) for k in range(r.choice([0, 1, 3, 30, 90]))).encode() for _ in range(r.randint(1, 5))]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
        found = []
        for s, of, offset in repeats.symbol_chunks(data, bounds, unit, length):
            for k, i in enumerate(of):
                v = s.values[s.bounds[k] : s.bounds[k + 1]]
                found += [(int(i), offset + at, v[at : at + length].tobytes()) for at in range(len(v) - length + 1)]
        want = []
        for i, t in enumerate(texts):
            v = repeats.Symbols.of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), unit).values
            want += [(i, at, v[at : at + length].tobytes()) for at in range(len(v) - length + 1)]
        assert sorted(found) == want


@pytest.mark.parametrize("bounds", [{}, {"frequent": 2, "group_rows": 3}, {"frequent": 1, "group_rows": 1}])
def test_words(docs, rows, bounds):
    want = brute(rows, lambda t: t.encode().split(), 13, False)
    got = {r["doc_id"]: r["kept"] for r in dedup_words(docs, **bounds).collect()}
    assert got == {d: b" ".join(k).decode() for d, k in want.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert dedup_bytes(none).count() == dedup_words(none).count() == near_duplicates(none).count() == packing.pack(none).count() == mixing.mix(none).count() == 0
    assert fingerprints.fingerprints(none, ["doc_id"]).count() == 0


def test_suffix_arrays():
    r = np.random.default_rng(0)
    for _ in range(60):
        texts = [bytes(r.integers(1, r.integers(2, 5), r.integers(0, 25)).astype(np.uint8)) for _ in range(r.integers(1, 6))]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        found = suffix_arrays(np.frombuffer(b"".join(texts), np.uint8), bounds)
        for i, t in enumerate(texts):
            assert (found[bounds[i] : bounds[i + 1]] - bounds[i]).tolist() == sorted(range(len(t)), key=lambda j: t[j:])


@pytest.mark.parametrize("blocks", [{}, {"block_texts": 3}])
def test_near_duplicates(docs, rows, blocks):
    def shingles(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    def jp(a, b):
        keys = list(set(a) | set(b))
        x, y = (np.array([c.get(k, 0) for k in keys]) / sum(c.values()) for c in (a, b))
        return sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in np.flatnonzero((x > 0) & (y > 0)))

    sets = {r[0]: shingles(r[1]) for r in rows}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            alike = rows[a // 7][1] == rows[b // 7][1] or (set(sets[a]) & set(sets[b]) and jp(sets[a], sets[b]) >= 0.8) or not (rows[a // 7][1] or rows[b // 7][1])
            if alike:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, **blocks).collect()}
    assert got == {d: root(d) for d in ids}


def test_near_duplicate_recall_by_similarity(spark):
    """Pairs of a known Jaccard similarity, all texts apart from their pair having nothing in common."""
    r = random.Random(8)
    rows, true = [], {}
    for i in range(600):
        words = [f"{i}x{k}" for k in range(r.randint(120, 300))]
        other = list(words)
        for k in range(r.choice([1, 2, 3, 4, 5, 6])):
            other[r.randrange(len(words))] = f"{i}y{k}"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        true[2 * i + 1] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {d for d, c in got.items() if c != d}
    assert linked <= {d for d, s in true.items() if s >= 0.8}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        of = [d for d, s in true.items() if low <= s < high]
        assert len(of) > 50 and sum(d in linked for d in of) >= 0.98 * len(of)


def test_near_duplicates_of_a_large_linked_family(spark):
    """Copies of one text in many blocks, some linked to the others through a third only, rows and null ids repeated."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows, texts = [], {}
    for i in range(300):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(200)] = f"e{r.randrange(10**6)}"
        texts[i] = w
        rows += [(i, " ".join(w))] * r.choice([1, 1, 3])
    sets = {i: {tuple(w[k : k + 5]) for k in range(196)} for i, w in texts.items()}
    label = {i: i for i in texts}
    for _ in range(20):
        for i in texts:
            for j in range(i):
                if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    label[i] = label[j] = min(label[i], label[j])
    got = near_duplicates(spark.createDataFrame([*rows, (None, "x"), (None, "x")], "doc_id long, text string").repartition(5), block_texts=40).collect()
    assert len(got) == len(texts) and {x["doc_id"]: x["class_id"] for x in got} == label


def root(up: dict, x: int) -> int:
    while up[x] != x:
        x = up[x]
    return x


def test_near_copies_return_verified_pairs(spark):
    """The pairs connect exactly the classes, and their similarity is that of the texts; settled texts count as known."""
    r = random.Random(10)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(160):
        w = list(base) if i % 4 else [f"t{i // 40}_{k}" for k in range(60)]
        for _ in range(r.choice([0, 1, 2, 4, 7])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts[i] = w
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    for size in (1024, 30):
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
        classes, links = near_copies(df, block_texts=size)
        rows = classes.collect()
        label, text_id = ({x["doc_id"]: x[c] for x in rows} for c in ("class_id", "text_id"))
        up = {i: i for i in texts}
        for x in links.collect():
            a, b = sets[x["a"]], sets[x["b"]]
            assert x["a"] != x["b"] and abs(len(a & b) / len(a | b) - x["similarity"]) < 1e-9 and x["similarity"] >= 0.8 - 1e-9
            a, b = root(up, x["a"]), root(up, x["b"])
            up[max(a, b)] = min(a, b)
        for i in texts:
            assert label[i] == root(up, text_id[i]) and texts[text_id[i]] == texts[i]
        for x in near_duplicates(df, block_texts=size).collect():
            if x["near_id"] is None:
                assert x["similarity"] is None and sum(label[i] == x["class_id"] and texts[i] != texts[x["doc_id"]] for i in texts) == 0
            else:
                assert label[x["near_id"]] == x["class_id"] and x["near_id"] != x["text_id"] and x["similarity"] >= 0.8 - 1e-9


def test_parts_of_a_family_grow_with_its_texts(spark):
    """Texts with half of their words from one template are not alike: at most one in fifty reaches the comparison, at both sizes."""
    r = random.Random(11)
    base = " ".join(f"b{k}" for k in range(60))
    for n in (300, 1200):
        rows = [(i, 0, 0, base + " " + " ".join(f"u{r.randrange(10**7)}" for _ in range(60))) for i in range(n)]
        assert _parts(spark.createDataFrame(rows, "id long, group long, settled int, text string"), 5, 0.8).count() <= n // 50


def test_parts_keep_all_links(spark):
    """Repeated words, any similarity: two linked texts, one of them unsettled, are in one part; groups stay apart."""
    r = random.Random(12)
    rows, sets = [], {}
    for i in range(240):
        w = [f"{i % 6}v{k % 45}" for k in range(90)]
        for _ in range(r.randrange(12)):
            w[r.randrange(90)] = f"x{r.randrange(30)}"
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(86))
        rows.append((i, i % 6 // 3, int(i % 5 == 0), " ".join(w)))
    part = {x["id"]: x["part"] for x in _parts(spark.createDataFrame(rows, "id long, group long, settled int, text string").repartition(4), 5, 0.8).collect()}
    linked = 0
    for i in range(240):
        for j in range(i):
            if rows[i][1] == rows[j][1] and not (rows[i][2] and rows[j][2]):
                keys = sorted(set(sets[i]) | set(sets[j]))
                x, y = (np.array([c[k] for k in keys]) / 86 for c in (sets[i], sets[j]))
                if sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in np.flatnonzero((x > 0) & (y > 0))) >= 0.8:
                    linked += 1
                    assert part[i] == part[j]
    assert linked > 100 and len({p for p in part.values()}) > 1


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["id"]: x["label"] for x in connected_components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert got == {d: label[d] for d in got} and len(got) == len({d for e in edges if e[0] != e[1] for d in e})


def test_fingerprints(spark):
    r = random.Random(1)
    rows, true = [], []
    for i in range(150):
        v = [f"w{r.randrange(10**6)}" for _ in range(r.choice([3, 30, 300]))]
        a, b = ([w for w in v for _ in range(r.choice([0, 1, 1, 2, 5]))] or ["x"] for _ in range(2))
        ca, cb = collections.Counter(a), collections.Counter(b)
        keys = set(ca) | set(cb)
        true.append(sum(min(ca[k], cb[k]) for k in keys) / sum(max(ca[k], cb[k]) for k in keys))
        rows += [(i, 0, " ".join(a)), (i, 1, " ".join(b))]
    f = fingerprints.fingerprints(spark.createDataFrame(rows + [(-1, 0, None), (-1, 1, " ")], "i long, p int, text string"), ["i", "p"])
    side = lambda p: F.max(F.when(F.col("p") == p, F.col("samples")))
    got = {r["i"]: r["s"] for r in f.groupBy("i").agg(side(0).alias("a"), side(1).alias("b")).select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    error = np.array([got[i] - t for i, t in enumerate(true)])
    assert got[-1] == 1.0 and abs(error.mean()) < 0.015 and error.std() < 0.075


def test_fingerprint_query_against_exact_similarity(spark, rows, tmp_path):
    """The whole query: successors, edits and hashes exactly, likeness against the generalised Jaccard similarity."""
    table = [(i, t, "s") for i, t, *_ in rows] + [(-5, "ä" * 9 + " b", "s"), (10**12, "last one here", "s")]
    spark.createDataFrame(table, "doc_id long, text string, clash string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in llm_queries.op1_fingerprints(spark, str(tmp_path)).collect()}
    text = {i: t or "" for i, t, _ in table}
    ids = sorted(text)
    bag = lambda t: collections.Counter(t.lower().split())
    error = []
    for k, i in enumerate(ids):
        t, after = text[i], text[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) or bag(t) != bag(edited)
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = bag(t), bag(other)
            error.append(got[i][name] - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    # The texts share their words, so the errors go together; texts of their own words are in test_fingerprints.
    assert len(got) == len(ids) and np.sqrt(np.mean(np.square(error))) < 0.09


def test_fingerprint_query_on_repeated_rows_and_small_tables(spark, tmp_path):
    """Each row with an id is a document; the only one is its own next; extra columns with clashing names are ignored."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b x y", "x"), (2, None, "x"), (3, "a b c d", "x"), (None, "a b", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, at string")
    for name, part in (("many", table), ("one", table.filter("doc_id = 3")), ("none", table.limit(0))):
        part.coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
    run = lambda name: llm_queries.op1_fingerprints(spark, str(tmp_path / name)).collect()
    many = run("many")
    assert sorted(r["doc_id"] for r in many) == [1, 1, 2, 2, 3]
    edited = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    texts = [t or "" for d, t, _ in rows if d]
    want = sorted((d, len(t), edited(t, after)) for (d, _, _), t, after in zip(rows, texts, texts[1:] + texts[:1]))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in many) == want
    assert len({r["fingerprint"] for r in many if r["n_chars"] == 7 and r["doc_id"] != 2}) == 1
    assert sorted(r["near_next"] for r in many if r["doc_id"] in (1, 3))[-2:] == [1.0, 1.0]
    assert [(r["doc_id"], r["near_next"]) for r in run("one")] == [(3, 1.0)] and run("none") == []


def test_fingerprint_query_deals_texts_once(spark, tmp_path):
    """Where nothing is broadcast, texts, places and beginnings are dealt once each, and samples are made where the texts are."""
    rows = spark.createDataFrame([(i, f"a b c {i} " * 9) for i in range(50)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = llm_queries.rows_with_places(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    after = llm_queries.materialize(llm_queries.successors(docs), "next")
    put = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        plan = llm_queries.sampled(docs, after)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("- Exchange hashpartitioning") == 3 and plan.count("- ReusedExchange") == 1


def test_packing(spark, docs):
    lengths = np.array([1, 2, 3, 10, 11, 12, 50])
    counts = np.array([5, 1, 1, 4, 1, 1, 2])
    import itertools

    cost = lambda bounds: sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))
    for k in (1, 2, 3):
        best = min(cost([*x, 50]) for x in itertools.combinations(lengths[:-1].tolist(), k - 1))
        assert cost(packing.optimal_bounds(lengths, counts, k)) == best
    got = packing.pack(docs, token_budget=2000, buckets=4).toPandas()
    assert sorted(got.doc_id) == sorted(r["doc_id"] for r in docs.collect()) and (got.padding >= 0).all()
    batches = got.groupby(["bucket", "shard", "batch"]).agg(n=("doc_id", "size"), length=("bucket_length", "max"))
    assert ((batches.n == 1) | (batches.n * batches.length <= 2000)).all()


def test_packing_with_one_very_long_document(spark):
    import itertools

    r = random.Random(4)
    padded = lambda of, bounds: sum(min(b for b in bounds if b >= n) for n in of)
    for _ in range(40):
        of = [r.randint(1, 40) for _ in range(30)] + [r.choice([40, 10**6])]
        lengths, counts = np.unique(of, return_counts=True)
        for k in (1, 2, 3):
            best = min(padded(of, [*x, max(of)]) for m in range(k) for x in itertools.combinations(lengths[:-1].tolist(), m))
            assert padded(of, packing.optimal_bounds(lengths, counts, k)) == best
    of = [1, 1, 2, 3, 10, 11, 11, 12, 50, 51, 10**6]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([0, None, *of])], "doc_id long, n long")
    got = packing.pack(rows, length=F.col("n"), buckets=4).toPandas()
    best = min(padded([1, 1, *of], [*x, 10**6]) for x in itertools.combinations(sorted(set(of))[:-1], 3))
    assert got.bucket_length.sum() == best
    assert (got[got.n_tokens == 0].bucket == 0).all() and set(got.bucket_length) <= set(of)


def test_mixing(docs):
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    exponent, weights, epochs = mixing.solve(tokens, max_repeats=2.0)
    assert 0 < exponent < 1 and abs(max(epochs.values()) - 2) < 1e-6 and min(epochs.values()) > 1 - 1e-9
    assert abs(mixing.entropy(mixing.solve(tokens, target_entropy=0.8)[1]) - 0.8) < 1e-6
    got = mixing.mix(docs, max_repeats=2.0).toPandas()
    assert set(got.doc_id) == {r["doc_id"] for r in docs.collect()} and got.groupby("doc_id").size().max() <= 2
    assert not got.duplicated(["doc_id", "epoch"]).any()


@pytest.fixture(scope="module")
def sources(spark):
    r = random.Random(10)
    size = {"a": 6000, "b": 900, "c": 300, None: 60, "none": 5}
    rows = [(i, s, 0 if s == "none" else r.randint(1, 40), "x", 1.0) for s, n in size.items() for i in range(n)]
    rows = [(k, *x[1:]) for k, x in enumerate(rows)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "b", 3, "x", 1.0), (None, "b", 4, "x", 1.0)], "doc_id long, source string, n long, epoch string, mix_key double").repartition(5)


@pytest.mark.parametrize("of", [{}, {"max_sources": 2}])
def test_mixture_meets_its_weights(spark, sources, of):
    """Between equal shares and those as they are; realised shares, whole epochs, and blocks that are read one after another."""
    tokens = {r["s"]: r["n"] for r in sources.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("n").alias("n")).collect()}
    exponent, weights, epochs = mixing.solve(tokens, max_repeats=3.0, target_gain=0.3)
    assert 0 < exponent < 1 and max(epochs.values()) <= 3 + 1e-9
    got = mixing.mix(sources, length=F.col("n"), max_repeats=3.0, target_gain=0.3, block_rows=64, **of).toPandas()
    total = got.n_tokens.sum()
    for s, of_source in got.groupby("source"):
        assert abs(of_source.weight.iloc[0] - weights[s]) < 1e-9
        assert abs(of_source.n_tokens.sum() - epochs[s] * tokens[s]) <= 20.5  # half of the longest document
        assert abs(of_source.n_tokens.sum() / total - weights[s]) < 0.002
        rows = sources.filter(F.coalesce("source", F.lit("")) == s).count()
        whole = of_source[of_source.epoch < int(epochs[s] + 1e-9)]
        assert (whole.groupby("epoch").size() == rows).all()
        for _, read in of_source.sort_values(["mix_key", "doc_id"]).groupby("epoch"):
            assert (read.block != read.block.shift()).sum() == read.block.nunique()
        if of_source.epoch.max() and of_source.block.nunique() > 8:
            orders = [tuple(x.sort_values("mix_key").block.drop_duplicates()) for _, x in of_source.groupby("epoch") if len(x) == rows]
            assert len(set(orders)) == len(orders)
    # In any stretch of the mixture, the sources stand in proportion.
    half = got.sort_values(["mix_key", "doc_id"]).iloc[: len(got) // 2]
    assert all(abs(half[half.source == s].n_tokens.sum() / half.n_tokens.sum() - w) < 0.03 for s, w in weights.items())


def test_mixture_by_budget_and_entropy(spark, sources):
    tokens = {"a": 900, "b": 90, "c": 10, "d": 0}
    frame = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    for k in ({"target_entropy": 0.8}, {"target_gain": 0.5}, {"max_repeats": 1.5}, {"max_repeats": 4.0, "budget": 2000.0}, {}):
        a = mixing.solve_exponent(mixing.Moments(tokens), **k)
        assert abs(a - mixing.solve_exponent(mixing.Moments(frame), **k)) < 1e-6
    got = mixing.mix(sources, length=F.col("n"), budget=5000.0, max_repeats=None).toPandas()
    assert abs(got.n_tokens.sum() - 5000) < 100


def test_batches_of_the_packing_query(spark, tmp_path):
    """Lengths, buckets and batches recomputed from the table."""
    r = random.Random(13)
    rows = [(i, " ".join(["w"] * n) if n else r.choice([None, "", " \n"]), "k") for i, n in enumerate([r.choice([0, 1, 5, 40, 300, r.randint(1, 900)]) for _ in range(900)] + [70_000, 70_001])]
    spark.createDataFrame([*rows, rows[3], (None, "a b", "k")], "doc_id long, text string, batch string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm_queries.op2_packing(spark, str(tmp_path)).toPandas()
    words = {i: len((t or "").split()) for i, t, _ in rows} | {None: 2}
    assert len(got) == len(rows) + 2 and all(words[None if i != i else int(i)] == n for i, n in zip(got.doc_id, got.n_tokens))
    bounds = packing.optimal_bounds(*np.unique(np.maximum(got.n_tokens, 1), return_counts=True), 8)
    assert got.bucket_length.tolist() == [bounds[b] for b in got.bucket] == [min(x for x in bounds if x >= n) for n in got.n_tokens]
    for (b, _, _), batch in got.groupby(["bucket", "shard", "batch"]):
        assert sorted(batch.position) == list(range(len(batch))) and len(batch) <= max(1, 65_536 // bounds[b])
    short = got.groupby(["bucket", "shard", "batch"]).size().reset_index(name="n")
    last = short.groupby(["bucket", "shard"]).batch.transform("max")
    assert all(n == max(1, 65_536 // bounds[b]) for b, n in short[short.batch < last][["bucket", "n"]].itertuples(index=False))
    kept = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), keep=("text",)).collect()
    assert collections.Counter((x["doc_id"], x["text"]) for x in kept) == collections.Counter([(i, t) for i, t, _ in [*rows, rows[3]]] + [(None, "a b")])


def test_pipeline_with_repeated_rows_and_null_ids(spark, tmp_path):
    r = random.Random(6)
    sizes = iter(range(30, 1000))
    text = lambda n: " ".join("".join(r.choices("abceghjkmnpqrsvwxz", k=9)) for _ in range(n))
    passage = text(60)
    rows = [(i, text(next(sizes))) for i in range(200)]
    rows += [(i, text(next(sizes)) + " you idiot fool") for i in range(200, 240)]
    rows += [(300, text(next(sizes)))] * 4 + [(None, text(next(sizes)))] * 3 + [(None, text(next(sizes))) for _ in range(5)]
    rows += [(301, text(next(sizes))) for _ in range(6)] + [(301, text(next(sizes)) + " you idiot fool"), (None, text(next(sizes)) + " you idiot fool")]
    rows += [(302, passage + " " + text(next(sizes))), (303, text(next(sizes)) + " " + passage), (303, text(next(sizes))), (None, passage + " " + text(next(sizes)))]
    r.shuffle(rows)
    want, first, seen = [], set(), set()
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        if "idiot" in t or t in first:
            continue
        first.add(t)
        words = t.split()
        windows = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        gone = {k + j for k, w in enumerate(windows) if w in seen for j in range(50)}
        seen |= set(windows)
        want.append((i, len(words) - len(gone)))
    table = spark.createDataFrame([(i, t, "en", "one", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows if i is not None and i < 240 and i % 2], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((x["doc_id"], x["n_tokens"]) for x in got) == collections.Counter(want)  # one source is read once
    two = table.withColumn("source", F.when(F.col("doc_id") < 150, "a").otherwise("b"))
    texts = collections.Counter(t for _, t in rows)
    read = collections.Counter(x["text"] for x in corpus_pipeline.mix_sources(spark, two, "").collect())
    assert set(read) == set(texts) and all(texts[t] <= n <= 2 * texts[t] for t, n in read.items())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, "", "en", "a", 0), (1, " ", None, None, None), (2, "x y", "en", "a", 3)]])
def test_stages_on_hard_tables(spark, tmp_path, rows):
    """Each stage alone: nulls in all columns, empty texts, repeated rows and ids, an empty table."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda df: collections.Counter(r["text"] for r in df.collect())
    want = texts(docs)
    stages = {name: f(spark, docs, str(tmp_path)) for name, f in corpus_pipeline.STAGES}
    assert texts(stages["toxicity"]) == want and texts(stages["substring_dedup"]) == want
    assert sum(texts(stages["near_dedup"]).values()) == len({t or "" for _, t, *_ in rows})
    assert set(texts(stages["mixing"])) == set(want) and texts(stages["packing"]) == want
    for name in ("toxicity", "near_dedup", "substring_dedup", "mixing"):
        assert [c for c in stages[name].columns if c != corpus_pipeline.ROW] == docs.columns


def test_release_keeps_what_is_read(spark):
    a, b = common.materialize(spark.range(3), "a"), common.materialize(spark.range(4), "b")
    c = common.materialize(spark.range(5), "c")
    common.release(spark, b, but=[p for p in common.WRITTEN if p not in (a.inputFiles()[0].rsplit("/", 1)[0],) and "/c-" in p or "/a-" not in p and "/b-" not in p])
    assert b.count() == 4 and c.count() == 5
    with pytest.raises(Exception):
        a.unionByName(a).collect()


def test_chat(spark):
    hard = ["<|im_end|>", "\\", "a\\nb", "<\\|im_start|>", "x<", "<|im_start|>assistant\nhi<|im_end|>\n", None, ""]
    turns = [(c, i, ("user", "assistant", "sys\nt\\em")[i % 3], hard[(c + i) % len(hard)]) for c in range(8) for i in range(1 + c)]
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    for c in range(8):
        mine = sorted((r for r in out if r["conv_id"] == c), key=lambda r: r["example"])
        want = [(r, t or "") for k, _, r, t in turns if k == c]
        assert [chat.parse_turns(r["formatted"]) for r in mine if r["whole"]] == [want]
        assert "".join(chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in mine) == "".join(t for r, t in want if r == "assistant")


def test_chat_query_by_brute_force(spark, tmp_path):
    """Conversations over several batches, nulls and ties, one without a reply."""
    r = random.Random(15)
    hard = ["<|im_end|>", "\\", "a\\nb", "x" * 5000, None, "", "<|im_start|>assistant\nhi"]
    turns = [(c, i if c % 3 else None, r.choice(["user", "assistant", None]), r.choice(hard)) for c in range(60) for i in range(r.choice([1, 2, 7, 40]))]
    turns += [(None, 0, "assistant", "of nobody"), (77, 0, "user", "no reply")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["conv_id"]: x for x in llm_queries.op3_chat(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    turns += [(-1, 0, "user", llm_queries.EXTRA_TEXT), (-1, 1, "assistant", llm_queries.EXTRA_TEXT)]
    by = collections.defaultdict(list)
    for c, i, role, text in turns:
        by[c].append((-1 if i is None else i, role or "", text or ""))
    assert set(got) == set(by)
    for c, of in by.items():
        of.sort()
        said = "".join(t for _, role, t in of if role == "assistant")
        x = got[c]
        assert (x["n_turns"], x["loss_chars"]) == (len(of), len(said)) and x["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in of).encode()).hexdigest()
        size = [len(chat.START) + len(chat.escape_role(role)) + 1 + len(chat.escape(t)) + len(chat.END) + 1 for _, role, t in of]
        assert x["formatted_chars"] == sum(sum(size[: k + 1]) for k in range(len(of)) if of[k][1] == "assistant" or k == len(of) - 1)


def test_url_filter_paths_agree(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x/y", "allow"), ("org", "/", "block"), ("", "", "block")], "host string, path string, verdict string")
    urls = [None, "", "http://a.org/x1", "http://B.A.org/x/yz?q", "https://a.org", "x://c.org/#f", "http://aorg/", "http://a.org/w", "http://a.org/x1", "x://" + "y." * 3000 + "org/" + "p/" * 3000]
    pages = spark.createDataFrame([(i, u, "r", "h", "p", "v", "l", "n") for i, u in enumerate(urls)], "page_id long, url string, r string, h string, p string, host string, lengths string, n string").repartition(4)
    a, b = (url_filter.filter_urls(pages, rules, max_broadcast_rules=n) for n in (100, 1))
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (sorted(map(tuple, x.select("page_id", "host", "path", "rule", "verdict", "r", "n").collect())) for x in (a, b))
    assert a == b and a[2][3] == "a.org/x" and a[3][3] == "a.org/x/y" and a[7][4] == "block" and a[8][1:] == a[2][1:]
    for n in (100, 1):
        assert url_filter.filter_urls(pages.limit(0), rules, max_broadcast_rules=n).count() == 0
    assert {x["verdict"] for x in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_media(spark, docs, tmp_path):
    path = f"file://{tmp_path}/media"
    media.write_archives(media.encode_texts(docs), path)
    got = media.decode_media(media.read_archives(spark, path, rangeBytes=4096)).collect()
    assert {r["name"]: bytes(r["samples"])[: r["n_bytes"]].decode() for r in got} == {f"{r['doc_id']}.png": r["text"] or "" for r in docs.collect()}
    assert all(len(r["samples"]) % 64 == 0 and len(r["samples"]) and r["error"] is None for r in got)
    archive = next((tmp_path / "media").glob("*.tar"))
    archive.write_bytes(archive.read_bytes()[:600])  # what is left of it must not stop the others
    again = media.decode_media(media.read_archives(spark, path)).collect()
    assert any(r["error"] for r in again)


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(2)
    clean = [" ".join(r.choice(["river", "stone", "walk", "blue", "house", "tree", f"w{r.randrange(400)}"]) for _ in range(30)) for _ in range(600)]
    return [(i, t + (" You IDIOT, fool" if i % 5 == 0 else ""), int(i % 5 == 0)) for i, t in enumerate(clean)] + [(1000, None, 0), (1001, "", 0)]


def test_media_query_by_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in llm_queries.op10_media(spark, str(tmp_path)).collect()}
    by_text = collections.defaultdict(set)
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (64 - len(data) % 64 if len(data) % 64 or not data else 0)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["error"] is None
        png, n = media.encode_png(data)[0], len(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and media.decode_png(png) == (padded, n)
        by_text[data].add((r["media_sha256"], r["feature"]))
    assert len(got) == len(rows) and all(len(x) == 1 for x in by_text.values())


def test_media_members_are_read_again_by_offset(spark, docs, tmp_path, monkeypatch):
    """A store that fails now and then: members that succeed in the end are whole, one that never does has an error, the rest is read."""
    path = f"file://{tmp_path}/media"
    media.write_archives(media.encode_texts(docs), path)
    want = {(r["name"], r["offset"]): bytes(r["payload"]) for r in media.read_archives(spark, path).collect()}
    real, tries = media.file_system, collections.Counter()
    broken = sorted(want)[3]

    class Flaky:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def open_input_file(self, name):
            f = self.store.open_input_file(name)

            class File:
                def read_at(self, size, offset):
                    tries[offset, name] += 1
                    if offset == broken[1] or offset % 3 == 0 and tries[offset, name] < 3:
                        raise OSError("lost")
                    return f.read_at(size, offset)

            return File()

    monkeypatch.setattr(media, "file_system", lambda p: (Flaky(real(p)[0]), real(p)[1]))
    reader = media.ArchiveReader({"path": path, "rangeBytes": "8192"})
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert {(r["name"], r["offset"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        if r["offset"] == broken[1]:
            assert r["payload"] is None and "lost" in r["error"]
        else:
            assert r["payload"] == want[r["name"], r["offset"]] and r["error"] is None
    assert max(tries.values()) == 3


CLASH = ["id", "key", "doc", "loc", "ext", "f", "kept", "spans", "wanted", "symbols", "kind", "n", "band", "bands", "group", "label", "side", "known", "size", "text_id", "class_id", "samples", "fingerprint", "part", "score", "predicted", "bucket", "batch", "dealt", "epoch", "block", "rank", "mix_key", "host", "path", "rule", "verdict", "name", "payload", "turns", "t", "example", "conv", "digest"]


@pytest.fixture(scope="module", params=["rows", "none"])
def hard(spark, request):
    """Nulls, empty texts, ties, repeated rows and ids, a long text, and columns named as the operators name theirs; or no rows."""
    long_ = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "a b c", None), (None, None, None), (None, None, None), (3, "", "s"), (4, " \n", "t"), (5, long_, "s"), (6, long_ + " x", "s"), (None, "q", "s")]
    df = spark.createDataFrame(rows if request.param == "rows" else [], "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH}), rows if request.param == "rows" else []


def test_hard_tables(spark, hard):
    docs, rows = hard
    ids = sorted({i for i, *_ in rows if i is not None})
    known = [i for i, *_ in rows if i is not None]
    col = lambda df, c: sorted((r[c] for r in df.collect()), key=lambda x: (x is None, x))
    everything = sorted((i for i, *_ in rows), key=lambda x: (x is None, x))
    one = fingerprints.fingerprints(docs, ["doc_id"])
    assert col(one, "doc_id") == sorted(set(everything), key=lambda x: (x is None, x))
    assert col(packing.pack(docs), "doc_id") == everything
    assert set(col(mixing.mix(docs), "doc_id")) == set(everything)
    assert col(dedup_bytes(docs), "doc_id") == sorted(known) and col(dedup_words(docs), "doc_id") == sorted(known)
    near = near_duplicates(docs)
    assert col(near, "doc_id") == ids
    classes = {r["doc_id"]: r["class_id"] for r in near.collect()}
    assert classes == ({1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5} if rows else {})
    toxic = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert col(toxicity.score(docs, toxicity.fit(docs, toxic)), "doc_id") == everything
    turns = docs.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(None).cast("int"), "role": F.when(F.col("source") == "s", "assistant")})
    made = chat.format_conversations(turns).collect()
    whole = {r["conv_id"]: chat.parse_turns(r["formatted"]) for r in made if r["whole"]}
    want = collections.defaultdict(list)
    for i, t, x in rows:
        want[i].append(("assistant" if x == "s" else "", t or ""))
    assert {i: sorted(x) for i, x in whole.items()} == {i: sorted(x) for i, x in want.items()}
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    judged = url_filter.filter_urls(docs.withColumn("url", F.concat(F.lit("x://a.org/"), "text")), rules)
    assert judged.count() == len(rows) and judged.filter("verdict = 'block'").count() == sum(t is not None for _, t, _ in rows)
    assert media.encode_texts(docs).count() == len(rows)


def test_toxicity_held_out(spark, labelled):
    docs = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs, docs.filter("doc_id % 2 = 0").select("doc_id", "toxic"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, index).collect()}
    assert all(got[i]["predicted"] == y for i, _, y in labelled)
    assert all(got[i]["neighbours"] and i not in got[i]["neighbours"] for i, t, _ in labelled if t)


def test_toxicity_neighbours_by_brute_force(spark, labelled):
    """The cosine of all examples, all ties with the k-th included, equal texts left out; skipping blocks changes nothing."""
    rows = [*labelled, (2000, "river house", 0), (2001, "river house", 1), (2002, "house river", 0), (2003, "zzz unknown", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs, docs.select("doc_id", "toxic"), k=7, block=8)
    counts = {i: collections.Counter((t or "").lower().replace(",", " ").split()) for i, t, _ in rows}
    words = sorted({w for c in counts.values() for w in c})
    n, pos = len(rows), sum(y for *_, y in rows)
    has = {w: [i for i, c in counts.items() if w in c] for w in words}
    toxic = {i: y for i, _, y in rows}
    factor = {}
    for w in words:
        m, both = len(has[w]), sum(toxic[i] for i in has[w])
        phi = abs(n * both - pos * m) / max(pos * (n - pos) * m * (n - m), 1e-9) ** 0.5
        factor[w] = np.log(1 + (1 + n) / (1 + m)) * (toxicity.FLOOR + max(0, phi - toxicity.CHANCE / n**0.5))
    vector = {i: np.array([(1 + np.log(c[w])) * factor[w] if w in c else 0.0 for w in words]) for i, c in counts.items()}
    vector = {i: v / (np.linalg.norm(v) or 1) for i, v in vector.items()}
    text = {i: t or "" for i, t, _ in rows}
    for x in toxicity.score(docs, index).collect():
        i = x["doc_id"]
        cos = {j: round(float(vector[i] @ vector[j]), 5) for j in vector if text[j] != text[i]}
        want = sorted((c for c in cos.values() if c > 0), reverse=True)[:7]
        assert np.allclose(x["similarity"][:7], want, atol=2e-5)
        assert all(abs(cos[j] - s) < 2e-5 for j, s in zip(x["neighbours"], x["similarity"]))
        if len(want) == 7:
            assert {j for j, c in cos.items() if c > want[-1] + 3e-5} <= set(x["neighbours"]) and all(s >= x["similarity"][6] for s in x["similarity"])


def test_toxicity_scores_are_rates(spark):
    """A noisy sign of toxicity: in each range of scores, about that share of held-out texts is toxic."""
    r = random.Random(12)
    rows = []
    for i in range(3000):
        k = r.choice([0, 0, 1, 2])
        rows.append((i, " ".join([f"w{r.randrange(300)}" for _ in range(20)] + [f"sign{k}"]), int(r.random() < (0.05, 0.4, 0.9)[k])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs, docs.filter("doc_id % 3 > 0"))
    got = [(x["score"], rows[x["doc_id"]][2]) for x in toxicity.score(docs, index).collect() if x["doc_id"] % 3 == 0]
    for low, high in ((0, 0.2), (0.2, 0.65), (0.65, 1.01)):
        of = [(s, y) for s, y in got if low <= s < high]
        assert len(of) > 100 and abs(np.mean([s for s, _ in of]) - np.mean([y for _, y in of])) < 0.1


def test_toxicity_without_labels_or_documents(spark, labelled):
    docs = spark.createDataFrame([(*x, 1, 2) for x in [*labelled[:5], labelled[0], (None, "x", 1)]], "doc_id long, text string, toxic int, score int, id int")
    none = toxicity.fit(docs, docs.select("doc_id", "toxic").limit(0))
    assert [(x["score"], x["predicted"]) for x in toxicity.score(docs, none).collect()] == [(0.0, 0)] * 7
    index = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    assert toxicity.score(docs.limit(0), index).count() == 0 and toxicity.score(docs, index).count() == 7
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic"))).count() == 7


def test_hashes_agree_with_text():
    assert hashlib.sha256(chat.unescape(chat.escape("a<|b\\|")).encode()).hexdigest() == hashlib.sha256(b"a<|b\\|").hexdigest()
