"""MinHash near-dedup by ProbMinHash, banding and verification (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import materialize, partitions, text_of, whole_groups
from tagweave.llm.components import connected_components

#: Bytes of text worked on at once.
PIECE = 1 << 19
#: Texts, and bytes of text, that make a block of a group of candidates.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 1 << 22
#: Pairs of texts, and shingles that two texts share, worked on at once.
SLOTS, SHARED = 1 << 20, 1 << 22
#: Pairs whose exact similarity is computed at once.
VERIFIED = 256
#: Cells of the counts that put shingles in order, the same at any size.
CELLS = 1 << 20


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count), sorted by document and shingle. Fewer words than a shingle make one shingle."""
    starts, ends, wb = R.words(data, bounds)
    values = R.word_hashes(data, starts, ends)
    pre = R.prefix(values)
    size = np.diff(wb)
    grams = R.gram_hash(pre, words)
    doc = np.repeat(np.arange(len(size)), size)[: len(grams)]
    inside = np.arange(len(grams)) + words <= wb[1:][doc]
    short = np.flatnonzero((size > 0) & (size < words))
    doc = np.concatenate((doc[inside], short))
    grams = np.concatenate((grams[inside], R.span_hash(pre, wb[short], wb[short + 1])))
    by = np.lexsort((grams, doc))
    doc, grams = doc[by], grams[by]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    heads = np.flatnonzero(head)
    return doc[heads], grams[heads], np.diff(np.append(heads, len(doc)))


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures (n_docs x registers) of weighted elements.

    Each element is a Poisson process with its weight as rate; every arrival goes to a random
    register, which keeps its earliest arrival's element. An element is done as soon as its
    next arrival is later than the latest register of its document.
    """
    least = np.full(n_docs * registers, np.inf)
    names = np.zeros(n_docs * registers, np.uint64)
    limit = np.full(n_docs, np.inf)
    time = np.zeros(len(doc))
    state = element
    step = np.uint64(0xD1342543DE82EF95)
    while len(doc):
        state = state + step
        x = R.mix(state)
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = time < limit[doc]
        doc, element, weight, time, state, x = doc[alive], element[alive], weight[alive], time[alive], state[alive], x[alive]
        if not len(doc):
            break
        slot = doc * registers + (R.mix(x ^ step) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(time < least[slot])
        by = better[np.lexsort((time[better], slot[better]))]
        s = slot[by]
        head = np.ones(len(s), bool)
        head[1:] = s[1:] != s[:-1]
        by, s = by[head], s[head]
        least[s], names[s] = time[by], element[by]
        touched = np.unique(doc[by])
        limit[touched] = least.reshape(n_docs, registers)[touched].max(axis=1)
    return names.reshape(n_docs, registers)


def probability_jaccard(pair, a, b, n_pairs: int) -> np.ndarray:
    """J_P of each pair: rows are its elements with their counts in both texts (0 where missing).

    With shares x and y, J_P is the sum over common elements d of 1 / sum over d' of
    max(x[d'] / x[d], y[d'] / y[d]); sorted by x / y, both parts of the inner sum are prefix sums.
    """
    x = a / np.bincount(pair, a, n_pairs)[pair]
    y = b / np.bincount(pair, b, n_pairs)[pair]
    with np.errstate(divide="ignore"):
        ratio = x / y
    by = np.lexsort((ratio, pair))
    pair, x, y, ratio = pair[by], x[by], y[by], ratio[by]
    first = np.searchsorted(pair, pair)
    head = np.ones(len(pair), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (ratio[1:] != ratio[:-1])
    low = np.flatnonzero(head)[np.cumsum(head) - 1]
    cx, cy = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(y)))
    end = np.searchsorted(pair, pair, "right")
    common = (x > 0) & (y > 0)
    inner = (cx[end] - cx[low])[common] / x[common] + (cy[low] - cy[first])[common] / y[common]
    return np.bincount(pair[common], 1 / inner, n_pairs)


def _lower(column) -> tuple[np.ndarray, np.ndarray]:
    return R.strings(pc.utf8_lower(column))


def _sign(words: int, bands: int, rows: int):
    """(id, text_key, size, bands): 128 bits of the text's hash, its bytes, and a hash of each band's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, cut = R.strings(batch.column(1))
            keys = [hashlib.blake2b(whole[cut[i] : cut[i + 1]], digest_size=16).digest() for i in range(len(batch))]
            for i, j in R.pieces(cut, PIECE):
                doc, element, count = shingles(*_lower(batch.column(1).slice(i, j - i)), words)
                names = prob_min_hash(doc, element, count.astype(np.float64), j - i, bands * rows)
                found = np.full((j - i, bands), np.uint64(1))
                for k in range(rows):
                    found = R.mix(found * np.uint64(R.BASE) + names[:, k::rows])
                found = R.mix(found + np.arange(bands, dtype=np.uint64)).view(np.int64)
                some = np.zeros(j - i, bool)
                some[doc] = True
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[some].ravel()))
                columns = [batch.column(0).slice(i, j - i), pa.array(keys[i:j], pa.binary()), pa.array(np.diff(cut[i : j + 1])), values]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "size", "bands"])
        R.trim()

    return run


class Texts:
    """The weighted shingles of some groups of texts, and for each shingle of a group the texts that have it."""

    def __init__(self, column, key: np.ndarray, words: int):
        data, bounds = _lower(column)
        self.n = len(key)
        doc, element, count = shingles(data, bounds, words)
        self.doc, self.element, self.count = doc, element, count
        self.rows = np.searchsorted(doc, np.arange(self.n + 1))
        self.first = np.searchsorted(key, key)  # of the text's group
        total = np.bincount(doc, count, self.n)
        self.share = count / total[doc]
        some = np.maximum(np.diff(self.rows), 1)
        most = np.zeros(self.n, np.int64)
        np.maximum.at(most, doc, count)
        self.uniform = most * some <= total  # all shingles weigh the same
        order = np.lexsort((doc, element, self.first[doc]))
        head = np.ones(len(order), bool)
        g, e = self.first[doc][order], element[order]
        head[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
        self.posting_doc, self.posting_share = doc[order], self.share[order]
        start = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
        self.low, self.own = np.empty_like(order), np.empty_like(order)
        self.low[order], self.own[order] = start, np.arange(len(order))

    def bounds(self, threshold: float):
        """Arrays (a, b, bound, exact) of pairs a > b of a group whose bound is at least the threshold.

        With p and q, the shares of both texts that lie on common shingles, J_P is at most
        p q / (p + q - p q), and exactly that if each text's shingles weigh the same.
        """
        work = np.concatenate(([0], np.cumsum(self.own - self.low)))[self.rows]
        slots = np.concatenate(([0], np.cumsum(np.arange(self.n) - self.first)))
        i = 0
        while i < self.n:
            by_slots = int(np.searchsorted(slots, slots[i] + SLOTS, "right")) - 1
            by_work = int(np.searchsorted(work, work[i] + SHARED, "right")) - 1
            j = min(self.n, max(i + 1, min(by_slots, by_work)))
            r = slice(self.rows[i], self.rows[j])
            n = self.own[r] - self.low[r]
            if n.sum():
                take = np.repeat(self.low[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
                doc = np.repeat(self.doc[r], n)
                other = self.posting_doc[take]
                slot = slots[doc] - slots[i] + other - self.first[doc]
                size = int(slots[j] - slots[i])
                p = np.bincount(slot, np.repeat(self.share[r], n), size)
                q = np.bincount(slot, self.posting_share[take], size)
                found = np.flatnonzero((p > 0) & (p * q >= (threshold - 1e-9) * (p + q - p * q)))
                p, q = p[found], q[found]
                a = np.searchsorted(slots, slots[i] + found, "right") - 1
                b = found + slots[i] - slots[a] + self.first[a]
                yield a, b, p * q / (p + q - p * q), self.uniform[a] & self.uniform[b]
            i = j

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """J_P of pairs."""

        def side(t: np.ndarray):
            n = np.diff(self.rows)[t]
            at = np.repeat(self.rows[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return np.repeat(np.arange(len(t)), n), self.element[at], self.count[at]

        (pa_, ea, ca), (pb, eb, cb) = side(a), side(b)
        pair, element = np.concatenate((pa_, pb)), np.concatenate((ea, eb))
        x, y = np.concatenate((ca, np.zeros(len(cb)))), np.concatenate((np.zeros(len(ca)), cb))
        by = np.lexsort((element, pair))
        pair, element, x, y = pair[by], element[by], x[by], y[by]
        head = np.ones(len(pair), bool)
        head[1:] = (pair[1:] != pair[:-1]) | (element[1:] != element[:-1])
        group = np.cumsum(head) - 1
        x, y = np.bincount(group, x, head.sum()), np.bincount(group, y, head.sum())
        return probability_jaccard(pair[head], x, y, len(a))


class Forest:
    """Disjoint sets; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were in different sets."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _compare(words: int, threshold: float):
    """Pairs (a, b, similarity), each verified, that connect the texts of each key which exact similarities connect.

    Rows are sorted by key. Two rows are compared unless they stand on the same side (null sides
    are compared among themselves); rows with the same ``known`` are connected already.
    """

    def links(t: pa.Table) -> pa.RecordBatch:
        key, ids = (t.column(c).to_numpy() for c in ("key", "id"))
        side, known = t.column("side").fill_null(-1).to_numpy(), t.column("known")
        texts, forest = Texts(t.column("text").combine_chunks(), key, words), Forest(len(key))
        for name in np.unique(known.drop_null().to_numpy()):
            same = np.flatnonzero(known.fill_null(-1).to_numpy() == name)
            same = same[known.is_valid().to_numpy()[same]].tolist()
            for x, y in zip(same, same[1:]):
                if key[x] == key[y]:
                    forest.join(x, y)
        rest, tree = [], []
        for a, b, bound, exact in texts.bounds(threshold):
            use = (side[a] != side[b]) | (side[a] < 0)
            a, b, bound, exact = a[use], b[use], bound[use], exact[use]
            for x, y, like in zip(a[exact].tolist(), b[exact].tolist(), bound[exact].tolist()):
                if forest.join(x, y):
                    tree.append((x, y, like))
            open_ = np.array([forest.root(x) != forest.root(y) for x, y in zip(a[~exact].tolist(), b[~exact].tolist())], bool)
            rest.append((a[~exact][open_], b[~exact][open_], bound[~exact][open_]))
        if rest:
            a, b, bound = (np.concatenate(x) for x in zip(*rest))
            by = np.argsort(-bound, kind="stable")
            a, b = a[by], b[by]
            while len(a):
                x, y = a[:VERIFIED], b[:VERIFIED]
                like = texts.similarity(x, y)
                for k in np.flatnonzero(like >= threshold - 1e-9).tolist():
                    if forest.join(int(x[k]), int(y[k])):
                        tree.append((int(x[k]), int(y[k]), float(like[k])))
                a, b = a[VERIFIED:], b[VERIFIED:]
                open_ = np.array([forest.root(x) != forest.root(y) for x, y in zip(a.tolist(), b.tolist())], bool)
                a, b = a[open_], b[open_]
        x, y = (np.array([t[i] for t in tree], np.int64) for i in (0, 1))
        like = np.array([t[2] for t in tree], np.float64)
        return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(np.minimum(like, 1))], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, PIECE):
            yield links(table)
        R.trim()

    return run


def _links(rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """Verified pairs within the keys of rows (key, side, known, id, text)."""
    dealt = rows.select("key", "side", "known", "id", "text").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(_compare(words, threshold), "a long, b long, similarity double")


def _key(*of: str | Column) -> Column:
    return F.xxhash64(*of)


def _cell(element: np.ndarray) -> np.ndarray:
    return (R.mix(element) % np.uint64(CELLS)).astype(np.int64)


def _count_cells(words: int):
    """(cell, n): how many texts of a partition have a shingle of the cell, once for each of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for i, j in R.pieces(R.strings(batch.column(0))[1], PIECE):
                total += np.bincount(_cell(shingles(*_lower(batch.column(0).slice(i, j - i)), words)[1]), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])
        R.trim()

    return run


def _prefixes(words: int, threshold: float, common):
    """(key, id, settled) for each shingle in the prefix of a text (id, group, settled, text); a key is a shingle of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, settled = (batch.column(c).to_numpy() for c in range(3))
            for i, j in R.pieces(R.strings(batch.column(3))[1], PIECE):
                doc, element, count = shingles(*_lower(batch.column(3).slice(i, j - i)), words)
                by = np.lexsort((element, common.value[_cell(element)], doc))
                share = (count / np.bincount(doc, count, j - i)[doc])[by]
                before = np.cumsum(share) - share
                use = before - before[np.searchsorted(doc, doc)] <= 1 - threshold + 1e-6
                of, element = i + doc[use], element[by][use]
                key = R.mix(element ^ R.mix(group[of].view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[of]), pa.array(settled[of])], ["key", "id", "settled"])
        R.trim()

    return run


def _parts(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(id, part) of those texts (id, group, settled, text) that can be linked to an unsettled one of their group.

    If J_P of two texts is at least t, each has at least t of its weight on common shingles. Put all
    shingles in one order: what a text has before its first common one weighs at most 1 - t. So both
    texts have that shingle in their prefix, the shingles that begin within the first 1 - t of their weight. Texts
    whose prefixes have no shingle in common are never linked; what a chain of common ones connects is a part.
    The order is by how many texts have a shingle (counted in ``CELLS`` cells, so its size is the same for any
    corpus), rare ones first: what a family of texts has in common stands behind the prefixes, if less than t of each is common.
    """
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_count_cells(words), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(CELLS, np.int64)
    order[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    common = spark.sparkContext.broadcast(order)
    keys = texts.select("id", "group", "settled", "text").mapInArrow(_prefixes(words, threshold, common), "key long, id long, settled int")
    keys = materialize(keys, "prefixes")
    common.destroy()
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("settled").alias("settled")).filter("n > 1 and settled = 0")
    edges = keys.select("key", "id").join(shared.select("key", "least"), "key").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return connected_components(edges).withColumnRenamed("label", "part")


def near_duplicates(docs: DataFrame, *args, **options) -> DataFrame:
    """(id, text_id, class_id, near_id, similarity): the classes of ``near_copies``, with one of the verified pairs that make them.

    ``near_id`` is the text that a row's text is linked to by the most similar of those pairs (the least id among equals);
    a row whose text is alone in its class has null in both columns.
    """
    classes, links = near_copies(docs, *args, **options)
    ends = links.select(F.col("a").alias("text_id"), F.col("b").alias("near_id"), "similarity").unionByName(links.select(F.col("b").alias("text_id"), F.col("a").alias("near_id"), "similarity"))
    best = ends.groupBy("text_id").agg(F.max_by(F.struct("near_id", "similarity"), F.struct("similarity", -F.col("near_id"))).alias("best"))
    return classes.join(best, "text_id", "left").select(classes.columns[0], "text_id", "class_id", "best.near_id", "best.similarity")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 6, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, text_id, class_id), groups of texts that are alike; and (a, b, similarity), verified pairs that connect each class.

    Texts are weighted sets of shingles (``words`` lower-cased words, weighted by how often they
    occur). Two texts are linked if their exact probability Jaccard similarity is at least
    ``threshold`` (for texts without repeated shingles that is the Jaccard similarity).
    ``class_id`` is the least id of the connected component, ``text_id`` the least id with the same text.

    1. Equal texts are represented by one, and get ProbMinHash signatures. Those that agree in a
       band share a bucket; texts that a chain of buckets connects are a group of candidates. A pair
       of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8**6)**24 > 0.999, one of 0.85
       with more than 0.9999; a pair of a group counts even if it shares none.
    2. A group of up to ``block_texts`` texts is verified in one task, by the shingles that texts
       have in common. A larger one is cut into blocks. First each block meets the text with most
       company in its buckets; what is linked to that one is connected already. What is left, and the
       connected texts that it can be linked to, falls into parts by rare shingles (``_parts``), which most texts that
       are not alike do not share. Then only blocks of a part's texts that are left meet each other and the
       rest, a task for two blocks. So a large group of copies, or of texts that have up to ``threshold`` of
       their words from one template, costs a few rows for each text, and a part of n texts a row for each and each
       block; no pair leaves a task but those that connect its texts.

    No link between texts of a group is lost. The pairs of a class are as many as its texts less one, or a few more where blocks meet; a and
    b are ``text_id`` values. Null texts are empty; all empty texts are equal, and a text without words is linked to no
    other. Rows with a null id are left out; repeated rows return once. An id with several texts stands
    for all of them. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).filter("id is not null")
    signed = materialize(texts.mapInArrow(_sign(words, bands, rows), "id long, text_key binary, size long, bands array<long>"), "signatures")
    owner = signed.groupBy("text_key").agg(F.min("id").alias("text_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    owner = materialize(owner, "texts")
    members = signed.join(owner.select("text_key", "text_id"), "text_key").select("id", "text_id").distinct()

    buckets = owner.select(F.explode("bands").alias("band"), F.col("text_id").alias("id"))
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    met = materialize(buckets.join(shared, "band").groupBy("id", "least").agg(F.sum("n").alias("n")), "buckets")
    group = connected_components(met.select(F.col("id").alias("a"), F.col("least").alias("b")))
    company = met.groupBy("id").agg(F.sum("n").alias("company"))
    sizes = owner.groupBy(F.col("text_id").alias("id")).agg(F.sum("size").alias("size"))
    placed = group.select("id", F.col("label").alias("group")).join(company, "id").join(sizes, "id")
    placed = materialize(placed, "groups")
    whole = placed.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max_by("id", F.struct("company", -F.col("id"))).alias("pivot")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block_texts, F.col("bytes") / block_bytes)).cast("int")
    whole = whole.withColumn("blocks", F.least(blocks, F.col("n").cast("int")))
    wanted = placed.join(whole, "group").select("id", "group", "pivot", "blocks").hint("merge")  # as at any size, so that the plan does not change as tables grow
    involved = texts.join(wanted, "id").dropDuplicates(["id", "text"])
    involved = materialize(involved, "candidates")

    none = F.lit(None)
    small = involved.filter("blocks = 1")
    found = _links(small.select(F.col("group").alias("key"), none.cast("int").alias("side"), none.cast("long").alias("known"), "id", "text"), words, threshold)
    large = involved.filter("blocks > 1")
    if not large.isEmpty():
        in_block = F.pmod(F.xxhash64("id"), F.col("blocks"))
        each = large.filter("id <> pivot").withColumn("block", in_block.cast("int"))
        center = large.filter("id = pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        star = each.withColumn("side", F.lit(0)).unionByName(center.withColumn("side", F.lit(1)))
        star = materialize(_links(star.withColumns({"key": _key("group", "block"), "known": none.cast("long")}), words, threshold), "star")
        settled = star.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("settled", F.lit(1))
        marked = large.join(settled, "id", "left").withColumn("settled", F.coalesce("settled", F.lit(0)))
        marked = materialize(marked.join(marked.filter("settled = 0").select("group").distinct(), "group", "left_semi"), "marked")
        part = _parts(marked, words, threshold)
        marked = marked.join(part, "id").withColumn("group", F.col("part"))
        amount = marked.groupBy("group", "settled").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes"))
        cut = F.ceil(F.greatest(F.col("n") / block_texts, F.col("bytes") / block_bytes)).cast("int")
        amount = amount.groupBy("group").agg(*(F.coalesce(F.max(F.when(F.col("settled") == s, cut)), F.lit(0)).alias(name) for s, name in ((1, "ns"), (0, "nu"))))
        mine = F.when(F.col("settled") == 1, F.pmod(F.xxhash64("id"), F.col("ns"))).otherwise(F.col("ns") + F.pmod(F.xxhash64("id"), F.col("nu"))).cast("int")
        marked = marked.join(amount, "group").withColumn("block", mine)
        other = F.explode(F.sequence(F.when(F.col("settled") == 1, F.col("ns")).otherwise(F.lit(0)), F.col("ns") + F.col("nu") - 1))
        met = marked.withColumn("other", other)
        key = _key("group", F.least("block", "other"), F.greatest("block", "other"))
        side = F.when(F.col("block") != F.col("other"), (F.col("block") > F.col("other")).cast("int"))
        rest = met.select(key.alias("key"), side.alias("side"), F.when(F.col("settled") == 1, F.col("pivot")).alias("known"), "id", "text")
        found = found.unionByName(star).unionByName(_links(rest, words, threshold))
    found = materialize(found, "links")
    labels = connected_components(found)
    out = members.join(labels.select(F.col("id").alias("text_id"), "label"), "text_id", "left")
    return out.select(F.col("id").alias(id_col), "text_id", F.coalesce("label", "text_id").alias("class_id")), found
