"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import materialize, partitions, text_of

PIECE = 1 << 19
#: What a term weighs besides its part in telling the labels apart.
FLOOR = 0.01
#: Standard deviations that chance may give a term's correlation with the labels.
CHANCE = 3.0
#: A term in more than this share of the examples has a column instead of postings.
FREQUENT = 0.04
#: Texts whose frequent terms are multiplied by those columns at once.
TEXTS = 128
#: Folds of examples that the calibration is made across.
FOLDS = 4
#: Blocks of examples visited at once: most promising ones first.
STEPS = (8, 24)


def term_counts(column, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), sorted. Terms are words: hashes of runs of letters and digits, lower-cased, or their places in a sorted vocabulary."""
    docs, terms, counts = [], [], []
    for i, j in R.pieces(R.strings(column)[1], PIECE):
        data, bounds = R.strings(pc.utf8_lower(column.slice(i, j - i)))
        plain = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
        data = np.where(plain, data, np.uint8(32))
        starts, ends, wb = R.words(data, bounds)
        term = R.word_hashes(data, starts, ends)
        doc = np.repeat(np.arange(i, j), np.diff(wb))
        if vocabulary is not None:
            place = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
            use = vocabulary[place] == term if len(vocabulary) else np.zeros(len(term), bool)
            term, doc = place[use].astype(np.uint64), doc[use]
        by = np.lexsort((term, doc))
        term, doc = term[by], doc[by]
        head = np.ones(len(doc), bool)
        head[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        heads = np.flatnonzero(head)
        docs.append(doc[heads]), terms.append(term[heads]), counts.append(np.diff(np.append(heads, len(doc))))
    if not docs:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z
    return np.concatenate(docs), np.concatenate(terms), np.concatenate(counts)


def digests(column) -> np.ndarray:
    """64 bits of each whole text."""
    data, bounds = R.strings(column)
    found = [hashlib.blake2b(data[i:j].data, digest_size=8).digest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.frombuffer(b"".join(found), np.uint64)


@dataclass
class Index:
    """The examples' terms with their weights, and for each term and block of examples the largest weight.

    Rare terms have postings; frequent ones a column with a place for each example.
    """

    vocabulary: np.ndarray
    factor: np.ndarray  # what a term's count is weighted by: IDF, and how it goes with the labels
    ids: np.ndarray
    labels: np.ndarray
    digest: np.ndarray
    block: int
    k: int
    prior: float
    postings: tuple = ()  # each term's first, and the examples and weights of all, sorted by term and example
    slope: float = 1.0
    shift: float = 0.0
    made: bool = False  # from the postings, where it is used: what follows

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__ and k != "made"}

    @property
    def blocks(self) -> int:
        return max(1, -(-len(self.ids) // self.block))

    def weigh(self, doc, term, count, n: int) -> np.ndarray:
        """TF-IDF weights of unit length."""
        w = (1 + np.log(count)) * self.factor[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        return w / norm[doc]

    def build(self, example, term, weight) -> None:
        by = np.lexsort((example, term))
        first = np.searchsorted(term[by], np.arange(len(self.vocabulary) + 1)).astype(np.int32)
        self.postings = first, example[by].astype(np.int32 if len(self.ids) >> 16 else np.uint16), weight[by].astype(np.float32)

    def make(self) -> None:
        """Columns of the frequent terms; for rare ones cells, the postings of a term in a block, with their largest weight."""
        if self.made:
            return
        first, example, weight = self.postings
        example, df = example.astype(np.int64), np.diff(first)
        term = np.repeat(np.arange(len(df)), df)
        frequent = np.flatnonzero(df > FREQUENT * len(self.ids))
        self.column = np.full(len(df), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * self.block), np.float32)
        often = self.column[term] >= 0
        self.dense[self.column[term[often]], example[often]] = weight[often]
        example, term, weight = example[~often], term[~often], weight[~often]
        block = example // self.block
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        heads = np.flatnonzero(head)
        self.example, self.weight = example.astype(np.int32), weight
        self.cell_block, self.cell_start = block[heads].astype(np.int32), np.append(heads, len(term)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(weight, heads) if len(heads) else np.zeros(0, np.float32)
        self.starts = np.searchsorted(term[heads], np.arange(len(df) + 1)).astype(np.int32)
        self.made = True

    def frequent_part(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """What the frequent terms of each text add to its cosine with each example."""
        self.make()
        column = self.column[term]
        use = column >= 0
        of = np.zeros((n, len(self.dense)), np.float32)
        of[doc[use], column[use]] = weight[use]
        return of @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, digest: int | None = None, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine (over 0) and all that tie with the last of them, best first.

        Exact: a block is skipped only if the bound by its rare terms' largest weights (and by the most that
        frequent terms add in it) is below the k-th best. Examples with the very text of the query (``digest``) are left out.
        """
        self.make()
        if frequent is None:
            frequent = self.frequent_part(np.zeros(len(terms), np.int64), terms, weights, 1)[0]
        low, high = self.starts[terms], self.starts[terms + 1]
        n = high - low
        cell = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        by_cell, in_block = np.repeat(weights, n), self.cell_block[cell]
        bound = np.bincount(in_block, by_cell * self.cell_most[cell], self.blocks) + frequent.reshape(self.blocks, self.block).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score = np.zeros(0, np.int64), np.zeros(0)
        at = 0
        for step in (*STEPS, len(order)):
            blocks = order[at : at + step]
            at += step
            if len(score) >= self.k:
                blocks = blocks[bound[blocks] >= score[self.k - 1] - 1e-5]
            if not len(blocks):
                break
            place = np.full(self.blocks, -1)
            place[blocks] = np.arange(len(blocks)) * self.block
            inside = np.flatnonzero(place[in_block] >= 0)
            first, last = self.cell_start[cell[inside]], self.cell_start[cell[inside] + 1]
            m = last - first
            take = np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())
            slot = place[np.repeat(in_block[inside], m)] + self.example[take] % self.block
            total = np.bincount(slot, np.repeat(by_cell[inside], m) * self.weight[take], len(blocks) * self.block)
            total = np.round(total + frequent.reshape(self.blocks, self.block)[blocks].ravel(), 6)  # weights have 24 bits
            use = np.flatnonzero(total > 0 if len(score) < self.k else total >= score[self.k - 1])
            examples, total = blocks[use // self.block] * self.block + use % self.block, total[use]
            if digest is not None:
                other = self.digest[examples] != digest
                examples, total = examples[other], total[other]
            best, score = np.concatenate((best, examples)), np.concatenate((score, total))
            if len(score) > self.k:
                keep = score >= -np.partition(-score, self.k - 1)[self.k - 1]
                best, score = best[keep], score[keep]
            by = np.lexsort((best, -score))
            best, score = best[by], score[by]
        return best, score

    def vote(self, score: np.ndarray, labels: np.ndarray) -> float:
        """Each neighbour votes with 1 / (distance + 0.05); the rate of all examples weighs as one at distance 0.95."""
        w = 1 / (1.05 - np.minimum(score, 1))
        return float((w @ labels + self.prior) / (w.sum() + 1))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve through the votes of left-out examples, by Newton's method with a weak prior."""
        x, y = _logit(votes), labels
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            v = p * (1 - p)
            g = np.array([(x * (p - y)).sum() + (a - 1), (p - y).sum() + b]) * 1.0
            h = np.array([[(x * x * v).sum() + 1, (x * v).sum()], [(x * v).sum(), v.sum() + 1]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(max(a, 1e-3)), float(b)

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(votes) + self.shift)))

    def votes(self, column) -> tuple[np.ndarray, list, list]:
        """Of each text: the vote, and its nearest examples with their cosines. Without a neighbour the vote is the rate of all examples."""
        n = len(column)
        doc, term, count = term_counts(column, self.vocabulary)
        term = term.astype(np.int64)
        weight = self.weigh(doc, term, count, n) if len(doc) else np.zeros(0)
        cut = np.searchsorted(doc, np.arange(n + 1))
        digest = digests(column)
        votes, near, like = np.full(n, self.prior), [[]] * n, [[]] * n
        known: dict = {}
        wanted = np.flatnonzero(np.diff(cut) > 0)
        wanted = wanted[np.unique(digest[wanted], return_index=True)[1]]
        for of in range(0, len(wanted), TEXTS):
            some = wanted[of : of + TEXTS]
            size = np.diff(cut)[some]
            r = np.repeat(cut[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            frequent = self.frequent_part(np.repeat(np.arange(len(some)), size), term[r], weight[r], len(some))
            for nth, i in enumerate(some):
                best, s = self.nearest(term[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]], digest[i], frequent[nth])
                known[digest[i]] = self.vote(s, self.labels[best]) if len(best) else self.prior, self.ids[best].tolist(), s.tolist()
        for i in np.flatnonzero(np.diff(cut)):
            votes[i], near[i], like[i] = known[digest[i]]
        return votes, near, like


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _index(
    term: np.ndarray, count: np.ndarray, example: np.ndarray, ids: np.ndarray, label: np.ndarray, digest: np.ndarray,
    vocabulary: np.ndarray, idf: np.ndarray, block: int, k: int,
) -> Index:
    """The index of some examples: what terms weigh comes from the labels of these examples alone."""
    n, size = len(ids), len(vocabulary)
    pos, present = label.sum(), np.bincount(term, minlength=size).astype(np.float64)
    both = np.bincount(term, label[example], size)
    spread = np.sqrt(np.maximum(pos * (n - pos) * present * (n - present), 1e-9))
    correlation = np.abs(n * both - pos * present) / spread
    factor = idf * (FLOOR + np.maximum(0, correlation - CHANCE / np.sqrt(max(n, 1))))
    index = Index(vocabulary, factor, ids, label, digest, block, k, float((pos + 0.5) / (n + 1)) if n else 0.0)
    if not len(term):
        index.build(example, term, np.zeros(0))
        return index
    weight = index.weigh(example, term, count.astype(np.float64), n)
    # Examples with the same leading term, then with the same commonest word, stand side by side, so that blocks differ.
    leading, commonest = (np.full(n, -1) for _ in range(2))
    for into, by in ((leading, np.lexsort((weight, example))), (commonest, np.lexsort((present[term], example)))):
        into[example[by]] = term[by]
    telling = np.where(leading >= 0, factor[np.maximum(leading, 0)] > 2 * FLOOR * idf[np.maximum(leading, 0)], False)
    order = np.lexsort((ids, commonest, np.where(telling, leading, -1)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    index.ids, index.labels, index.digest = ids[order], label[order], digest[order]
    index.build(rank[example], term, weight)
    return index


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 8192, k: int = 16, block: int = 64, seed: int = 5) -> Index:
    """The index of the examples, and the calibration of its votes.

    At most ``max_examples`` labelled rows (by a hash of the id, so it is a random sample) become
    examples; with fewer, all. They are written once. Terms are all words of the examples. A term's weight is its count's
    logarithm, times IDF from the document frequencies of all documents, times ``FLOOR`` + how far its correlation with
    the label in the examples exceeds chance, so that words that tell nothing still find neighbours
    but do not outvote those that do. The votes are calibrated across ``FOLDS`` folds by text: the examples of
    a fold are voted on by an index of the others, whose terms weigh by the labels of those others, so no label
    has a part in the vote that it calibrates.

    Null ids and labels are left out; an id with several labels is toxic if one says so; an example whose id
    stands in several rows counts once for each. Null texts are empty, and empty examples have no terms. Without
    any label, or without documents, nothing is known, and all scores are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("long").alias("label"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_examples).collect()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    small = F.broadcast(spark.createDataFrame(chosen or [], "id long, label long"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold")
    examples = materialize(texts.join(small, "id").select("label", "text", "id", fold).repartition(partitions(spark), "id"), "examples")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, count = term_counts(batch.column(1))
            cut = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (term.view(np.int64), count.astype(np.int64))]
            columns = [batch.column(2), batch.column(0), batch.column(3), pa.array(digests(batch.column(1)).view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "fold", "digest", "terms", "counts"])

    rows = examples.mapInArrow(vectors, "id long, label long, fold long, digest long, terms array<long>, counts array<long>").toArrow().combine_chunks()
    rows = rows.sort_by([("id", "ascending"), ("digest", "ascending")])
    n = len(rows)
    ids, label, folds, digest = (rows.column(c).to_numpy() for c in ("id", "label", "fold", "digest"))
    label, digest = label.astype(np.float64), digest.astype(np.int64).view(np.uint64)
    sizes = np.array(pc.list_value_length(rows.column("terms"))).astype(np.int64) if n else np.zeros(0, np.int64)
    term, count = (np.array(pc.list_flatten(rows.column(c))) if n else np.zeros(0, np.int64) for c in ("terms", "counts"))
    del rows
    vocabulary, term = np.unique(term.astype(np.int64).view(np.uint64), return_inverse=True)
    example, size = np.repeat(np.arange(n, dtype=np.int32), sizes), len(vocabulary)
    term, count = term.astype(np.int32), count.astype(np.int32)
    R.trim()

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            _, found, _ = term_counts(batch.column(0), words.value)
            total[:size] += np.bincount(found.astype(np.int64), minlength=size)[:size]
            total[size] += len(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "docs"])
        R.trim()

    docs_with = np.zeros(size + 1)
    if size:
        words = spark.sparkContext.broadcast(vocabulary)
        counted = texts.select("text").mapInArrow(frequency, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
        docs_with[counted.column("term").to_numpy()] = counted.column("docs").to_numpy()
        words.destroy()
    idf = np.log(1 + (1 + docs_with[size]) / (1 + docs_with[:size]))
    index = _index(term, count, example, ids, label, digest, vocabulary, idf, block, k)
    if not size or not 0 < label.sum() < n:
        return index
    votes, truth = [], []
    for f in range(FOLDS):
        rest = folds != f
        use, place = rest[example], np.cumsum(rest) - 1
        others = _index(term[use], count[use], place[example[use]], ids[rest], label[rest], digest[rest], vocabulary, idf, block, k)
        shared = spark.sparkContext.broadcast(others)
        del others, use, place
        R.trim()

        def left_out(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.votes(batch.column(1))[0]), batch.column(0)], ["vote", "label"])
            R.trim()

        found = examples.filter(F.col("fold") == f).select("label", "text").mapInArrow(left_out, "vote double, label long").toArrow()
        votes.append(found.column("vote").to_numpy()), truth.append(found.column("label").to_numpy())
        shared.destroy()
        del shared, left_out, found
    index.calibrate(np.concatenate(votes), np.concatenate(truth).astype(np.float64))
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted, neighbours, similarity): the calibrated vote of the nearest examples, with them as evidence.

    Examples with the very text are not among its neighbours; ties with the last one all are. Null texts are empty. A text
    without any word of the examples has no neighbours and the score of the rate of toxic examples.
    Repeated rows and null ids return as they are; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            votes, near, like = ix.votes(batch.column(1))
            scores = ix.probability(votes) if len(ix.ids) else np.zeros(len(batch))
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(like, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "predicted", "neighbours", "similarity"])
        R.trim()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, score double, predicted int, neighbours array<long>, similarity array<double>").withColumnRenamed("id", id_col)
