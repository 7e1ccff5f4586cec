"""Ranked lexical search in integers, by a hybrid of term-at-a-time and document-at-a-time (operator 13).

Documents stay where they are: a task cuts its texts into terms, keeps the postings of the block's terms, and later
ranks its own documents for every item of the block. In a piece of documents, the short lists of an item are
summed term by term into accumulators; these stand as one more list, with its largest sum as its bound, beside the
long lists, over which documents are then scored in ascending order. Lists whose bounds together cannot reach
the k-th best score so far name no candidates, and are looked into only for documents that can still reach it.
Of all documents, only each task's best k of an item are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import materialize

#: ASCII letters and digits, and all bytes of other characters.
TERM = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Items of a block, and characters of their texts; bytes of text and postings that are worked on at once.
BLOCK_ITEMS, BLOCK_CHARS, TEXT, POSTINGS = 1024, 1 << 24, 1 << 22, 1 << 21
#: Lists up to this length are summed; documents that are scored in one step.
SHORT, STEP = 512, 4096
COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms(text: str | None) -> list[bytes]:
    return [t.lower() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


class Vocabulary:
    """The terms of a block of items: found by hash, then compared byte by byte."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.starts, self.size = bounds[:-1], np.diff(bounds)
        hashes = R.word_hashes(self.data, bounds[:-1], bounds[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words are terms, their numbers)."""
        hashes = R.word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        out, which = [], []
        while len(at):  # more than one step only where terms of the block have equal hashes
            ok = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes)
            hit = np.flatnonzero(ok)
            number = self.order[at[hit]]
            same = self.size[number] == (ends - starts)[hit]
            n = np.where(same, self.size[number], 0)
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            differ = data[np.repeat(starts[hit], n) + place] != self.data[np.repeat(self.starts[number], n) + place]
            wrong = np.concatenate(([0], np.cumsum(differ)))
            same &= wrong[begin + n] == wrong[begin]
            out.append(number[same])
            which.append(hit[same])
            if same.all():
                break
            at = np.where(ok, at + 1, len(self.hashes))
            at[hit[same]] = len(self.hashes)
        which, out = np.concatenate(which or [np.zeros(0, np.int64)]), np.concatenate(out or [np.zeros(0, np.int64)])
        order = np.argsort(which, kind="stable")
        return which[order], out[order]


def _count(batches: Iterator[pa.RecordBatch], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Each document with its number of terms, and its postings of the block's terms."""
    known = Vocabulary(words)
    for batch in batches:
        all_data, all_bounds = R.strings(batch.column(1))
        for i, j in R.pieces(all_bounds, TEXT):
            data, bounds = LOWER[all_data[all_bounds[i] : all_bounds[j]]], all_bounds[i : j + 1] - all_bounds[i]
            starts, ends, of = R.runs(TERM[data], bounds)
            hit, number = known.find(data, starts, ends)
            doc = np.searchsorted(of, hit, "right") - 1
            pair, tf = np.unique(doc * len(words) + number, return_counts=True)
            n = np.diff(of)
            cuts = np.searchsorted(pair, np.arange(len(n) + 1) * len(words)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (pair % max(len(words), 1), tf)]
            has = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([x.filter(has) for x in (batch.column(0).slice(i, j - i), pa.array(n), *lists)], ["doc_id", "n", "terms", "tfs"])
    R.trim()


class Best:
    """The k best (score, document) so far, by score and then by ascending document."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score that has to be reached."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        if len(score) > self.k:  # all that tie with the k-th
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc = score[keep], doc[keep]
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def search(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: np.ndarray, best: Best, short: int = SHORT, step: int = STEP) -> int:
    """Add the documents of a piece to ``best``; ``lists`` has (documents in order, what each gets) of every term. Returns how many were scored."""
    few = [x for x in lists if len(x[0]) <= short]
    lists = [x for x in lists if len(x[0]) > short]
    if few:  # term at a time
        docs, of = np.unique(np.concatenate([x[0] for x in few]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, of, np.concatenate([x[1] for x in few]))
        lists.append((docs, sums))
    bounds = np.array([x[1].max() for x in lists], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, below = [lists[i] for i in order], np.concatenate(([0], np.cumsum(bounds[order])))
    scored, at = 0, 0
    while at < len(doc_ids):  # document at a time, ``step`` of them at once
        least = best.least
        first = int(np.searchsorted(below[1:], least))  # lists before it cannot reach it together
        if first == len(lists):
            break
        # The next documents that a list from ``first`` on names: no such list has more than ``step`` before ``upto``.
        begin = [int(np.searchsorted(x[0], at)) for x in lists[first:]]
        live = [(b, x) for b, x in zip(begin, lists[first:]) if b < len(x[0])]
        if not live:
            break
        at = min(int(x[0][b]) for b, x in live)
        upto = min([len(doc_ids)] + [int(x[0][b + step]) for b, x in live if b + step < len(x[0])])
        spans = [(x[0][b:e], x[1][b:e]) for b, x in live if (e := b + int(np.searchsorted(x[0][b:], upto))) > b]
        docs, of = np.unique(np.concatenate([s[0] for s in spans]), return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, of, np.concatenate([s[1] for s in spans]))
        scored += len(docs)
        for i in range(first - 1, -1, -1):
            can = total + below[i + 1] >= least
            docs, total = docs[can], total[can]
            if not len(docs):
                break
            place = np.minimum(np.searchsorted(lists[i][0], docs), len(lists[i][0]) - 1)
            total += np.where(lists[i][0][place] == docs, lists[i][1][place], 0)
        can = total >= least
        best.add(total[can], doc_ids[docs[can]])
        at = upto
    return scored


def _rank(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, short: int, step: int, postings: int) -> Iterator[pa.RecordBatch]:
    """The best k documents of this task for each item."""
    best = [Best(k) for _ in items]

    def piece(held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        own, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        doc = np.repeat(place, own.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, tfs))
        m = 10 + 90 * n[order] * n_docs // n_terms
        gets = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        by_term = np.lexsort((doc, term))
        term, doc, gets = term[by_term], doc[by_term], gets[by_term]
        cuts = np.searchsorted(term, np.arange(len(weights) + 1))
        for b, (_, of) in zip(best, items):
            lists = [(doc[cuts[t] : cuts[t + 1]], gets[cuts[t] : cuts[t + 1]]) for t in of if cuts[t + 1] > cuts[t]]
            if lists:
                search(lists, ids[order], b, short, step)

    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch) + len(batch.column("terms").flatten())
        if size >= postings:
            piece(held)
            held, size = [], 0
    if held:
        piece(held)
    R.trim()
    names = np.repeat(np.array([i for i, _ in items], np.int64), [len(b.doc) for b in best])
    if len(names):
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([b.doc for b in best])), pa.array(np.concatenate([b.score for b in best]))], ["item_id", "doc_id", "score"])


def blocks(items: DataFrame, id_col: str, text_col: str, block_items: int, block_chars: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items in blocks, with the terms of all their texts; they come to the driver one block after another."""
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i")
    found: dict[int, dict[bytes, None]] = {}
    chars = 0
    for i, t in rows.toLocalIterator():
        if i not in found and (len(found) >= block_items or chars >= block_chars):
            yield [(k, list(v)) for k, v in found.items()]
            found, chars = {}, 0
        found.setdefault(i, {}).update(dict.fromkeys(terms(t)))
        chars += len(t or "")
    if found:
        yield [(k, list(v)) for k, v in found.items()]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS, short: int = SHORT, step: int = STEP, postings: int = POSTINGS) -> DataFrame:
    """The k best documents of each item: (item_id, rank, doc_id, score), scores above 0, ties by ascending doc_id.

    A term is a run of letters and digits (ASCII) and of any other characters, with A-Z lower-cased. The weight of a term is
    floor(1000 ln((2 N + 2) / (2 df + 1))) over the N documents with a term; the rest is in whole numbers (BM25 with k1 = 0.8, b = 0.9).
    Each row of ``docs`` is a document of its own, a null text has no term, and rows without an id are left out; texts of a repeated item are
    taken together. Items without a known term have no rows, as has an empty table.

    Items come in blocks of at most ``block_items`` items and about ``block_chars`` characters (one item at least); each block reads
    the texts once. Its postings are written to the shared folder, its document frequencies (one number a term) come to the driver.
    """
    spark, out = docs.sparkSession, None
    texts = docs.filter(F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    for block in blocks(items, item_col, item_text, block_items, block_chars):
        words = list(dict.fromkeys(t for _, of in block for t in of))
        number = {w: i for i, w in enumerate(words)}
        if not words:
            continue
        counted = materialize(texts.mapInArrow(partial(_count, words=words), COUNTED), "lexical")
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(words), np.int64)
        for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        rank = partial(_rank, items=[(i, [number[t] for t in of]) for i, of in block], weights=weights, n_docs=n_docs, n_terms=n_terms, k=k, short=short, step=step, postings=postings)
        found = counted.mapInArrow(rank, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
