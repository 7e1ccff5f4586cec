"""Substring dedup over words: seed and extend (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import text_of
from tagweave.llm.repeats import Symbols, find_repeats, gram_values, removed_ranges


def repeats_by_extension(key, doc, start, values, first, last, length, gram):
    """Extend the seeds that contexts of a group (equal keys) share, both ways, and keep the long matches.

    A context's seeds are the places of its anchor, the least string of ``gram`` words in it. Two equal
    windows have it at the same places, so a seed of one stands against one of the other. The match around
    two seeds is extended to the left and right as far as the words are equal; with ``length`` words
    or more it is a maximal repeat of the two contexts, and all its windows count. Groups are
    bounded (see repeats.GROUP_ROWS); each round compares the contexts with one of their earlier ones.
    """
    order = np.lexsort((start, doc, key))
    key, doc, start, first, size = key[order], doc[order], start[order], first[order], (last - first)[order]
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    values = values[at]
    offset = np.cumsum(size) - size
    row, seed = seeds(Symbols(values, np.append(offset, len(values))), length, gram)
    seed_low = np.searchsorted(row, np.arange(len(key) + 1))
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    opens = np.flatnonzero(head)
    left = np.append(opens[1:], len(key))
    group = np.cumsum(head) - 1
    step = np.zeros(len(values) + 1, np.int64)
    for shift in range(1, int((left - opens).max(initial=1))):
        other = np.arange(len(key)) - shift
        mine = np.flatnonzero((other >= opens[group]) & (doc > doc[np.maximum(other, 0)]))
        if not len(mine):
            continue
        other = other[mine]
        n, m = np.diff(seed_low)[mine], np.diff(seed_low)[other]
        ends = np.cumsum(n * m)
        for i in range(0, int(ends[-1]), SEEDS):
            nth = np.arange(i, min(i + SEEDS, int(ends[-1])))
            pair = np.searchsorted(ends, nth, "right")
            nth = nth - (ends - n * m)[pair]
            x, y = mine[pair], other[pair]
            p, q = seed[seed_low[x] + nth // m[pair]], seed[seed_low[y] + nth % m[pair]]
            a, b = extend(values, p, q, offset[x], offset[y], size[x], size[y])
            long_ = b - a >= length
            np.add.at(step, a[long_], 1)
            np.add.at(step, b[long_] - length + 1, -1)
    found = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    row = np.searchsorted(offset, found, "right") - 1
    return doc[row], start[row] + found - offset[row]


def seed_counts(s: Symbols, use: np.ndarray, length: int, gram: int) -> np.ndarray:
    """How many seeds each context has: one, but for texts that repeat themselves."""
    size = np.diff(s.bounds)[use]
    at = np.repeat(s.bounds[use] - np.cumsum(size) + size, size) + np.arange(size.sum())
    row, _ = seeds(Symbols(s.values[at], np.concatenate(([0], np.cumsum(size)))), length, gram)
    return np.bincount(row, minlength=len(use))


repeats_by_extension.amount = seed_counts

#: Pairs of seeds extended at once.
SEEDS = 1 << 14


def seeds(s: Symbols, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of each occurrence of a context's anchor."""
    grams = gram_values(s, length, gram, 1)
    size = np.diff(s.bounds)
    n = size - gram + 1
    at = np.repeat(s.bounds[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    least = np.minimum.reduceat(grams[at], np.cumsum(n) - n)
    hit = grams[at] == least[row]
    return row[hit], at[hit]


def extend(values, p, q, low_p, low_q, size_p, size_q) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [a, b) of places around p that are equal to those around q, within both contexts."""
    before = np.minimum(p - low_p, q - low_q)
    n = before + np.minimum(low_p + size_p - p, low_q + size_q - q)
    begin = np.cumsum(n) - n
    i = np.arange(n.sum()) - np.repeat(begin + before, n)
    bad = np.flatnonzero(values[np.repeat(p, n) + i] != values[np.repeat(q, n) + i])
    k = np.searchsorted(bad, begin + before)
    last = np.where(k > 0, bad[np.maximum(k - 1, 0)], -1) if len(bad) else np.full(len(p), -1)
    nxt = np.where(k < len(bad), bad[np.minimum(k, len(bad) - 1)], len(i)) if len(bad) else np.full(len(p), len(i))
    a, b = np.maximum(begin, last + 1), np.minimum(begin + n, nxt)
    return p + a - begin - before, p + b - begin - before


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = R.strings(batch.column(1))
            spans = batch.column(2)
            kept, n, gone, runs = [], [], [], []
            for i in range(len(batch)):
                words = data[bounds[i] : bounds[i + 1]].tobytes().split()
                n.append(len(words))
                found = []
                if spans[i].is_valid:
                    ranges = removed_ranges(np.asarray(spans[i].values), len(words), length)
                    edges = [0, *(x for r in ranges for x in r), len(words)]
                    found = [{"start": a, "end": b} for a, b in ranges]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(words).decode())
                gone.append(n[-1] - len(words))
                runs.append(found)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span)], ["doc", "kept", "n_words", "n_removed", "spans"])

    return run


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, gram: int = 5, **bounds) -> DataFrame:
    """Remove every word covered by ``length`` words that also stand in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns (id, kept string, n_words,
    n_removed, spans): the kept words joined by one space, and the removed ranges of words.

    Null texts have no words; texts under ``length`` words stay whole. Rows with a null id
    are left out. A row that is there twice is judged once, and both rows return.
    Other columns are ignored; an empty table gives an empty result. Words are compared by 64-bit hashes.
    ``bounds``: when a further anchor divides a group (see ``repeats``).
    """
    spans = find_repeats(docs, id_col, text_col, "words", length, gram, False, repeats_by_extension, **bounds)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).filter("doc is not null")  # as in find_repeats, so that its shuffle is used again
    out = texts.join(spans, "doc", "left").select("doc", "text", "spans")
    return out.mapInArrow(_cut(length), "doc long, kept string, n_words long, n_removed long, spans array<struct<start:long,end:long>>").withColumnRenamed("doc", id_col)
