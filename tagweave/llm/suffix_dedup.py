"""Exact substring dedup over bytes by suffix arrays (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import text_of
from tagweave.llm.repeats import find_repeats, removed_ranges
from tagweave.llm.suffix import suffix_arrays


def repeats_by_suffix_array(key, doc, start, data, first, last, length, *_):
    """The windows in each group (equal keys) of byte strings that repeat an earlier one.

    The strings of a group are joined with a separator into one, its suffix array is
    built, and runs of neighbouring suffixes with ``length`` equal bytes are equal windows.
    """
    order = np.lexsort((start, doc, key))
    key, doc, start, first, last = key[order], doc[order], start[order], first[order], last[order]
    size = last - first
    ends = np.cumsum(size + 1)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols = np.ones(int(ends[-1]), np.int32)
    row = np.repeat(np.arange(len(size)), size)
    symbols[(ends - size - 1)[row] + at] = data[first[row] + at].astype(np.int32) + 2
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    opens = np.flatnonzero(head)
    bounds = np.append((ends - size - 1)[opens], ends[-1])
    # Strings of like length run side by side.
    lengths = np.diff(bounds)
    by = np.argsort(lengths, kind="stable")
    turned = np.concatenate(([0], np.cumsum(lengths[by])))
    take = np.repeat(bounds[:-1][by] - turned[:-1], lengths[by]) + np.arange(turned[-1])
    placed = take[suffix_arrays(symbols[take], turned)]
    # A suffix is a window if ``length`` symbols are left of its string.
    owner = np.repeat(np.arange(len(size)), size + 1)
    window = placed[ends[owner[placed]] - 1 - placed >= length]
    if not len(window):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.searchsorted(bounds, window, "right")
    pre = R.prefix(symbols.astype(np.uint64))
    digest = R.span_hash(pre, window, window + length)
    equal = np.flatnonzero((digest[1:] == digest[:-1]) & (group[1:] == group[:-1]))
    same = np.zeros(len(window), bool)
    for i in range(0, len(equal), 10_000):
        e = equal[i : i + 10_000]
        x = np.lib.stride_tricks.sliding_window_view(symbols, length)
        same[e + 1] = (x[window[e]] == x[window[e + 1]]).all(axis=1)
    run = np.cumsum(~same)
    d, a = doc[owner[window]], start[owner[window]] + window - (ends - size - 1)[owner[window]]
    by = np.lexsort((a, d, run))
    run, d, a = run[by], d[by], a[by]
    head = np.ones(len(run), bool)
    head[1:] = run[1:] != run[:-1]
    least = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d > d[least]) | (a > a[least])
    return d[later], a[later]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = R.strings(batch.column(1))
            spans = batch.column(2)
            kept, n, gone, runs = [], [], [], []
            for i in range(len(batch)):
                text = data[bounds[i] : bounds[i + 1]]
                n.append(len(text))
                found = removed_ranges(np.asarray(spans[i].values), len(text), length) if spans[i].is_valid else []
                edges = [0, *(x for r in found for x in r), len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                gone.append(sum(b - a for a, b in found))
                runs.append([{"start": a, "end": b} for a, b in found])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, span)], ["doc", "kept", "n_bytes", "n_removed", "spans"])

    return run


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 40, **bounds) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start. Matches never cross
    documents. Returns (id, kept binary, n_bytes, n_removed, spans), ``spans`` being the
    maximal removed byte ranges. Overlaps count, and strings are judged on the input.

    Null texts are empty; empty and short texts stay whole. Rows with a null id are left
    out. A row that is there twice is judged once, and both rows return. Other columns are ignored.
    ``gram`` is the size of the strings whose least hash anchors a window.
    An empty table gives an empty result. ``bounds``: when a further anchor divides a group (see ``repeats``).
    """
    spans = find_repeats(docs, id_col, text_col, "bytes", length, gram, True, repeats_by_suffix_array, **bounds)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).filter("doc is not null")  # as in find_repeats, so that its shuffle is used again
    out = texts.join(spans, "doc", "left").select("doc", "text", "spans")
    return out.mapInArrow(_cut(length), "doc long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>").withColumnRenamed("doc", id_col)
