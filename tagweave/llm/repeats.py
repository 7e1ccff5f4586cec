"""Exact repeats of at least ``length`` symbols over a whole corpus.

Symbols are the UTF-8 bytes of a text or its words. A window is ``length`` symbols of one
document; it is a repeat if an earlier window has the same content (earlier: a smaller
document, or with ``order='position'`` also an earlier start in the same one).

1. Anchors (map side): the least hash of the ``gram``-symbol strings of a window is its
   anchor, so equal windows have equal anchors. Neighbouring windows with one anchor make
   a context, the range of symbols that they cover: one row for about every
   (length - gram) / 2 symbols. Within a task, of all contexts with equal anchor and
   content only the first goes on; the others are repeats, known on the spot. A common line
   or a third of all rows with one text thus reaches the shuffle as one row for each task.
2. Contexts meet by anchor. Equal content again leaves the first and settles the rest.
   An anchor that no other context shares is done: its windows occur once.
3. Where different contexts share an anchor, their symbols are fetched and a ``resolver``
   finds the repeats within the group: a suffix array, or seed and extend.
   A group too large for that is cut by a further anchor, the least string of its windows under
   another hash: again equal windows stay together, and contexts fall into smaller ones,
   most of which are equal and settled. This is repeated with what is still too large; the last anchor
   is the window itself, so that all windows of a group are equal.

Contexts are equal if both their anchors and their contents have the same 64-bit hash (128 bits);
resolvers, and the last level, compare the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import materialize, partitions, text_of

ROW = "key long, ext long, doc long, loc long, f int"
#: What a row of phase 1 stands for; SELF is added where a context holds its anchor twice.
CONTEXT, SALTED, MARK, SPAN, SELF = 0, 1, 2, 3, 4
#: Contexts of one anchor within a task above which the anchor counts as frequent.
FREQUENT = 64
#: Contexts, and symbols, of one anchor above which a further anchor divides them.
GROUP_ROWS, GROUP_SYMBOLS = 128, 16_000
#: Anchors by strings of ``gram`` symbols, the first included; the one after them is the whole window.
LEVELS = 3
#: Bytes of text worked on at once, contexts and bytes of divided ones held by a task before it passes them on.
PIECE, HELD, HELD_BYTES = 1 << 19, 1 << 18, 1 << 24
#: Bytes of groups resolved at once.
GROUPS = 3 << 19
FETCHED = "key long, doc long, loc long, twice boolean, symbols binary"


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def start_of(c: Column) -> Column:
    return F.shiftright(c, 32)


def length_of(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))


class Symbols:
    """The symbols of some documents (or other strings), one after another, and their prefix hashes."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds = values, bounds
        self.pre = R.prefix(values.astype(np.uint64))

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray, unit: str) -> Symbols:
        if unit == "bytes":
            return cls(data, bounds)
        starts, ends, bounds = R.words(data, bounds)
        return cls(R.word_hashes(data, starts, ends), bounds)

    def raw(self, a: int, b: int) -> bytes:
        return self.values[a:b].tobytes()


def symbol_chunks(data: np.ndarray, bounds: np.ndarray, unit: str, length: int) -> Iterator[tuple[Symbols, np.ndarray, int]]:
    """(symbols, documents, offset): documents of about PIECE bytes together, a longer one in parts that share length - 1 symbols.

    ``offset`` is the number of symbols before a part; each window of a document lies in exactly one part.
    """
    for i, j in R.pieces(bounds, PIECE):
        part = data[bounds[i] : bounds[j]]
        if len(part) <= PIECE or j - i > 1:
            yield Symbols.of(part, bounds[i : j + 1] - bounds[i], unit), np.arange(i, j), 0
            continue
        begin, offset, size = 0, 0, PIECE
        while begin < len(part):
            end = min(begin + size + (length - 1 if unit == "bytes" else 0), len(part))
            while unit == "words" and end < len(part) and not R.is_space(part[end : end + 1])[0]:
                found = np.flatnonzero(R.is_space(part[end : end + PIECE]))
                end = min(end + int(found[0]) if len(found) else end + PIECE, len(part))
            s = Symbols.of(part[begin:end], np.array([0, end - begin]), unit)
            n = int(s.bounds[1]) - length + 1
            if n < 1 and end < len(part):  # long words: not one window yet
                size *= 2
                continue
            yield s, np.arange(i, j), offset
            if end == len(part):
                break
            begin += n if unit == "bytes" else int(R.words(part[begin:end], np.array([0, end - begin]))[0][n])
            offset, size = offset + n, PIECE


def gram_values(s: Symbols, length: int, gram: int, level: int) -> np.ndarray:
    """What the anchors of a level are the least of."""
    if level > LEVELS:
        return R.gram_hash(s.pre, length)
    grams = R.gram_hash(s.pre, gram)
    return R.mix(grams ^ np.uint64(level * R.BASE & (1 << 64) - 1)) if level > 1 else grams


def contexts(s: Symbols, length: int, gram: int, level: int = 1) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, document, start (in the document), count of windows, and whether the anchor occurs twice."""
    grams, width = gram_values(s, length, gram, level), 1 if level > LEVELS else length - gram + 1
    least = R.sliding(grams, width)
    empty = np.zeros(0, np.int64)
    if not len(least):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    doc = np.repeat(np.arange(len(s.bounds) - 1), np.diff(s.bounds))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= s.bounds[1:][doc])
    if not len(starts):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    value, owner = least[starts], doc[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    first, count = starts[head], np.diff(np.append(head, len(starts)))
    ext = R.span_hash(s.pre, first, first + count - 1 + length)
    twice = np.zeros(len(head), bool)
    if s.values.dtype == np.uint8 or level > LEVELS:
        spread = np.zeros(len(grams) + width - 1, np.uint64)
        spread[width - 1 : width - 1 + len(least)][starts] = least[starts]
        full = R.sliding(spread, width, np.maximum)[: len(grams)]
        at = np.flatnonzero(grams == full)
        near = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= width))
        if len(near):
            last = s.bounds[1:][np.searchsorted(s.bounds, at[near], "right") - 1] - length
            run = np.searchsorted(first, np.minimum(at[near], last), "right") - 1
            run = run[(run >= 0)]
            twice[run] = True
    own = owner[head]
    return value[head], ext, own, first - s.bounds[own], count, twice


def _map_anchors(unit: str, length: int, gram: int, by_position: bool, frequent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            data, bounds = R.strings(batch.column(1))
            for s, of, offset in symbol_chunks(data, bounds, unit, length):
                v, e, d, a, c, t = contexts(s, length, gram)
                held.append((v, e, ids[of[d]], _pack(a + offset, c), t))
                n += len(v)
                if n >= HELD:
                    yield _first_contexts(held, by_position, frequent)
                    held, n = [], 0
        if n:
            yield _first_contexts(held, by_position, frequent)
        del held
        R.trim()

    return run


def first_of(v, e, d, loc, by_position: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, later): rows sorted by anchor and content, the first of each, and which of the sorted rows repeat it."""
    by = np.lexsort((loc, d, e, v))
    v, e, d, loc = v[by], e[by], d[by], loc[by]
    head = np.ones(len(v), bool)
    head[1:] = (v[1:] != v[:-1]) | (e[1:] != e[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = d > d[first]
    if by_position:
        later |= loc >> 32 > (loc >> 32)[first]
    return by, head, later


def _first_contexts(held: list, by_position: bool, limit: int) -> pa.RecordBatch:
    v, e, d, loc, t = (np.concatenate(x) for x in zip(*held))
    by, head, later = first_of(v, e, d, loc, by_position)
    v, e, d, loc, t = v[by], e[by], d[by], loc[by], t[by]
    group = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    keep = ~later
    # Frequent anchors are dealt out by content; a mark tells the others that they are frequent.
    hv = v[heads]
    new = np.ones(len(hv), bool)
    new[1:] = hv[1:] != hv[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(hv)))
    frequent = np.repeat(many > limit, many)[group]
    kv, ke, kd, kl, kf = v[keep], e[keep], d[keep], loc[keep], np.where(frequent[keep], SALTED, CONTEXT) + SELF * t[keep]
    kv = np.where(frequent[keep], R.mix(kv ^ ke), kv)
    marks = hv[first[many > limit]]
    # Settled repeats, neighbours merged.
    sd, sl = _merge(d[later], loc[later])
    z = np.zeros
    out = [
        np.concatenate((kv.view(np.int64), marks.view(np.int64), R.mix((sd ^ sl).view(np.uint64)).view(np.int64))),
        np.concatenate((ke.view(np.int64), z(len(marks), np.int64), z(len(sd), np.int64))),
        np.concatenate((kd, z(len(marks), np.int64), sd)),
        np.concatenate((kl, z(len(marks), np.int64), sl)),
        np.concatenate((kf, np.full(len(marks), MARK), np.full(len(sd), SPAN))).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "ext", "doc", "loc", "f"])


def _settle(rows: DataFrame, by_position: bool, group_rows: int) -> DataFrame:
    """Of the contexts of an anchor: the repeats (kind 0), those to resolve (1) and to compare by window (2)."""
    by_key = Window.partitionBy("key")
    same = Window.partitionBy("key", "ext").orderBy("doc", "loc")
    kind = F.col("f").bitwiseAND(F.lit(3))
    context = kind.isin(CONTEXT, SALTED)
    ext = F.when(context, F.col("ext"))
    rows = (
        rows.withColumn("n", F.count("*").over(by_key))
        .filter((F.col("n") > 1) | (F.col("f") != CONTEXT))
        .withColumn("several", F.coalesce(F.min(ext).over(by_key) != F.max(ext).over(by_key), F.lit(False)))
        .withColumn("marked", F.max(kind == MARK).over(by_key))
        .withColumn("large", (F.col("n") > group_rows) | (F.sum(F.when(context, length_of(F.col("loc"))).otherwise(0)).over(by_key) > GROUP_SYMBOLS))
        .withColumn("d0", F.first("doc").over(same))
        .withColumn("l0", F.first("loc").over(same))
    )
    later = F.col("doc") > F.col("d0")
    if by_position:
        later = later | ((F.col("doc") == F.col("d0")) & (start_of(F.col("loc")) > start_of(F.col("l0"))))
    return rows.filter(kind != MARK).select(
        "key", "doc", "loc",
        F.when(kind == SPAN, 0).when(later, 0).when((kind == SALTED) | F.col("marked"), 2)
        .when(F.col("several") | (F.col("f").bitwiseAND(F.lit(SELF)) > 0), F.when(F.col("large"), 2).otherwise(1)).alias("kind"),
    ).filter("kind is not null")


class Divider:
    """Cuts contexts by the anchors of a level, and gives one row (key, doc, loc, twice, symbols) for each that is left.

    Of contexts with equal key and content only the first stays; settled spans are rows with empty symbols.
    """

    def __init__(self, length: int, gram: int, by_position: bool):
        self.length, self.gram, self.by_position = length, gram, by_position
        self.held, self.size = [], 0

    def put(self, key, doc, start, s: Symbols, level: int) -> None:
        v, e, own, at, count, twice = contexts(s, self.length, self.gram, level)
        low = s.bounds[own] + at
        self.held.append((R.mix(key[own] ^ v), e, doc[own], _pack(start[own] + at, count), twice, low, count + self.length - 1, s.values))
        self.size += s.values.nbytes + 64 * len(v)

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.held))
        values = columns.pop()
        base = np.repeat(np.cumsum([0] + [len(x) for x in values[:-1]]), [len(x) for x in columns[0]])
        v, e, d, loc, t, low, size = (np.concatenate(x) for x in columns)
        values, low = np.concatenate(values), low + base
        by, _, later = first_of(v, e, d, loc, self.by_position)
        keep = by[~later]
        sd, sl = _merge(d[by[later]], loc[by[later]])
        self.held, self.size = [], 0
        return fetched(v[keep].view(np.int64), d[keep], loc[keep], t[keep], values, low[keep], size[keep], sd, sl)


def fetched(key, doc, loc, twice, values, low, size, settled_doc, settled_loc) -> pa.RecordBatch:
    """Rows of contexts with their symbols (ranges of ``values``), and of settled spans."""
    width = values.dtype.itemsize
    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    offsets = np.concatenate(([0], np.cumsum(size * width), np.full(len(settled_doc), size.sum() * width))).astype(np.int32)
    symbols = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values[at]))])
    spread = R.mix((settled_doc ^ settled_loc).view(np.uint64)).view(np.int64)
    columns = [np.concatenate(x) for x in ((key, spread), (doc, settled_doc), (loc, settled_loc), (twice, np.zeros(len(settled_doc), bool)))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), symbols], ["key", "doc", "loc", "twice", "symbols"])


def _fetch(unit: str, length: int, gram: int, by_position: bool) -> Callable:
    """Rows (key, doc, loc, twice, symbols) for the resolver: contexts of small groups as they are, others divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divider = Divider(length, gram, by_position)
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0), np.int64)
            data, bounds = R.strings(batch.column(1))
            wanted = batch.column(2)
            for s, of, offset in symbol_chunks(data, bounds, unit, length):
                some = wanted.slice(of[0], len(of))
                if some.null_count == len(some):
                    continue
                with_some = np.flatnonzero(np.asarray(some.is_valid()))
                items = some.drop_null()
                doc = np.repeat(with_some, np.asarray(pc.list_value_length(items)))
                items = items.flatten()
                key, loc, kind = (np.asarray(items.field(x)) for x in ("key", "loc", "kind"))
                if bounds[of[0] + 1] - bounds[of[0]] > PIECE:  # the contexts of this part
                    here = ((loc >> 32) >= offset) & ((loc >> 32) < offset + len(s.values) - length + 1)
                    key, loc, kind, doc = key[here], loc[here], kind[here], doc[here]
                start, size = loc >> 32, (loc & 0xFFFFFFFF) + length - 1
                low = s.bounds[doc] + start - offset
                whole = kind == 1
                if whole.any():
                    yield fetched(key[whole], ids[of[0] + doc[whole]], loc[whole], np.ones(whole.sum(), bool), s.values, low[whole], size[whole], none, none)
                if not whole.all():
                    low, size, start, doc = low[~whole], size[~whole], start[~whole], doc[~whole]
                    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                    first = R.sliding(gram_values(s, length, gram, 1), length - gram + 1)[low]
                    divider.put(first, ids[of[0] + doc], start, Symbols(s.values[at], np.concatenate(([0], np.cumsum(size)))), 2)
                if divider.size >= HELD_BYTES:
                    yield divider.flush()
        if divider.size:
            yield divider.flush()
        R.trim()

    return run


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, bool]]:
    """Groups of a stream sorted by key, some at once; and whether it is a part of a single group larger than ``size`` bytes."""
    parts, n, open_key = [], 0, None

    def whole(t: pa.Table, key: np.ndarray, end: int) -> Iterator[tuple[pa.Table, bool]]:
        begin = int(np.searchsorted(key[:end], open_key, "right")) if open_key is not None else 0
        if begin:
            yield t.slice(0, begin), True
        if end > begin:
            yield t.slice(begin, end - begin), False

    for batch in batches:
        if not len(batch):
            continue
        parts.append(batch)
        n += batch.nbytes
        if n < size:
            continue
        t = pa.Table.from_batches(parts)
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from whole(t, key, cut)
            open_key = None
            t = t.slice(cut).combine_chunks()
            parts, n = t.to_batches(), t.nbytes
        else:
            yield t, True
            parts, n, open_key = [], 0, key[-1]
    if parts:
        t = pa.Table.from_batches(parts)
        yield from whole(t, t.column("key").to_numpy(), len(t))


def _resolve(resolver: Callable, unit: str, length: int, gram: int, by_position: bool, level: int, group_rows: int) -> Callable:
    """(doc, spans) of the repeats found, and rows as of ``_fetch`` of groups that a further anchor divides.

    A resolver can have an ``amount``: what each context counts for in its group's size, instead of 1.
    """
    amount = getattr(resolver, "amount", None)
    kind = np.uint8 if unit == "bytes" else np.uint64

    def found(d: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
        d, loc = _merge(d, loc)
        cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        spans = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(d)).astype(np.int32)), pa.array(loc))
        return _row(pa.array(d[cuts]), spans=spans)

    def divided(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _row(**dict(zip(batch.schema.names, batch.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divider = Divider(length, gram, by_position)
        last = None  # of the last level: (key, window, doc, start) of the first row of a group that goes on
        for t, part in grouped(batches, GROUPS):
            key, doc, loc, twice = (t.column(x).to_numpy() for x in ("key", "doc", "loc", "twice"))
            data, bounds = R.strings(t.column("symbols"))
            values, bounds = data.view(kind) if kind == np.uint8 else np.frombuffer(data.tobytes(), kind), bounds // kind().itemsize
            settled = np.diff(bounds) == 0
            d, o = [doc[settled]], [loc[settled]]
            use = np.flatnonzero(~settled)
            if level > LEVELS:
                x, y, last = _equal_windows(key[use], doc[use], loc[use], values, bounds[use], length, by_position, last if part else None)
                d.append(x), o.append(y)
            elif len(use):
                s = Symbols(values, bounds)
                e = R.span_hash(s.pre, bounds[use], bounds[use + 1])
                by, _, later = first_of(key[use].view(np.uint64), e, doc[use], loc[use], by_position)
                d.append(doc[use[by[later]]]), o.append(loc[use[by[later]]])
                use = use[by[~later]]
                _, group, rows = np.unique(key[use], return_inverse=True, return_counts=True)
                n = np.diff(bounds)[use]
                size, work = np.bincount(group, n), np.bincount(group, amount(s, use, length, gram)) if amount else rows
                alone = rows[group] == 1
                if by_position:
                    alone &= ~twice[use]
                large = ((work > group_rows)[group] & (rows > 1)[group] | (size > GROUP_SYMBOLS)[group]) & ~alone | part
                some = use[large]
                if len(some):
                    n = np.diff(bounds)[some]
                    at = np.repeat(bounds[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    divider.put(key[some].view(np.uint64), doc[some], loc[some] >> 32, Symbols(values[at], np.concatenate(([0], np.cumsum(n)))), level + 1)
                rest = use[~large & ~alone]
                if len(rest):
                    x, y = resolver(key[rest], doc[rest], loc[rest] >> 32, values, bounds[rest], bounds[rest + 1], length, gram)
                    d.append(x), o.append(_pack(y, np.ones_like(y)))
            d, o = np.concatenate(d), np.concatenate(o)
            if len(d):
                yield found(d, o)
            if divider.size >= HELD_BYTES:
                yield divided(divider.flush())
        if divider.size:
            yield divided(divider.flush())
        R.trim()

    return run


RESOLVED = "doc long, spans array<long>, key long, loc long, twice boolean, symbols binary"


def _row(doc: pa.Array, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"spans": pa.list_(pa.int64()), "key": pa.int64(), "loc": pa.int64(), "twice": pa.bool_(), "symbols": pa.binary()}
    return pa.RecordBatch.from_arrays([doc, *(given.get(c, pa.nulls(len(doc), k)) for c, k in kinds.items())], ["doc", *kinds])


def _equal_windows(key, doc, loc, values, low, length: int, by_position: bool, last: tuple | None):
    """Of the last level, rows sorted by key, doc and loc: each is a run of equal windows; all but the first are repeats."""
    if not len(key):
        return doc, loc, last
    window = np.lib.stride_tricks.sliding_window_view(values, length)[low]
    _, content = np.unique(np.ascontiguousarray(window).view(np.dtype((np.void, window.shape[1] * window.itemsize))).ravel(), return_inverse=True)
    by = np.lexsort((loc, doc, content, key))
    k, c, d, a, n = key[by], content[by], doc[by], loc[by] >> 32, loc[by] & 0xFFFFFFFF
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    d0, a0 = d[at], a[at]
    if last is not None:
        same = (k == last[0]) & (window[by] == last[1]).all(axis=1)
        d0, a0 = np.where(same, last[2], d0), np.where(same, last[3], a0)
    later = d > d0
    if by_position:
        first = (d == d0) & (a == a0)
        later |= a > a0
        # Of the first run all windows but the first one repeat it.
        x, y = np.concatenate((d[later], d[first])), np.concatenate((_pack(a[later], n[later]), _pack(a[first] + 1, n[first] - 1)))
        x, y = x[y & 0xFFFFFFFF > 0], y[y & 0xFFFFFFFF > 0]
    else:
        x, y = d[later], _pack(a[later], n[later])
    end = at[-1]
    if last is None or key[0] != last[0] or k[end] != last[0]:
        last = k[end], window[by[end]], d[end], a[end]
    return x, y, last


def _merge(d: np.ndarray, loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows as ranges of starts."""
    by = np.lexsort((loc, d))
    d, a = d[by], loc[by] >> 32
    b = a + (loc[by] & 0xFFFFFFFF)
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (a[1:] > b[:-1])
    cuts = np.flatnonzero(cut)
    if not len(cuts):
        return d, loc
    return d[cuts], _pack(a[cuts], np.maximum.reduceat(b, cuts) - a[cuts])


def find_repeats(docs: DataFrame, id_col: str, text_col: str, unit: str, length: int, gram: int, by_position: bool, resolver: Callable, frequent: int = FREQUENT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc, spans): for each document with repeats, ranges of window starts as start << 32 | count."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text")).filter("doc is not null")
    rows = texts.mapInArrow(_map_anchors(unit, length, gram, by_position, frequent), ROW)
    settled = materialize(_settle(rows, by_position, group_rows), "contexts")
    wanted = settled.filter("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("key", "loc", "kind")).alias("wanted"))
    rest = texts.join(wanted, "doc", "left").select("doc", "text", "wanted").mapInArrow(_fetch(unit, length, gram, by_position), FETCHED)
    spans = settled.filter("kind = 0").groupBy("doc").agg(F.collect_list("loc").alias("spans"))
    for level in range(2, LEVELS + 2):
        dealt = rest.repartition(partitions(spark), "key").sortWithinPartitions("key", "doc", "loc")
        out = materialize(dealt.mapInArrow(_resolve(resolver, unit, length, gram, by_position, level, group_rows), RESOLVED), "resolved")
        spans = spans.unionByName(out.filter("spans is not null").select("doc", "spans"))
        rest = out.filter("spans is null").select("key", "doc", "loc", "twice", "symbols")
        if rest.isEmpty():
            break
    return spans.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed_ranges(spans: np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """The maximal ranges of n symbols that repeated windows cover."""
    a, c = spans >> 32, spans & 0xFFFFFFFF
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.minimum(a + c - 1 + length, n)[by]
    ends = np.maximum.accumulate(b)
    head = np.ones(len(a), bool)
    head[1:] = a[1:] > ends[:-1]
    heads = np.flatnonzero(head)
    return list(zip(a[heads].tolist(), np.maximum.reduceat(b, heads).tolist())) if len(heads) else []
