"""Trie of conversation prefixes, without a trie: sorted sequences, their LCPs and range minima (operator 11).

A conversation is the sequence of its turns' digests. In sorted order the members of a prefix stand side by side,
so a node of the trie is an interval: the stretch around one of its members within which the least LCP of
neighbours is at least the prefix's depth. A sparse table gives the least LCP of any stretch, and each candidate prefix
finds its left and its right end by binary search in it, independently of all others.

Sequences are range-partitioned by (sequence, id), so equal conversations are divided too. Each task
settles the nodes that lie inside its pieces. A node that reaches over the end of a piece is a prefix of the
piece's first or last sequence; only those prefixes, with their sums, meet in one more task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, partitions, text_of

#: Bytes of a turn's digest.
TURN = 16
#: Bytes of sequences that are settled at once, and ids of a list that travel together.
PIECE, CHUNK = 1 << 23, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
FIGURES = ["n", "low", "children", "leaves", "saved", "words"]
FOUND = "kind int, piece long, conv_id long, depth long, parent_conv_id long, parent_at int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, end_key binary, at long, chunk string, first_key binary, first_conv long, last_key binary, " + ", ".join(f"{c} array<long>" for c in FIGURES)
JOINED = "kind int, piece long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_key binary, lows array<long>"
NODE, OPEN, ENDS = 0, 1, 2


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key, words): each conversation's turns in order as 16-byte digests, one after another, and their numbers of words.

    Null turns come first, null roles and texts are empty, equal turn numbers are ordered by digest, repeated rows are turns of their
    own. Rows without a conversation id are left out, other columns ignored; an empty table gives none. Texts are not moved: a row is
    shuffled as its digest. A conversation's digests (16 bytes a turn) have to fit into a task.
    """
    role, text = text_of(role_col), text_of(text_col)
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    in_order = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "words"))).alias("t"))
    return in_order.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["digest"]), "")).alias("key"), F.transform("t", lambda x: x["words"].cast("long")).alias("words"))


class SparseTable:
    """Least values of any stretch: row k holds the minima of 2**k neighbours."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minima of values[start:end], none of them empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.rows[k][start[of]], self.rows[k][end[of] - (1 << int(k))])
        return out

    def extents(self, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For values between neighbouring rows: the first and, exclusively, the last row that can be reached from ``row`` over values of at least ``depth``."""
        left, right = row.copy(), row.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            mins, step = self.rows[k], 1 << k
            if not len(mins):
                continue
            go = right + step <= len(self.rows[0])
            go &= mins[np.where(go, right, 0)] >= depth
            right[go] += step
            go = left >= step
            go &= mins[np.where(go, left - step, 0)] >= depth
            left[go] -= step
        return left, right + 1


def common(digests: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many leading turns each sequence shares with the one before it (without the first)."""
    size = np.diff(bounds)
    most = np.minimum(size[1:], size[:-1])
    out = most.copy()
    has = np.flatnonzero(most)
    if len(has):
        n = most[has]
        begin = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begin, n)
        differ = (digests[np.repeat(bounds[1:-1][has], n) + within] != digests[np.repeat(bounds[:-2][has], n) + within]).any(axis=1)
        out[has] = np.minimum(np.minimum.reduceat(np.where(differ, within, np.iinfo(np.int64).max), begin), n)
    return out


class Nodes:
    """The trie's nodes in preorder (by first row, then depth): the rows [left, right) share their first ``depth`` turns.

    ``entry`` is the node of each candidate, a candidate being a row with each of its depths from 0 on; ``at`` its first candidate in a row.
    """

    def __init__(self, digests: np.ndarray, bounds: np.ndarray):
        rows, size = len(bounds) - 1, np.diff(bounds)
        self.at = np.cumsum(size + 1) - size - 1
        row = np.repeat(np.arange(rows), size + 1)
        depth = np.arange(len(row)) - self.at[row]
        left, right = SparseTable(common(digests, bounds)).extents(row, depth)
        first = left == row
        self.entry = (np.cumsum(first) - 1)[self.at[left] + depth]
        self.left, self.right, self.depth = left[first], right[first], depth[first]
        of = np.flatnonzero(first & (depth > 0))
        self.parent = np.full(len(self.left), -1)
        self.parent[self.entry[of]] = self.entry[of - 1]
        self.last = np.searchsorted(self.left, self.right)  # the end of each subtree in preorder

    def added(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.left), np.int64)
        np.add.at(out, of, values)
        return out

    def children(self, counted: np.ndarray) -> np.ndarray:
        return self.added(np.ones(int(counted.sum()), np.int64), self.parent[counted])

    def in_subtree(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.last] - sums[:-1]


def _digests(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all rows as pairs of numbers, and the rows' bounds."""
    joined = b"".join(keys.to_pylist())
    size = np.array([len(k) for k in keys.to_pylist()], np.int64) // TURN
    return np.frombuffer(joined, np.uint64).reshape(-1, 2), np.concatenate(([0], np.cumsum(size)))


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in ddl.split(", ")])


def _settle(table: pa.Table, chunk: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a piece of sorted rows: those inside it, the sums of those that reach its ends, and the ids that end at the latter."""
    schema = _schema(FOUND)
    table = table.combine_chunks()
    keys, conv = table.column("key").chunk(0), table.column("conv_id").to_numpy()
    digests, bounds = _digests(keys)
    size = np.diff(bounds)
    shared = common(digests, bounds)
    new = np.concatenate(([True], (shared != size[1:]) | (shared != size[:-1])))  # copies collapse: their ids follow each other
    starts = np.concatenate((np.flatnonzero(new), [len(conv)]))
    rows = len(starts) - 1
    take = np.repeat(new, size)
    words = table.column("words").combine_chunks().values.to_numpy(zero_copy_only=False)[take]
    digests, bounds = digests[take], np.concatenate(([0], np.cumsum(size[new])))
    size = np.diff(bounds)
    t = Nodes(digests, bounds)
    n = starts[t.right] - starts[t.left]
    low = SparseTable(conv[starts[:-1]]).least(t.left, t.right)
    said = np.where(t.depth > 0, words[np.minimum(bounds[t.left] + t.depth - 1, max(len(words) - 1, 0))], 0) if len(words) else np.zeros(len(n), np.int64)
    reaches = (t.left == 0) | (t.right == rows)
    inside = ~reaches
    children = t.children(inside)
    leaves, saved = t.in_subtree(inside & (children == 0)), t.in_subtree(np.where(inside, (n - 1) * said, 0))
    top = inside & np.where(t.parent >= 0, reaches[t.parent], False)
    piece = int.from_bytes(hashlib.blake2b(keys[0].as_py() + b"|%d" % conv[0], digest_size=8).digest(), "little", signed=True)

    # Which ids end at a node: those of the row whose whole sequence it is, the first of its interval.
    ends = [EMPTY] * len(n)
    for k in np.flatnonzero(size[t.left] == t.depth):
        ids = conv[starts[t.left[k]] : starts[t.left[k] + 1]]
        if inside[k]:
            ends[k] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
            continue
        name = hashlib.blake2b(keys[int(starts[t.left[k]])].as_py(), digest_size=16).digest()
        for at in range(0, len(ids), chunk):
            some = ids[at : at + chunk].tolist()
            yield _rows(schema, kind=[ENDS], end_key=[name], at=[some[0]], chunk=[",".join(map(str, some))])

    # The prefixes of the first row, then those of the last row that it does not share with the first.
    entries = t.entry[t.at[0] : t.at[0] + size[0] + 1]
    if rows > 1:
        last = t.entry[t.at[-1] : t.at[-1] + size[-1] + 1]
        entries = np.concatenate((entries, last[t.left[last] > 0]))
    closed = {"children": children, "leaves": t.added(leaves[top], t.parent[top]), "saved": t.added(saved[top], t.parent[top])}
    of = {"n": n, "low": low, "words": said} | closed
    ends_of_piece = {"first_key": [keys[0].as_py()], "first_conv": [int(conv[0])], "last_key": [keys[int(starts[-2])].as_py()]}
    yield _rows(schema, kind=[OPEN], piece=[piece], **ends_of_piece, **{c: [of[c][entries]] for c in FIGURES})

    place = np.full(len(n), -1)
    place[entries] = np.arange(len(entries))
    for a in range(0, len(n), 1 << 16):
        at = np.flatnonzero(inside[a : a + (1 << 16)]) + a
        if len(at):
            up = t.parent[at]
            yield _rows(
                schema, kind=np.full(len(at), NODE), piece=np.full(len(at), piece), conv_id=low[at], depth=t.depth[at], parent_conv_id=low[up], parent_at=place[up],
                n_convs=n[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at], ends_sha256=[ends[k] for k in at],
            )


def _settle_pieces(batches: Iterator[pa.RecordBatch], piece: int, chunk: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += batch.nbytes
        if n >= piece:
            yield from _settle(pa.Table.from_batches(held), chunk)
            held, n = [], 0
    if held:
        yield from _settle(pa.Table.from_batches(held), chunk)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over the first and last rows of all pieces, with the pieces' sums: nodes that reach over ends."""
    schema, found = _schema(JOINED), [r for b in batches for r in b.to_pylist()]
    if not found:
        return
    keys, counted, of_piece = [], [], []  # rows; at which candidates a piece's figures stand
    at = 0
    for r in found:
        first = len(r["first_key"]) // TURN
        places = [at + d for d in range(first + 1)]
        at += first + 1
        keys.append(r["first_key"])
        if r["last_key"] != r["first_key"]:
            last, more = len(r["last_key"]) // TURN, len(r["n"]) - first - 1
            places += [at + d for d in range(last + 1 - more, last + 1)]
            at += last + 1
            keys.append(r["last_key"])
        of_piece.append(slice(len(counted), len(counted) + len(places)))
        counted += places
    digests, bounds = _digests(pa.array(keys, pa.binary()))
    t = Nodes(digests, bounds)
    of = t.entry[np.array(counted)]
    figure = {c: np.array([x for r in found for x in r[c]], np.int64) for c in FIGURES}
    n, children = t.added(figure["n"], of), t.added(figure["children"], of) + t.children(t.parent >= 0)
    low, said = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
    np.minimum.at(low, of, figure["low"])
    said[of] = figure["words"]
    leaves = t.in_subtree(t.added(figure["leaves"], of) + (children == 0))
    saved = t.in_subtree(t.added(figure["saved"], of) + (n - 1) * said)
    names, k = [], 0
    while k < len(n):  # nodes of a row stand together, by depth
        row = int(t.left[k])
        h, key = hashlib.blake2b(keys[row][: int(t.depth[k]) * TURN], digest_size=16), keys[row]
        while True:
            names.append(h.digest())
            k += 1
            if k == len(n) or t.left[k] != row:
                break
            h.update(key[int(t.depth[k] - 1) * TURN : int(t.depth[k]) * TURN])
    yield _rows(
        schema, kind=[OPEN] * len(n), conv_id=low, depth=t.depth, parent_conv_id=[int(low[p]) if p >= 0 else None for p in t.parent],
        n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, end_key=names,
    )
    for a in range(0, len(found), 1024):
        some = range(a, min(a + 1024, len(found)))
        yield _rows(schema, kind=[NODE] * len(some), piece=[found[i]["piece"] for i in some], lows=[low[of[of_piece[i]]] for i in some])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from their parts in order; nothing is held but the hash."""
    now, h = None, None
    for batch in batches:
        done = []
        for name, part in zip(batch.column("end_key").to_pylist(), batch.column("chunk").to_pylist()):
            if name == now:
                h.update(b",")
            else:
                if h:
                    done.append((now, h.hexdigest()))
                now, h = name, hashlib.sha256()
            h.update(part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.binary(), pa.string()))], ["end_key", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["end_key", "ends_sha256"])


def prefix_trie(rows: DataFrame, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, key, words; see ``sequences``; conv_id is a key).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node for each distinct sequence
    of first turns, the root with depth 0 among them; conv_id is its smallest member, and a node is known by (conv_id, depth). saved_tokens
    sums (n_convs - 1) x words of the last turn over the subtree: what a cache of prefixes spares. ends_sha256 hashes the ids that end at the
    node. A conversation without turns belongs to the root; an empty table has no root.

    A task holds pieces of ``piece`` bytes. The task that joins pieces gets two sequences of each. An id list is hashed where it lies;
    those over several pieces are streamed, in order, through one task for each node, as the hash asks for.
    """
    spark = rows.sparkSession
    parts = partitions(spark)
    in_order = rows.select("conv_id", "key", "words").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(in_order.mapInArrow(partial(_settle_pieces, piece=piece, chunk=chunk), FOUND), "trie-pieces")
    of_pieces = found.filter(F.col("kind") == OPEN).select("piece", "first_key", "first_conv", "last_key", *FIGURES).repartition(1).sortWithinPartitions("first_key", "first_conv")
    joined = materialize(of_pieces.mapInArrow(_join_pieces, JOINED), "trie-joined")
    ends = found.filter(F.col("kind") == ENDS).select("end_key", "at", "chunk").repartition(parts, "end_key").sortWithinPartitions("end_key", "at").mapInArrow(_hash_ends, "end_key binary, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    over = joined.filter(F.col("kind") == OPEN).select(*columns[:-1], "end_key").join(ends, "end_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    lows = joined.filter(F.col("kind") == NODE).select("piece", "lows")
    inside = found.filter(F.col("kind") == NODE).select("piece", "parent_at", *columns).join(lows, "piece")
    inside = inside.withColumn("parent_conv_id", F.when(F.col("parent_at") >= 0, F.get("lows", F.col("parent_at"))).otherwise(F.col("parent_conv_id")))
    return over.select(*columns).unionByName(inside.select(*columns))
