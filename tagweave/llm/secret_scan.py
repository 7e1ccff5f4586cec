"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that adds what they miss (operator 12).

The field tags the tokens of a whole text as outside, begin or inside of a secret. Its features are a token's shape, the words and
signs around it, and figures of the whole file. It is trained on windows of a bounded sample of documents, in which the
patterns' matches are the labels, and in which other random secrets are put in their place; word features are left out at
random in training, so shape and surroundings each learn to tell alone. The most probable tags are found by Viterbi, exactly: tokens whose emission for outside beats the others
by more than any transitions could gain are outside in a best path, and cut it into short pieces, which are decoded side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import rolling as R
from tagweave.llm.common import text_of

KINDS = ("assign", "access", "hex", "crf")
#: What is searched for, and the least sizes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

O, B, I = range(3)
#: Slots of hashed features; bytes of text that are worked on at once; the least length of a span that the field adds.
SLOTS, PIECE, LEAST = 1 << 17, 1 << 20, 8
#: Documents and windows that training sees, characters of a window, and how often one with secrets stands again with other ones.
MAX_DOCS, MAX_WINDOWS, WINDOW, VARIANTS = 16_384, 2048, 240, 4
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start, then kind. A match is leftmost and none of its kind overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: Letters of secrets, and names before them, that training puts in the place of those that the patterns know.
LETTERS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
ASSIGNED, SIGNS, QUOTES = re.compile(r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?$"""), ("=", " = ", ": ", ":", " "), ("", '"', "'")
NAMES = ("key", "pwd", "auth", "credential", "private_key", "client_secret", "bearer", "access", "pass")


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: of an assignment, its value."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    return sorted({*found, *(m.span() for p in (ACCESS, HEX) for m in p.finditer(text))})


def varied(text: str, spans: list[tuple[int, int]], r: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A window with other secrets in the places of its own, now and then under other names."""
    out, found, at = "", [], 0
    for a, z in spans:
        if a < at:
            continue
        before, end = text[at:a], z
        if (m := ASSIGNED.search(before)) and r.random() < 0.7:
            name, sign, quote = str(r.choice(NAMES)), str(r.choice(SIGNS)), str(r.choice(QUOTES))
            before = before[: m.start()] + ("" if r.random() < 0.2 else (name.upper() if r.random() < 0.2 else name) + sign) + quote
            end += text[z : z + 1] in ("'", '"')
        else:
            quote = ""
        letters = LETTERS[r.integers(len(LETTERS))]
        value = "".join(letters[i] for i in r.integers(0, len(letters), int(r.integers(12, 49))))
        out += before
        found.append((len(out), len(out) + len(value)))
        out, at = out + value + (quote if end > z else ""), end
    return out + text[at:], found


_DIGIT, _LOWER, _UPPER = (np.array([a <= b <= z for b in range(256)]) for a, z in ((48, 57), (97, 122), (65, 90)))
_CLASS = (_DIGIT * 1 + _LOWER * 2 + _UPPER * 3 + (np.arange(256) > 127) * 4).astype(np.int8)
_HEX = _DIGIT | np.array([97 <= (b | 32) <= 102 and b > 64 for b in range(256)])
_DOWN = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SIZES = np.array([2, 3, 4, 5, 7, 9, 13, 17, 20, 24, 32, 40, 41, 64])


@dataclass
class Tokens:
    """Tokens of some documents: runs of letters and digits, and single other signs. Offsets are bytes."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # whether a token opens its document
    keys: list[np.ndarray]  # a feature of each token for each template

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> Tokens:
        kind = _CLASS[data]
        word, sign = R.runs(kind > 0, bounds), np.flatnonzero((kind == 0) & ~R.is_space(data))
        starts, ends = np.concatenate((word[0], sign)), np.concatenate((word[1], sign + 1))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        doc = np.searchsorted(bounds, starts, "right") - 1
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        return cls(starts, ends, doc, first, _features(data, kind, starts, ends, doc, first, len(bounds) - 1))


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] - sums[starts]


#: The templates of words, which training leaves out at times.
WORDS = (4, 5, 6, 7, 8, 9)


def _features(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, first: np.ndarray, docs: int) -> list[np.ndarray]:
    if not len(starts):
        return []
    size = ends - starts
    length = np.searchsorted(_SIZES, size, "right")
    has = [_count(kind == c, starts, ends) > 0 for c in (1, 2, 3, 4)]
    classes = has[0] * 1 + has[1] * 2 + has[2] * 4 + has[3] * 8
    change = np.concatenate(([0], kind[1:] != kind[:-1]))
    changes = np.searchsorted([1, 2, 4, 7, 12], _count(change, starts + 1, ends), "right")
    hexes = (_count(_HEX[data], starts, ends) == size).astype(np.int64)
    sign = np.where(classes == 0, data[starts].astype(np.int64) + 1, 0)
    shape = ((length * 16 + classes) * 8 + changes) * 2 + hexes + (sign << 16)
    # Words are known by their letters; what has digits or is long stands as its shape.
    plain = ~has[0] & (size <= 16)
    words = np.where(plain, R.word_hashes(_DOWN[data], starts, ends), R.mix(shape.astype(np.uint64) + np.uint64(1 << 40)))
    near = np.concatenate(([0], starts[1:] == ends[:-1])).astype(np.int64)  # no space before it
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
    last = np.concatenate((first[1:], [True]))

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(values), values.dtype)
        out[k:] = values[:-k]
        out[place < k] = 0
        return out

    def ahead(values: np.ndarray) -> np.ndarray:
        return np.where(last, 0, np.concatenate((values[1:], values[:1])))

    # Of the whole file: how many of its tokens are signs of code, and how many have digits.
    total = np.maximum(np.bincount(doc, minlength=docs), 1)
    code = np.isin(sign, [ord(c) + 1 for c in "=:{}()[];\"'<>/_"])
    share = [np.searchsorted([0.02, 0.08, 0.2], np.bincount(doc, flags, docs) / total, "right") for flags in (code, has[0])]
    file = (share[0] * 4 + share[1])[doc]
    before, after = back(shape, 1), ahead(shape)
    one = lambda *parts: _mixed(parts)
    return [
        one(shape, near), one(length, hexes), one(classes, length > 8, changes), one(file, length > 8, classes),
        one(words), one(back(words, 1)), one(back(words, 2)), one(ahead(words)), one(back(words, 1), back(words, 2)), one(back(words, 1), back(words, 2), back(words, 3), shape),
        one(before, shape), one(after, shape, near), one(back(shape, 2), before),
    ]


def _mixed(parts) -> np.ndarray:
    h = np.full(1, 0x51, np.uint64)
    for p in parts:
        h = R.mix((p.view(np.uint64) if p.dtype == np.int64 else p.astype(np.uint64)) + h * np.uint64(R.BASE))
    return h


@dataclass
class Model:
    weights: np.ndarray  # slots x tags
    moves: np.ndarray  # from tag to tag
    start: np.ndarray

    def slots(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        return [(R.mix(k + np.uint64(i * 0x9E37 + 1)) % np.uint64(len(self.weights))).astype(np.int64) for i, k in enumerate(keys)]

    def emissions(self, keys: list[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, 3), np.float32)
        for s in self.slots(keys):
            out += self.weights[s]
        return out

    def sure(self) -> float:
        """The most that transitions can gain if a tag other than outside stands between two others."""
        m = np.vstack((self.moves, self.start))  # a text's beginning is as a tag before
        gain = [m[:, s, None] + self.moves[None, s] - m[:, O, None] - self.moves[None, O] for s in (B, I)]
        alone = [m[:, s] - m[:, O] for s in (B, I)]  # the last token
        return float(max(max(g.max() for g in gain), max(a.max() for a in alone)))

    def decode(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of all texts; ``first`` opens one."""
        tags = np.zeros(len(emissions), np.int8)
        open_ = np.flatnonzero(emissions[:, O] < emissions[:, 1:].max(axis=1) + self.sure() + 1e-3)
        if not len(open_):
            return tags
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | first[open_[1:]]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(open_)))
        by = np.argsort(-size, kind="stable")
        begin, size = open_[head[by]], size[by]
        ends_text = np.concatenate((first[1:], [True]))[begin + size - 1]
        score = emissions[begin] + np.where(first[begin][:, None], self.start, self.moves[O]).astype(np.float32)
        come: list[np.ndarray] = []
        final = np.empty((len(begin), 3), np.float32)
        for step in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -step, "left"))  # pieces longer than ``step``
            final[n : len(score)] = score[n:]
            if not n:
                break
            ways = score[:n, :, None] + self.moves
            come.append(ways.argmax(axis=1).astype(np.int8))
            score = ways.max(axis=1) + emissions[begin[:n] + step]
        final += np.where(ends_text[:, None], 0, self.moves[:, O])
        tag = final.argmax(axis=1).astype(np.int8)
        for step in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -step, "left"))
            tags[begin[:n] + step] = tag[:n]
            if step:
                tag[:n] = come[step - 1][np.arange(n), tag[:n]]
        return tags


def train(windows: list[tuple[str, list[tuple[int, int]]]], epochs: int = 10, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, left_out: float = 0.4, seed: int = 0) -> Model:
    """Maximum likelihood by Adam over windows with their secrets (code points). Without windows, all is outside."""
    model = Model(np.zeros((SLOTS, 3), np.float32), np.zeros((3, 3)), np.zeros(3))
    model.weights[:, O] = 0.2
    if not windows:
        return model
    model.weights[:] = 0
    texts = [t.encode() for t, _ in windows]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    t = Tokens.of(data, bounds)
    tags = np.zeros(len(t.starts), np.int64)
    for i, (text, spans) in enumerate(windows):
        for a, z in spans:
            a, z = (int(bounds[i]) + len(text[:x].encode()) for x in (a, z))
            of = np.arange(np.searchsorted(t.ends, a, "right"), np.searchsorted(t.starts, z))
            if len(of):
                tags[of[tags[of] == O]] = I
                tags[of[0]] = B
    slots = np.stack(model.slots(t.keys), axis=1)
    word = np.zeros(slots.shape[1], bool)
    word[list(WORDS)] = True
    begin = np.flatnonzero(t.first)
    size = np.diff(np.append(begin, len(t.first)))
    params = [model.weights, model.moves, model.start]
    state = [(np.zeros(p.shape, np.float32), np.zeros(p.shape, np.float32)) for p in params]
    r, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = r.permutation(len(begin))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            some = some[np.argsort(-size[some], kind="stable")]
            lanes = begin[some][None, :] + np.arange(int(size[some[0]]))[:, None]
            on = np.arange(len(lanes))[:, None] < size[some][None, :]
            lanes = np.where(on, lanes, 0)
            at = lanes[on]
            use = slots[at]
            kept = (r.random((len(at), slots.shape[1])) >= left_out) | ~word
            e = np.zeros((*lanes.shape, 3))
            e[on] = (model.weights[use] * kept[..., None]).sum(axis=1)
            by_token, moved, started = _gradient(model, e, on, np.where(on, tags[lanes], O))
            grads = [np.zeros_like(model.weights), moved / len(some), started / len(some)]
            flat, weight = use[kept], np.repeat(by_token[on], kept.sum(axis=1), axis=0)
            for k in range(3):
                grads[0][:, k] = np.bincount(flat, weight[:, k], SLOTS) / len(some)
            step += 1
            for p, g, (m, v) in zip(params, grads, state):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _gradient(model: Model, e: np.ndarray, on: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of minus the log likelihood: at each token and tag, at moves, at starts; by forward and backward sums over lanes sorted by length."""
    steps, lanes, _ = e.shape
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[0] = e[0] + model.start
    for i in range(1, steps):
        n = int(on[i].sum())
        forward[i] = forward[i - 1]
        forward[i, :n] = e[i, :n] + _log_sum(forward[i - 1, :n, :, None] + model.moves, 1)
    for i in range(steps - 2, -1, -1):
        n = int(on[i + 1].sum())
        backward[i, :n] = _log_sum(model.moves + (e[i + 1, :n] + backward[i + 1, :n])[:, None, :], 2)
    whole = _log_sum(forward[-1], 1)
    by_token = np.exp(forward + backward - whole[:, None]) * on[..., None]
    np.add.at(by_token, (*np.nonzero(on), tags[on]), -1)
    moved = np.zeros((3, 3))
    for i in range(1, steps):
        n = int(on[i].sum())
        p = np.exp(forward[i - 1, :n, :, None] + model.moves + (e[i, :n] + backward[i, :n])[:, None, :] - whole[:n, None, None])
        moved += p.sum(axis=0)
        np.add.at(moved, (tags[i - 1, :n], tags[i, :n]), -1)
    return by_token, moved, by_token[0].sum(axis=0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled document, up to four windows around matches and one anywhere."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            spans = secret_parts(text)
            digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
            r = np.random.default_rng(int.from_bytes(digest, "little"))
            chosen = [spans[i][0] - int(r.integers(20, WINDOW // 2)) for i in sorted(r.permutation(len(spans))[:4])] + [int(r.integers(0, max(1, len(text) - WINDOW)))]
            for k, at in enumerate(chosen):
                at = max(0, at)
                end = min(len(text), at + WINDOW)
                while at and not text[at - 1].isspace() and at > chosen[k] - 80:  # whole words
                    at -= 1
                while end < len(text) and not text[end].isspace() and end < at + 2 * WINDOW:
                    end += 1
                own = [x for a, z in spans if a >= at and z <= end for x in (a - at, z - at)]
                if len(own) == 2 * sum(a < end and z > at for a, z in spans):
                    rows.append((int.from_bytes(hashlib.blake2b(digest + bytes([k]), digest_size=8).digest(), "little", signed=True), bool(own), text[at:end], own))
        if rows:
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["key", "has", "text", "spans"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> Model:
    """Train on at most ``max_windows`` windows with secrets and twice as many without, from about ``max_docs`` documents.

    The documents are those with the least hashes of their ids, the windows those with the least hashes of their texts, so the model does not
    depend on how rows are dealt out. Each window with secrets stands ``VARIANTS`` more times, with random ones in their place. Only windows (``WINDOW`` to some 560 characters each) come to the driver. Equal windows count once.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    most = docs.select(h.alias("h")).orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if most is None:
        return train([])
    sample = docs.filter(h <= most).select(text_of(text_col).alias("text")).mapInArrow(_windows, "key long, has boolean, text string, spans array<int>").dropDuplicates(["key", "text"])
    rows = [r for has, n in ((True, max_windows), (False, 2 * max_windows)) for r in sample.filter(F.col("has") == has).orderBy("key", "text").limit(n).collect()]
    windows = [(r["text"], list(zip(r["spans"][::2], r["spans"][1::2]))) for r in rows]
    r = np.random.default_rng(1)
    others = [varied(*w, r) for w in windows if w[1] for _ in range(VARIANTS)]
    return train(windows + others if others else [])


def added_spans(text_bounds: np.ndarray, data: np.ndarray, model: Model) -> Iterator[tuple[int, int, int]]:
    """(document, start, end) in code points of that document, for each stretch of begin and inside tags of some texts."""
    t = Tokens.of(data, text_bounds)
    if not len(t.starts):
        return
    tags = model.decode(model.emissions(t.keys, len(t.starts)), t.first)
    at = np.flatnonzero(tags != O)
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (tags[at[1:]] == B) | t.first[at[1:]]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    doc = t.doc[at[head]]
    base = chars[text_bounds[doc]]
    yield from zip(doc.tolist(), (chars[t.starts[at[head]]] - base).tolist(), (chars[t.ends[at[tail]]] - base).tolist())


def _scan(batches: Iterator[pa.RecordBatch], model: Model, least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        all_data, all_bounds = R.strings(batch.column(1))
        for i, j in R.pieces(all_bounds, PIECE):
            texts = batch.column(1).slice(i, j - i).to_pylist()
            found = [base_spans(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in f) for f in found] for kind in range(3)]
            more: dict[int, list[tuple[int, int]]] = {}
            for d, a, z in added_spans(all_bounds[i : j + 1] - all_bounds[i], all_data[all_bounds[i] : all_bounds[j]], model):
                if z - a >= least:
                    more.setdefault(d, []).append((a, z))
            for d, spans in more.items():
                old = np.array([(s, e) for s, _, e in found[d]] or [(0, 0)])
                reach = np.maximum.accumulate(old[:, 1])  # the furthest end of the base spans so far
                for a, z in spans:
                    before = int(np.searchsorted(old[:, 0], z))
                    if not before or reach[before - 1] <= a:
                        found[d].append((a, 3, z))
                found[d].sort()
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array(spans, kind)], ["doc_id", "n_assign", "n_access", "n_hex", "spans"])
    R.trim()


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """A row for each row of ``docs``: (doc_id, n_assign, n_access, n_hex, spans of (kind, start, end)), by start, then kind.

    Offsets are code points, ends exclusive. ``assign``, ``access`` and ``hex`` are the patterns' matches, as they are; ``crf`` is what
    the model adds: stretches of at least ``least`` characters that touch none of them. Null texts are empty and have none; repeated rows
    and null ids are rows of their own, other columns are ignored. Nothing is shuffled. A text has to fit into a task several times over.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_scan, model=model, least=least), SCANNED)
