"""Packing: optimal length buckets and token-budget batches (operator 2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize

#: A word, as everywhere in these operators.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that need the least padding in total.

    best[j]: least padded size of the first j lengths; the last bucket pads all of its items
    to the longest one. Each further bucket takes O(n log n) steps and O(n) memory.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    if n and int(counts.sum()) * int(lengths[-1]) >= 1 << 63:
        lengths, counts = lengths.astype(np.float64), counts.astype(np.float64)
    total = np.concatenate(([0], np.cumsum(counts)))
    best = np.concatenate(([0], total[1:] * lengths))
    choices = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        found, choice = _one_more(best, total, lengths)
        if found[n] >= best[n]:
            break
        choices.append(choice)
        best = found
    bounds, j = [], n
    for choice in reversed(choices):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(choice[j])
    return bounds[::-1]


def _one_more(best: np.ndarray, total: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, choice) with one more bucket, where choice[j] items lie in the buckets before the last.

    The first best choice never falls as j grows, so the choice of the middle j of a range
    bounds those of both halves; all ranges of one depth are worked on together.
    """
    n = len(lengths)
    found, choice = np.zeros_like(best), np.zeros(n + 1, np.int64)
    a, b, low, high = (np.array([x]) for x in (1, n + 1, 0, n - 1))
    while len(a):
        mid = (a + b) // 2
        size = np.minimum(high, mid - 1) - low + 1
        start = np.cumsum(size) - size
        i = np.repeat(low - start, size) + np.arange(size.sum())
        cost = best[i] + (np.repeat(total[mid], size) - total[i]) * np.repeat(lengths[mid - 1], size)
        found[mid] = np.minimum.reduceat(cost, start)
        least = np.flatnonzero(cost == np.repeat(found[mid], size))
        choice[mid] = i[least[np.searchsorted(least, start)]]
        a, b, low, high = (np.concatenate(x) for x in ((a, mid + 1), (mid, b), (low, choice[mid]), (choice[mid], high)))
        a, b, low, high = (x[a < b] for x in (a, b, low, high))
    return found, choice


def pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, buckets: int = 8, token_budget: int = 65_536, shard_rows: int = 4096, seed: int = 17, dealt_by: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Batches of like-sized documents: (id, n_tokens, bucket, bucket_length, shard, batch, position, padding), and the columns ``keep``.

    Lengths are counted once and written (with ``keep`` they are counted again instead, so that texts are not written twice). Their histogram over all rows goes to the driver, one row for each distinct length
    (with T tokens in all there are at most sqrt(2 T)). Dynamic programming over these picks the
    bucket bounds with the least padding; a bucket's length is that of its longest document,
    1 at least. A bucket is dealt into shards of about
    ``shard_rows`` documents by a hash of the id, or of ``dealt_by``; in each shard, batches take
    floor(token_budget / bucket_length) documents in turn (one at least, so a longer document
    is a batch of its own). Only a shard's last batch can be short.

    ``length`` is the number of tokens of a row; without it words of ``text`` are counted.
    Null or empty texts have length 0 and lie in the first bucket; null ids, repeated rows and
    other columns do no harm; an empty table gives an empty result. Each row is in one batch.
    """
    n = (F.coalesce(length, F.lit(0)) if length is not None else word_count(F.col("text"))).cast("long")
    dealt = F.xxhash64(F.col(id_col) if dealt_by is None else dealt_by, F.lit(seed))
    kept = F.struct(*keep) if keep else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), n.alias("n_tokens"), dealt.alias("dealt"), *([kept.alias("kept")] if keep else []))
    if not keep:
        rows = materialize(rows, "lengths")
    found = rows.groupBy(F.greatest("n_tokens", F.lit(1).cast("long")).alias("upper")).count().toArrow()
    if not len(found):
        bounds, counts = [1], {1: 0}
    else:
        lengths, rows_of = (found.column(c).to_numpy() for c in ("upper", "count"))
        bounds = optimal_bounds(lengths, rows_of, buckets)
        per = np.zeros(len(bounds), np.int64)
        np.add.at(per, np.searchsorted(bounds, lengths), rows_of)
        counts = dict(zip(bounds, per.tolist()))
    bucket = F.lit(len(bounds) - 1)
    shards, bound = F.lit(max(1, -(-counts[bounds[-1]] // shard_rows))), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        bucket = F.when(fits, i).otherwise(bucket)
        bound = F.when(fits, bounds[i]).otherwise(bound)
        shards = F.when(fits, max(1, -(-counts[bounds[i]] // shard_rows))).otherwise(shards)
    rows = rows.withColumns({"bucket": bucket, "bucket_length": bound.cast("long")})
    rows = rows.withColumn("shard", F.pmod(F.col("dealt"), shards.cast("long")))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", "id", "dealt")) - 1
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_length")))
    rows = rows.withColumn("nth", nth.cast("long"))
    return rows.select(
        F.col("id").alias(id_col), *(F.col(f"kept.{c}").alias(c) for c in keep), "n_tokens", "bucket", "bucket_length", "shard",
        F.floor(F.col("nth") / fit).alias("batch"), (F.col("nth") % fit).alias("position"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
