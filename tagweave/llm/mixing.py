"""Mixing sources by temperature (operator 8)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import materialize
from tagweave.llm.packing import word_count

#: Sources up to which token sums are brought to the driver and the plan is broadcast; with more, Spark sums and joins.
MAX_SOURCES = 100_000
#: Exponents that Spark tries in one pass.
POINTS = 63


class Moments:
    """Of the weights p**a of the sources with tokens: their sum, the sum of p**a ln p**a, and the extremes of p**a / tokens."""

    def __init__(self, tokens: dict | DataFrame):
        self.tokens = tokens
        if isinstance(tokens, dict):
            self.total, self.n = sum(tokens.values()), sum(n > 0 for n in tokens.values())
        else:
            row = tokens.agg(F.sum("tokens").alias("total"), F.count_if(F.col("tokens") > 0).alias("n")).first()
            self.total, self.n = row["total"] or 0, row["n"]

    def at(self, exponents: list[float]) -> list[tuple[float, float, float, float]]:
        if isinstance(self.tokens, dict):
            found = [n for n in self.tokens.values() if n]
            out = []
            for a in exponents:
                w = [(n / self.total) ** a for n in found]
                ratio = [x / n for x, n in zip(w, found)]
                out.append((sum(w), sum(x * math.log(x) for x in w), max(ratio, default=0.0), min(ratio, default=0.0)))
            return out
        p, aggs = F.col("tokens") / F.lit(float(self.total)), []
        for a in exponents:
            w = F.pow(p, F.lit(a))
            aggs += [F.sum(w), F.sum(w * F.log(w)), F.max(w / F.col("tokens")), F.min(w / F.col("tokens"))]
        row = list(self.tokens.filter("tokens > 0").agg(*aggs).first())
        return [tuple(row[4 * i : 4 * i + 4]) for i in range(len(exponents))]


def solve_exponent(m: Moments, target_entropy: float | None = None, target_gain: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent by bisection in 0 (equal shares) to 1 (as they are).

    The entropy falls and the largest number of repeats falls as the exponent grows, so each condition has one
    point where it begins to hold; the largest one is taken. Where Spark has the sums, a pass tries POINTS exponents.
    """
    if not m.n:
        return 0.0

    def entropy(x) -> float:
        return math.log(x[0]) - x[1] / x[0]

    def repeats(x) -> float:
        return x[2] / x[0] * budget if budget else x[2] / x[3]

    if target_gain is not None:
        own = entropy(m.at([1.0])[0])
        target_entropy = own + target_gain * (math.log(m.n) - own)
    holds = []
    if target_entropy is not None:
        holds.append(lambda x: entropy(x) <= target_entropy + 1e-12)
    if max_repeats is not None:
        holds.append(lambda x: repeats(x) <= max_repeats * (1 + 1e-12))
    if not holds or all(f(m.at([0.0])[0]) for f in holds):
        return 0.0
    low, high, points = 0.0, 1.0, 1 if isinstance(m.tokens, dict) else POINTS
    while high - low > 1e-15:
        tried = [low + (high - low) * i / (points + 1) for i in range(1, points + 1)]
        if tried[0] <= low or tried[-1] >= high:
            break
        good = [all(f(x) for f in holds) for x in m.at(tried)]
        first = good.index(True) if True in good else points
        low, high = tried[first - 1] if first else low, tried[first] if first < points else high
    return high


def solve(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, target_gain: float | None = None) -> tuple[float, dict, dict]:
    """(exponent, weights, epochs): how much of the mixture each source is, and how often it is read."""
    m = Moments(tokens)
    a = solve_exponent(m, target_entropy, target_gain, max_repeats, budget)
    whole, _, _, least = m.at([a])[0]
    weights = {s: (n / m.total) ** a / whole if n else 0.0 for s, n in tokens.items()}
    budget = budget or (whole / least if least else 0.0)
    return a, weights, {s: weights[s] * budget / n if n else 1.0 for s, n in tokens.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _plan(sums: DataFrame, m: Moments, exponent: float, budget: float | None, block_rows: int) -> DataFrame:
    """(source, weight, epochs, full, rest, blocks): blocks is a power of two, so that odd factors permute them."""
    whole, _, _, least = m.at([exponent])[0] if m.n else (1.0, 0.0, 0.0, 0.0)
    budget = budget or (whole / least if least else 0.0)
    n = F.col("tokens")
    weight = F.when(n > 0, F.pow(n / F.lit(float(m.total or 1)), F.lit(exponent)) / F.lit(whole)).otherwise(0.0)
    epochs = F.when(n > 0, weight * F.lit(budget) / n).otherwise(1.0)
    full = F.floor(epochs + 1e-9)
    rest = F.greatest(F.lit(0.0), epochs - full) * n
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("rows") / block_rows, F.lit(1.0))))).cast("long")
    return sums.select("source", weight.alias("weight"), epochs.alias("epochs"), full.alias("full"), F.when(rest > 1e-6 * n, rest).otherwise(0.0).alias("rest"), blocks.alias("blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", length: Column | None = None, target_entropy: float | None = None, target_gain: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, block_rows: int = 1024, seed: int = 11, dealt_by: Column | None = None, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Realise temperature weights: (id, source, n_tokens, weight, epoch, block, mix_key), a row for each reading.

    Token shares p of the sources become weights p**a / sum(p**a). The exponent a is bisected
    until the entropy meets ``target_entropy`` (or goes ``target_gain`` of the way from that of the shares as they are
    to that of equal ones) and no source is read more than ``max_repeats`` times. Without a ``budget``
    (tokens) each source is read at least once, so no document is dropped.

    Each epoch is a permutation of a source's blocks (at most about ``block_rows`` documents, dealt by
    hash) and of the documents in each; the last, partial epoch takes blocks in that
    order until the source's tokens are spent, and of the document that crosses the limit the nearer side, so a
    source is off its tokens by half of its longest document at most. Sorting by (mix_key, id) reads block
    after block in each source, whatever their number, and interleaves the sources in proportion. The hash is of the id and the length, or of ``dealt_by``.

    A null source is a source of its own (the empty name). Null or empty texts count 0 tokens;
    they are read in each full epoch, and a source without tokens once. Repeated rows count as
    rows; other columns are ignored; an empty table gives an empty result. Token sums by source
    go to the driver if there are at most ``max_sources``; beyond, Spark sums for the bisection and joins the plan.
    No window is over a whole source: sums run over 1,024 blocks, and over sums of 1,024 blocks.
    """
    n = (F.coalesce(length, F.lit(0)) if length is not None else word_count(F.col("text"))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n.alias("n_tokens"), F.xxhash64(*([id_col, n] if dealt_by is None else [dealt_by]), F.lit(seed)).alias("dealt"))
    rows = materialize(rows, "lengths")
    spark = docs.sparkSession
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    head = sums.limit(max_sources + 1).collect()
    small = len(head) <= max_sources
    sums = spark.createDataFrame(head or [], "source string, tokens long, rows long") if small else materialize(sums, "sources")
    m = Moments({r["source"]: r["tokens"] for r in head} if small else sums)
    exponent = solve_exponent(m, target_entropy, target_gain, max_repeats, budget)
    plan = _plan(sums, m, exponent, budget, block_rows)
    rows = rows.join(F.broadcast(plan) if small else plan, "source").withColumn("block", F.pmod("dealt", "blocks"))

    def rank(epoch: Column) -> Column:
        """The block's place in the epoch: times an odd number, plus another, modulo their number (a power of two)."""
        draw = lambda i: F.pmod(F.xxhash64("source", epoch, F.lit(seed + i)), F.col("blocks"))
        return F.pmod(F.col("block") * F.pmod(2 * draw(1) + 1, F.col("blocks")) + draw(2), F.col("blocks"))

    def within(epoch: Column) -> Column:
        return F.pmod(F.xxhash64("dealt", epoch, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    # The partial epoch: whole blocks before the limit, and the documents of the block that crosses it.
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda c, w: F.sum(c).over(w) - F.col(c)
    partial = rows.filter("rest > 0").withColumn("rank", rank(F.col("full")))
    blocks = partial.groupBy("source", "rank").agg(F.sum("n_tokens").alias("size")).withColumn("top", F.floor(F.col("rank") / 1024))
    tops = blocks.groupBy("source", "top").agg(F.sum("size").alias("sum")).withColumn("lower", running("sum", before("source").orderBy("top"))).select("source", "top", "lower")
    blocks = blocks.withColumn("inside", running("size", before("source", "top").orderBy("rank"))).join(tops, ["source", "top"]).select("source", "rank", (F.col("lower") + F.col("inside")).alias("before"))
    in_block = before("source", "rank").orderBy(within(F.col("full")), "id", "dealt")
    partial = partial.withColumn("within", running("n_tokens", in_block)).join(blocks, ["source", "rank"])
    partial = partial.filter(F.col("before") + F.col("within") + F.col("n_tokens") / 2 <= F.col("rest")).withColumn("epoch", F.col("full"))
    whole = rows.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    cols = ["id", "source", "n_tokens", "weight", "epochs", "epoch", "block", "blocks", "dealt"]
    out = whole.select(cols).unionByName(partial.select(cols))
    key = (F.col("epoch") + (rank(F.col("epoch")) + within(F.col("epoch"))) / F.col("blocks")) / F.greatest("epochs", F.lit(1e-12))
    return out.withColumn("mix_key", key).drop("epochs", "dealt", "blocks").withColumnRenamed("id", id_col)
