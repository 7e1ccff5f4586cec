"""Document fingerprints by consistent weighted sampling, with DataFrame functions only (operator 1).

A text is a bag of weighted terms (words, weighted by how often they occur). For each sample
i and term k, r and c are Gamma(2, 1) and b is uniform, all from a hash of (k, i). With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample is the (k, t) with the
least a. Two texts get the same sample with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import text_of

SAMPLES = 48
#: Bits of a sample's name; equal by chance once in 2**24.
NAME = 24
SPACE = r"[\x20\x09-\x0D]+"


def _unit(bits: Column, size: int) -> Column:
    """A uniform number strictly between 0 and 1 from the low ``size`` bits."""
    return (bits.bitwiseAND(F.lit((1 << size) - 1).cast("long")) + F.lit(0.5)) * F.lit(0.5**size)


def _sample(term: Column, log_weight: Column, i: int) -> Column:
    """ln a in the high bits, the name of (term, t) in the low ones; the least is the sample."""
    one, two = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    r = -F.log(_unit(one, 32) * _unit(F.shiftrightunsigned(one, 32), 32))
    log_c = F.log(-F.log(_unit(two, 24) * _unit(F.shiftrightunsigned(two, 24), 24)))
    beta = _unit(F.shiftrightunsigned(two, 48), 16)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta + 1)
    name = F.shiftrightunsigned(two, 64 - NAME).bitwiseXOR(t).bitwiseAND(F.lit((1 << NAME) - 1).cast("long"))
    return F.shiftleft(((log_a + 128) * float(1 << 31)).cast("long"), NAME).bitwiseOR(name)


def named(samples: Column) -> Column:
    """A fingerprint as text: six hex digits a sample, 'empty' for a text without words."""
    text = F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), NAME // 4, "0")), "")
    return F.coalesce(text, F.lit("empty"))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, samples array<int>, fingerprint string) for each distinct combination of ``keys``.

    Terms are the words between white space, lower-cased. Equal texts have equal fingerprints.
    Rows that share keys count as one text (all of their terms). A null text is empty; a text without
    words has the fingerprint 'empty' and null samples. Other columns are ignored. One
    shuffle of ``samples`` longs a text; texts are not moved and their terms stream through one task each.
    """
    terms = F.array_remove(F.split(F.lower(text_of(text_col)), SPACE), "")
    rows = df.select(*keys, F.sort_array(F.transform(terms, lambda w: F.xxhash64(w))).alias("__s"))
    n = F.size("__s")
    runs = F.filter(F.sequence(F.lit(0), n - 1), lambda p: (p == 0) | (F.get("__s", p) != F.get("__s", p - 1)))
    rows = rows.withColumn("__runs", F.when(n > 0, runs))
    rows = rows.select(*keys, "__s", "__runs", F.posexplode_outer("__runs").alias("__j", "__p"))
    term = F.get("__s", F.col("__p"))
    weight = F.coalesce(F.get("__runs", F.col("__j") + 1), F.size("__s")) - F.col("__p")
    rows = rows.select(*keys, term.alias("__term"), F.when(weight == 1, 0.0).otherwise(F.log(weight)).alias("__weight"))
    agg = rows.groupBy(*keys).agg(*(F.min(_sample(F.col("__term"), F.col("__weight"), i)).alias(f"__m{i}") for i in range(samples)))
    names = F.array(*(F.col(f"__m{i}").bitwiseAND(F.lit((1 << NAME) - 1).cast("long")).cast("int") for i in range(samples)))
    found = F.when(F.col("__m0").isNotNull(), names)
    out = agg.select(*keys, found.alias("samples"))
    return out.withColumn("fingerprint", named(F.col("samples")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples, an estimate of the generalised Jaccard similarity; 1 for two empty texts, 0 if one is."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a)).cast("double")
