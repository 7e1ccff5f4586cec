"""URL filters by a trie over reversed host labels and path segments (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which the trie is broadcast; a larger table is joined.
MAX_BROADCAST_RULES = 200_000

URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.match(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class Trie:
    """Nodes are dicts: host labels from the last to the first, then under ``/`` path segments.

    A rule's last path segment may be cut short, so a segment node keeps the beginnings that
    rules end with, by length.
    """

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *segments, end = path.split("/")
            for segment in segments:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {}).setdefault(len(end), {})
            if ends.get(end, ("", ""))[1] != "block":  # of equal rules block wins
                ends[end] = (host + path, verdict)

    def find(self, host: str, path: str):
        """The rule with most host labels, then with the longest path."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            found = self._path(node, segments)
            best = found or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]):
        best = None
        for i, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                rest = segment if i == len(segments) - 1 else segment + "/"
                for n in sorted(ends, reverse=True):
                    if n <= len(segment) and (found := ends[n].get(rest[:n])):
                        best = found
                        break
            node = node.get(("path", segment)) if i < len(segments) - 1 else None
            if node is None:
                break
        return best


def _judge(trie, default: str) -> Callable:
    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url)
            rule, verdict = trie.value.find(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return judge


def _by_join(df: DataFrame, url: Column, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule tables too large to broadcast: each distinct host and path meets its host suffixes cut at the paths' lengths."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keyed = df.withColumns({"__host": F.translate(F.regexp_extract(url, URL.pattern, 1), upper, lower), "__path": F.regexp_extract(url, URL.pattern, 2)})
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    lengths = F.lit([r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()])  # as many as the longest path has characters at most
    tried = keyed.select("__host", "__path").distinct().select("__host", "__path", F.explode(suffixes).alias("__h"))
    tried = tried.withColumn("__n", F.explode(F.filter(lengths, lambda n: n <= F.length("__path")))).withColumn("__p", F.substring("__path", F.lit(1), F.col("__n")))
    of = F.max(F.struct((F.col("verdict") == "block").alias("b"), F.concat("host", "path").alias("rule"), "verdict"))
    table = rules.groupBy(F.translate("host", upper, lower).alias("__h"), F.col("path").alias("__p")).agg(of.alias("__r"))
    best = tried.join(table, ["__h", "__p"]).groupBy("__host", "__path").agg(F.max_by("__r", F.struct(F.size(F.split("__h", r"\.")), F.length("__p"))).alias("__r"))
    out = keyed.join(best, ["__host", "__path"], "left")
    found = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__r.rule"), "verdict": F.coalesce("__r.verdict", F.lit(default))}
    return out.withColumns(found).select(*dict.fromkeys([*df.columns, *found]))


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Add host, path, rule and verdict to rows with a url.

    ``rules`` has host, path and verdict ('allow' or 'block'). A rule fits its host and all
    subdomains if the url's path begins with the rule's path. Of the rules that fit, the one
    with most host labels and then with the longest path wins; of equal rules, block wins.
    ``rule`` is host + path of the winner, or null, and then the verdict is ``default``.

    A null url, or one without ``://``, has an empty host and path and fits no rule but one for the empty host.
    Repeated rows are judged alike. Columns of ``df`` named host, path, rule or
    verdict are replaced; the others stay. An empty rule table gives ``default`` throughout, an empty table an empty result.
    Rule tables above ``max_broadcast_rules`` are joined rather than broadcast, with the same verdicts.
    """
    spark = df.sparkSession
    head = rules.select("host", "path", "verdict").limit(max_broadcast_rules + 1).collect()
    url = F.coalesce(F.col(url_col), F.lit(""))
    if len(head) > max_broadcast_rules:
        return _by_join(df, url, rules, default)
    trie = spark.sparkContext.broadcast(Trie([tuple(r) for r in head]))
    judged = df.withColumn("__judged", _judge(trie, default)(url))
    return judged.withColumns({c: F.col(f"__judged.{c}") for c in ("host", "path", "rule", "verdict")}).drop("__judged")
