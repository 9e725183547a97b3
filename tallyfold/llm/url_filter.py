"""URL verdicts from a trie over reversed host labels and path segments.

A rule is a verdict (``allow`` or ``block``), a host and a path. It fits its host and all subdomains
when the path of the url starts with the path of the rule. Of the rules that fit, the longest rule
string wins; of equally long ones the one with the longer host, then ``block``.

The trie is broadcast when the rules are counted and fit a stated bound. Beyond it, the nodes that a url
passes are joined with the rules as a table, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_TRIE_RULES = 200_000
MAX_TRIE_CHARS = 32_000_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, URL_PARTS, 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def _order(rule: tuple[str, str, str]) -> tuple:
    verdict, host, path = rule
    return len(host) + len(path), len(host), verdict == "block"


class Trie:
    """Host labels from the right, then whole path segments; a rule's last, open segment is a tail."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for rule in rules:
            _, host, path = rule
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            tails = node.setdefault("tails", {})
            if tail not in tails or _order(rule) > _order(tails[tail]):
                tails[tail] = rule

    def find(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The winning rule of one url, or None."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            below = node.get("paths")
            for segment in segments:
                if below is None:
                    break
                tails = below.get("tails", {})
                # A tail is a beginning of the next segment: look up each beginning, longest first.
                if len(tails) > len(segment):
                    fits = (segment[:k] for k in range(len(segment), -1, -1) if segment[:k] in tails)
                else:
                    fits = sorted((t for t in tails if segment.startswith(t)), key=len, reverse=True)
                tail = next(iter(fits), None)
                if tail is not None and (best is None or _order(tails[tail]) > _order(best)):
                    best = tails[tail]
                below = below.get("segments", {}).get(segment)
        return best


def clean_rules(rules: DataFrame) -> DataFrame:
    """Columns verdict, host, path; nulls in host or path are empty, rows without a verdict go."""
    return rules.select(
        "verdict",
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).where(F.col("verdict").isin("allow", "block") & (F.col("host") != ""))


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {
                    "rule": [f[1] + f[2] if f else None for f in found],
                    "verdict": [f[0] if f else default for f in found],
                }
            )

    judged = urls.withColumn("_found", judge("_host", "_path"))
    return judged.withColumn("_rule", F.col("_found.rule")).withColumn("_verdict", F.col("_found.verdict"))


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Each trie node on a url's way is a key: (host suffix, whole segments)."""
    last = F.element_at(F.split("path", "/", -1), -1)
    nodes = rules.select(
        F.col("host").alias("_node_host"),
        F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/', -1), -1)))").alias("_node_path"),
        last.alias("_tail"),
        F.struct(
            (F.length("host") + F.length("path")).alias("long"),
            F.length("host").alias("wide"),
            (F.col("verdict") == "block").alias("block"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("_win"),
    )
    distinct = urls.select("_host", "_path").distinct()
    ways = distinct.withColumn("_labels", F.split("_host", r"\.", -1)).withColumn("_parts", F.split("_path", "/", -1))
    ways = ways.withColumn(
        "_node_host",
        F.explode(F.expr("transform(sequence(1, size(_labels)), k -> array_join(slice(_labels, k, size(_labels)), '.'))")),
    )
    ways = ways.withColumn(
        "_k", F.explode(F.expr("sequence(0, size(_parts) - 1)"))
    ).withColumn("_node_path", F.expr("if(_k = 0, '', concat(array_join(slice(_parts, 1, _k), '/'), '/'))"))
    fits = ways.join(nodes, ["_node_host", "_node_path"]).where(F.expr("startswith(_parts[_k], _tail)"))
    won = fits.groupBy("_host", "_path").agg(F.max("_win").alias("_win"))
    joined = urls.join(won, ["_host", "_path"], "left")
    return joined.withColumn("_rule", F.col("_win.rule")).withColumn(
        "_verdict", F.coalesce(F.col("_win.verdict"), F.lit(default))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    max_rules: int = MAX_TRIE_RULES,
    max_chars: int = MAX_TRIE_CHARS,
) -> DataFrame:
    """``keep`` columns, host, path, rule (null when none fits) and verdict of every row of ``pages``.

    Repeated rows are judged each. A null url, or one without ``://``, has an empty host and path, which no
    rule fits, and gets ``default``. Rules with a null or empty host or an unknown verdict are ignored; a null path
    is empty and fits every path. Of the other columns of ``pages`` nothing is read, so their names cannot clash. No
    pages or no rules are fine. Up to ``max_rules`` rules with ``max_chars`` characters are broadcast as a trie; more
    are joined node by node.
    """
    rules = clean_rules(rules)
    size = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("c"))
    n, chars = size.first()
    urls = pages.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(url).alias("_url"))
    urls = urls.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    if n <= max_rules and chars <= max_chars:
        judged = _by_trie(urls, [tuple(r) for r in rules.collect()], default)
    else:
        judged = _by_join(urls, rules, default)
    return judged.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
