"""Allow and block rules on urls, by a trie over reversed host labels and path segments.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. The longest fitting
rule decides: more host labels first, then the longer path; of one rule under both verdicts, block. Urls that no rule
fits get the default verdict.

Defined results: a null url, or one without "://", has empty host and path; an empty path fits only rules with an
empty path; ports and user names stay part of the host; repeated rows are judged each; an empty table gives no rows;
other columns are ignored. Rules are broadcast up to ``max_trie_rules``; beyond it they are joined as a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TRIE_RULES = 500_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Node:
    """One host label or path segment; ``paths`` roots the path trie of a host, ``ends`` holds last segments, in part."""

    __slots__ = ("next", "paths", "ends")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.paths: Node | None = None
        self.ends: list[tuple[str, Rule]] = []

    def child(self, label: str) -> Node:
        return self.next.setdefault(label, Node())


class UrlTrie:
    def __init__(self, rules: list[Rule]):
        self.root = Node()
        for rule in sorted(rules):      # block after allow: the later of two equal rules stays
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.child(label)
            node.paths = node.paths or Node()
            node = node.paths
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.child(segment)
            node.ends = [e for e in node.ends if e[0] != last] + [(last, rule)]

    def match(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            best = (node.paths and self._longest(node.paths, segments)) or best
        return best

    @staticmethod
    def _longest(node: Node, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            fitting = [e for e in node.ends if segment.startswith(e[0])]
            if fitting:
                best = max(fitting, key=lambda e: len(e[0]))[1]
            node = node.next.get(segment)
            if node is None:
                break
        return best


def split_urls(pages: DataFrame, key: str, url: str) -> DataFrame:
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))


def by_trie(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = urls.schema["key"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            found = [match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), hosts, paths, pa.array([r and r.host + r.path for r in found], pa.string()),
                 pa.array([r and r.verdict for r in found], pa.string())],
                ["key", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string")


def by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule tables too large to broadcast: an equi-join on each suffix of the distinct hosts and paths."""
    sites = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(labels, -n, n), ".").alias("rule_host")))
    listed = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    best = (sites.select("host", "path", F.inline(suffixes)).join(listed, "rule_host")
            .where(F.expr("startswith(path, rule_path)"))
            .groupBy("host", "path")
            .agg(F.max(F.struct("depth", F.length("rule_path").alias("long"), "verdict",
                                F.concat("rule_host", "rule_path").alias("rule"))).alias("r")))
    return (urls.join(best, ["host", "path"], "left")
            .select("key", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
               max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of every row. ``rules`` has columns verdict, host and path."""
    urls = split_urls(pages, key, url)
    listed = rules.select("verdict", "host", "path").distinct()
    some = listed.limit(max_trie_rules + 1)
    judged = (by_trie(urls, [Rule(*r) for r in some.collect()]) if some.count() <= max_trie_rules
              else by_join(urls, listed))
    return judged.select(F.col("key").alias(key), "host", "path", "rule",
                         F.coalesce("verdict", F.lit(default)).alias("verdict"))
