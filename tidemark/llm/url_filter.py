"""Allow and block lists over URLs: a trie over reversed host labels, then path segments.

Rules are (verdict, host, path). A rule fits its host and all subdomains where the URL's path
starts with the rule's path. The longest rule (host and path together) wins; of equally long
ones the longer host, then block. A URL that no rule fits gets the default verdict.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Repeated rows
are judged each, rows without an id too; an empty table gives no rows. Columns of the input other
than the id and the URL are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: The trie is broadcast up to so many bytes of rules; beyond, rules are joined as a table.
BROADCAST_BYTES = 64 << 20


class UrlTrie:
    """Host labels from the right, then whole path segments; the last piece of a path is a prefix of a segment."""

    __slots__ = ("paths", "root")

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # the path trie of this host
            *segments, last = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            tails = node.setdefault(None, {})
            if last not in tails or rule.verdict == "block":
                tails[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(None)
            if paths:
                found = self._path(paths, segments)
                if found and (best is None or len(found.name) >= len(best.name)):
                    best = found
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            tails = node.get(None)
            if tails:
                for length in range(len(segment), -1, -1):
                    if found := tails.get(segment[:length]):
                        best = found
                        break
            node = node.get(segment)
            if node is None:
                break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def judge(df: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns: the id, host, path, rule (null where none fits), verdict. One row per input row."""
    rules = list(rules)
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if sum(len(r.name) + 16 for r in rules) > BROADCAST_BYTES:
        return judge_by_join(urls, rules, id_col, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            hits = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([h and h.name for h in hits], pa.string()), pa.array([h.verdict if h else default for h in hits], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = urls.schema[id_col].dataType.simpleString()
    return urls.mapInArrow(apply, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(urls: DataFrame, rules: list[Rule], id_col: str, default: str) -> DataFrame:
    """The same verdicts where the rules are too many to broadcast: each distinct host and path is judged once, by an equi-join on every suffix of the host."""
    spark = urls.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.verdict, r.name) for r in rules], "rule_host string, rule_path string, rule_verdict string, rule_name string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = (
        urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(known, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule_name"), F.length("rule_host"), F.col("rule_verdict").eqNullSafe("block").alias("b"), "rule_name", "rule_verdict")).alias("m"))
    )
    return urls.join(fits, ["host", "path"], "left").select(id_col, "host", "path", F.col("m.rule_name").alias("rule"), F.coalesce("m.rule_verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT p.rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND prefix(p.path, r.path) GROUP BY p.rid
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN fit f ON p.rid = f.rid
"""
