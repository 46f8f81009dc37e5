"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is ``host/path-prefix`` with a verdict.  It fits its host and all subdomains when the url's path starts with
the rule's path; of several fitting rules the longest wins (then the longer host, then ``block``).  The trie of one
slice of rules is broadcast; a slice has a fixed size bound, and a longer rule list is judged slice by slice.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path and gets the default verdict
unless a rule has neither host nor path.  Repeated rows are judged each; rules without text or with another verdict
than allow or block are refused with an error.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import ASCII_LOWER, python_tasks, slices
from inkveil.sources.session import materialise

#: Characters of rule text that one broadcast trie may hold.
SLICE_CHARS = 8_000_000

JUDGED = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, by its first ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cuts = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    end = min(cuts, default=len(rest))
    tail = rest[end:]
    cuts = [i for i in (tail.find(c) for c in "?#") if i >= 0]
    return rest[:end].translate(ASCII_LOWER), tail[: min(cuts, default=len(tail))]


def build_trie(rules: list[tuple[str, str]]) -> dict:
    """Host labels from the right, then whole path segments, then the last segment as a prefix.

    A node is ``{"hosts": {}, "paths": node}``; a path node is ``{"next": {}, "ends": {prefix: (rule, verdict)}}``.
    """
    root: dict = {"hosts": {}, "paths": None}
    for rule, verdict in rules:
        if not rule or verdict not in ("allow", "block"):
            raise ValueError(f"no rule: {rule!r}, {verdict!r}")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(ASCII_LOWER).split(".")) if host else ():
            node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"next": {}, "ends": {}}
        step = node["paths"]
        *whole, last = (slash + path).split("/")
        for segment in whole:
            step = step["next"].setdefault(segment, {"next": {}, "ends": {}})
        if verdict == "block" or last not in step["ends"]:
            step["ends"][last] = (rule, verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict."""
    best, best_key = None, (-1, -1)
    segments = path.split("/")
    node, depth = trie, 0
    labels = host.split(".")[::-1] if host else []
    while True:
        step, at = node["paths"], 0
        while step is not None and at < len(segments):
            word = segments[at]
            if step["ends"]:
                for k in range(len(word), -1, -1):
                    if (hit := step["ends"].get(word[:k])) is not None:
                        key = (len(hit[0]), depth)
                        if key > best_key:
                            best, best_key = hit, key
                        break
            step, at = step["next"].get(word), at + 1
        if depth == len(labels) or (node := node["hosts"].get(labels[depth])) is None:
            return best
        depth += 1


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule (null if none fits) and verdict.

    ``rules(rule string, verdict string)`` may be of any length: it is read in slices of at most ``SLICE_CHARS``
    characters, and a later slice replaces a match only by a longer one.
    """
    spark = pages.sparkSession
    python_tasks(spark)
    keep = pages.drop("host", "path", "rule", "verdict")
    listed = rules.select("rule", "verdict").toLocalIterator()
    judged, first = keep.withColumn("_hit", F.lit(None).cast(_struct())), True
    for part in slices(((r.rule, r.verdict) for r in listed), lambda r: len(r[0] or ""), SLICE_CHARS):
        trie = spark.sparkContext.broadcast(build_trie(part))
        if not first:
            judged = materialise(judged, "urls")
        judged, first = judged.withColumn("_hit", _matcher(trie)(F.col(url), F.col("_hit.rule"), F.col("_hit.verdict"))), False
    if first:
        trie = spark.sparkContext.broadcast(build_trie([]))
        judged = keep.withColumn("_hit", _matcher(trie)(F.col(url), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return judged.select(
        *keep.columns, "_hit.host", "_hit.path", "_hit.rule", F.coalesce("_hit.verdict", F.lit(default)).alias("verdict")
    )


def _struct() -> str:
    return f"struct<{', '.join(x.strip().replace(' ', ':') for x in JUDGED.split(','))}>"


def _matcher(trie):
    @F.pandas_udf(JUDGED)
    def match(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = trie.value
        for urls, rules, verdicts in parts:
            out = []
            for url, rule, verdict in zip(urls, rules, verdicts):
                host, path = split_url(url)
                hit = longest_match(tree, host, path) or (None, None)
                if rule is not None and (hit[0] is None or len(hit[0]) <= len(rule)):
                    hit = _better((rule, verdict), hit)
                out.append((host, path, *hit))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    return match


def _better(old: tuple, new: tuple) -> tuple:
    """Of two matches, ``old`` at least as long: the longer rule, then the longer host, then block."""
    if new[0] is None or len(old[0]) > len(new[0]):
        return old
    a, b = _labels(old[0]), _labels(new[0])
    if a != b:
        return old if a > b else new
    return new if new[1] == "block" else old


def _labels(rule: str) -> int:
    host = rule.partition("/")[0]
    return host.count(".") + 1 if host else 0
