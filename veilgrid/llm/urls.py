"""URL filters: allow and block entries in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.frames import fresh, without

#: Entries (some 100 bytes each) up to which the trie is broadcast; more of them are joined by host.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    before = F.regexp_extract(rest, r"\A([^?#]*)", 1)
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.substring(before, F.length(host) + 1, F.length(before))
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes: host label -> node, 0 -> root of the path trie. Path nodes: segment -> node, 0 -> [(start of a segment, rule, verdict)].

    A path such as ``/en/a`` is the segments '', 'en' and the start 'a': it fits every path that it begins. Of an
    allow and a block entry for the same place the block entry counts.
    """
    root: dict = {}
    for host, path, verdict in sorted(rules, key=lambda r: r[2] != "block"):
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(0, {})
        *segments, start = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        ends = node.setdefault(0, [])
        if all(e[0] != start for e in ends):
            ends.append((start, host + path, verdict))
            ends.sort(key=lambda e: -len(e[0]))
    return root


def longest(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """Rule and verdict of the entry with the most host labels, then the longest path."""
    found, segments = None, path.split("/")
    node, labels = root, iter(reversed(host.split(".")) if host else ())
    while node is not None:
        at = node.get(0)
        best = None
        for segment in segments:
            if at is None:
                break
            best = next(((rule, verdict) for start, rule, verdict in at.get(0, ()) if segment.startswith(start)), best)
            at = at.get(segment)
        found = best or found
        label = next(labels, None)
        node = node.get(label) if label is not None else None
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", most: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: ``host``, ``path``, ``verdict`` ('allow' or 'block'). An entry fits its host and all subdomains if
    the url's path starts with its own. The entry with the most host labels wins, then the longest path, then block.
    Without a fitting entry ``rule`` is null and ``verdict`` is ``default``.

    Up to ``most`` entries the trie is broadcast; beyond, the host suffixes of the different hosts and paths meet
    the entries in a join, with the same result. A null url, or one without ``://``, has empty host and path. Null
    hosts and paths of entries count as empty, entries with a null verdict are left out. Each row is judged by
    itself; existing columns of these four names are replaced.
    """
    host, path = host_and_path(F.col(url))
    own_host, own_path, found = fresh(pages, "own_host", "own_path", "found")
    base = without(pages.withColumns({own_host: host, own_path: path}), "host", "path", "rule", "verdict")
    base = base.withColumnsRenamed({own_host: "host", own_path: "path"})
    entries = rules.where("verdict is not null").select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).distinct()
    few = entries.limit(most + 1).collect()
    if len(few) > most:
        return _joined(base, entries, default)
    known = pages.sparkSession.sparkContext.broadcast(trie([tuple(r) for r in few]))

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        root = known.value
        return pd.DataFrame([longest(root, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    return base.withColumn(found, judged("host", "path")).select(
        *base.columns, F.col(found)["rule"].alias("rule"), F.col(found)["verdict"].alias("verdict"))


def _joined(base: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    places = base.select("host", "path").distinct()
    listed = entries.toDF("rule_host", "rule_path", "rule_verdict")
    fits = places.select("host", "path", F.explode(suffixes).alias("rule_host")).distinct().join(listed, "rule_host").where(
        F.expr("startswith(path, rule_path)"))
    order = F.struct(
        F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))), F.length("rule_path"), F.col("rule_verdict") == "block",
    )
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    (found,) = fresh(base, "found")
    return base.join(best.withColumnRenamed("best", found), ["host", "path"], "left").select(
        *base.columns, F.col(found)["rule"].alias("rule"), F.coalesce(F.col(found)["verdict"], F.lit(default)).alias("verdict"))
