"""URL filter: a trie over reversed host labels and path segments; of the rules that fit, the longest one (host and path together) holds, the one of the deeper host on a tie.

Semantics for odd input: a null url, or one without ``://``, has an empty host
and path and no rule fits it; an empty table gives an empty result; repeated
rows are judged alike; among rules of equal host and path the last one given
holds. Only the columns named are read, so further columns may clash freely.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A trie of at most this many rules is broadcast; more are joined instead.
MAX_BROADCAST_RULES = 200_000
#: Places that the pages of one host are dealt to where rules are joined.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(verdict: str, rule: str) -> Rule:
        """``example.org/en/`` gives host ``example.org`` and path ``/en/``."""
        host, slash, path = rule.partition("/")
        return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


class Trie:
    """Nodes are dicts; host labels from the last one come first, then the path's segments.

    A rule path need not end at a segment: its last piece is a prefix of the
    segment it meets, kept in the node's tails, which are looked up by the
    lengths that there are, the longest first.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *segments, tail = rule.path.split("/")
            for s in segments:
                node = node.setdefault("segments", {}).setdefault(s, {})
            node.setdefault("tails", {})[tail] = (rule.host + rule.path, rule.verdict)
            node.setdefault("lengths", set()).add(len(tail))
        self._sort(self.root)

    @staticmethod
    def _sort(root: dict) -> None:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            node["lengths"] = sorted(node.get("lengths", ()), reverse=True)
            waiting += [*node.get("labels", {}).values(), *node.get("segments", {}).values()]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, that of the deepest host among those of one length."""
        if not host:
            return None
        best, node, pieces = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = self._path(node, pieces)
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best

    @staticmethod
    def _path(node: dict, pieces: list[str]) -> tuple[str, str] | None:
        best = None
        for i, piece in enumerate(pieces):
            for n in node["lengths"]:
                if n <= len(piece) and (fit := node["tails"].get(piece[:n])):
                    best = fit
                    break
            node = node.get("segments", {}).get(piece) if i + 1 < len(pieces) else None
            if node is None:
                break
        return best


def judge_urls(df: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row: key, host, path, the rule that decides (null if none fits) and its verdict, else ``default``.

    Up to MAX_BROADCAST_RULES rules go out as one broadcast trie; beyond that the
    rules become a table which is joined on the host suffixes of each url.
    """
    parts = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(rules) > MAX_BROADCAST_RULES:
        return _judge_by_join(parts, rules, key, default)
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            found = [trie.find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(parts: DataFrame, rules: list[Rule], key: str, default: str) -> DataFrame:
    """The same judgement for rule sets too large to broadcast: host suffixes meet the rules in an equi-join."""
    spark = parts.sparkSession
    table = spark.createDataFrame([(i, r.verdict, r.host, r.path) for i, r in enumerate(rules)], "n long, r_verdict string, r_host string, r_path string")
    rows = cut(parts.withColumn("_row", F.monotonically_increasing_id()))
    hosts = rows.select("host").distinct().withColumn("_labels", F.split("host", r"\."))
    suffixes = hosts.select("host", F.explode(F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")).alias("r_host"))
    near = suffixes.where("host != ''").join(table, "r_host")
    # The pages of one host are dealt out to SALTS places, and its rules to each of them.
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fit = rows.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(SALTS))).join(near, ["host", "_salt"]).where(F.expr("startswith(path, r_path)"))
    depth = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("n"))
    best = fit.groupBy("_row").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), depth).alias("b"))
    out = rows.join(best, "_row", "left")
    return out.select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.r_verdict", F.lit(default)).alias("verdict"))
