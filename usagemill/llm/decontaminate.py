"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits, span or document removal.

Every benchmark item of 13 words or more gives all its windows of 13 words; a
shorter one is a single window. The windows' hashes are built and sorted once, on
the driver, and broadcast as arrays, beside the benchmark's words as one string.
A document's windows are looked up by hash, and each hit is compared word by word.

A benchmark whose arrays would take more than MAX_SET_BYTES is cut into blocks.
Each block is one pass over the documents, from which only the finds come back,
by the text's MD5 sum; the last pass joins them to the texts.

Semantics for odd input: null and empty texts have no words, hit nothing and
stay; an item without words is no window; repeated items and repeated rows each
count as they stand (an item_id counts once per document); an empty benchmark
contaminates nothing; texts are scanned whole. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, fixed_words, positional

WINDOW = 13
#: Bytes of the arrays of one broadcast, at most (a single longer item goes alone).
MAX_SET_BYTES = 96 << 20
#: Finds of several blocks that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20
#: Words that a task remembers hashes for.
MAX_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table that tells at once that most windows are not in the set.
_SIEVE = 20


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` words, from theirs."""
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _BASE + words[i : i + n]
    return out ^ (out >> np.uint64(29))


def bytes_of(text: int, words: int) -> int:
    """What the arrays of an item take: its words, where each begins, and 16 bytes a window."""
    return text + 20 * words


@dataclass
class WindowSet:
    """The windows of a block of benchmark items, by width: sorted hashes, where each begins among all words, and its item."""

    words: bytes  # of all items, with a space after each
    starts: np.ndarray  # of every word, and the end
    names: list[str]
    widths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # hashes, first words, items, sieve

    @staticmethod
    def build(items: list[tuple[str, bytes]]) -> WindowSet:
        hashes = _WordHashes()
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        names, texts, sizes, at = [], [], [np.zeros(1, np.int64)], 0
        for item, text in items:
            words = fixed_words(text)
            if not words:
                continue
            width = min(WINDOW, len(words))
            keys = _hashes(hashes.of(words), width)
            found.setdefault(width, []).append((keys, np.arange(at, at + len(keys), dtype=np.int32), np.full(len(keys), len(names), np.int32)))
            names.append(item)
            texts.append(b" ".join(words) + b" ")
            sizes.append(np.array([len(w) + 1 for w in words], np.int64))
            at += len(words)
        widths = {}
        for width, parts in found.items():
            keys, first, item = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[(keys >> np.uint64(64 - _SIEVE)).astype(np.int64)] = True
            widths[width] = keys[order], first[order], item[order], sieve
        return WindowSet(b"".join(texts), np.cumsum(np.concatenate(sizes)).astype(np.int32 if sum(map(len, texts)) < 1 << 31 else np.int64), names, widths)

    def scan(self, words: list[bytes], hashes: _WordHashes) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        if not n or not self.widths:
            return hit, items
        own = hashes.of(words)
        for width, (keys, first, item, sieve) in self.widths.items():
            if n < width:
                continue
            wanted = _hashes(own, width)
            some = np.flatnonzero(sieve[(wanted >> np.uint64(64 - _SIEVE)).astype(np.int64)])
            low, high = np.searchsorted(keys, wanted[some]), np.searchsorted(keys, wanted[some], side="right")
            for s, a, b in zip(some[high > low], low[high > low], high[high > low], strict=True):
                window = b" ".join(words[s : s + width]) + b" "
                for k in range(a, b):  # windows of one hash stand together
                    if self.words[self.starts[first[k]] : self.starts[first[k] + width]] == window:
                        hit[s : s + width] = True
                        items.add(self.names[item[k]])
        return hit, items


def _blocks(benchmark: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks whose arrays take at most ``most`` bytes (a single longer item is a block of its own)."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").orderBy("k", "t").toLocalIterator():
        data = row["t"].encode()
        own = bytes_of(len(data), len(fixed_words(data)))
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append((str(row["k"]), data))
        size += own
    yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), keep_text: bool = False, set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """Per row: key, ``keep`` (and the text if asked for), n_words, n_hit, hit_runs (first word and end of each run of hit words), items, n_items, items_sha256, contaminated.

    One pass over the documents, and one more for each block of the benchmark beyond the first.
    """
    share = documents.sparkSession.sparkContext.broadcast
    rows, finds = documents.select(key, text, *keep), []
    blocks = _blocks(benchmark, item, item_text, set_bytes)
    block = next(blocks)
    while (after := next(blocks, None)) is not None:
        texts = rows.select(F.col(text).alias("text")).where("text IS NOT NULL").withColumn("sum", F.unhex(F.md5("text")))
        finds.append(cut(texts.mapInArrow(_finder(share(WindowSet.build(block))), "sum binary, runs array<array<long>>, items array<string>").dropDuplicates(["sum"])))
        block = after
    if finds:
        several = reduce(DataFrame.unionByName, finds).groupBy("sum").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.flatten(F.collect_list("items")).alias("_items"))
        several = cut(several)
        size = several.agg(F.sum(40 + 20 * F.size("_runs") + F.length(F.concat_ws(",", "_items")))).first()[0] or 0
        rows = rows.withColumn("_sum", F.unhex(F.md5(F.col(text)))).join(F.broadcast(several) if size <= MAX_BROADCAST_BYTES else several, F.col("_sum") == F.col("sum"), "left").drop("_sum", "sum")
    else:
        rows = rows.withColumns({"_runs": F.expr("cast(array() AS array<array<long>>)"), "_items": F.expr("cast(array() AS array<string>)")})
    kept = [key, *keep, *([text] if keep_text else [])]
    named = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)]
    schema = ", ".join([*named, "n_words long, n_hit long, hit_runs array<array<long>>, items array<string>, n_items long, items_sha256 string, contaminated boolean"])
    return rows.mapInArrow(_scanner(share(WindowSet.build(block)), text, kept), schema)


def _runs(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))) if hit.any() else np.zeros(0, np.int64)
    return edges.reshape(-1, 2).tolist()


def _finder(shared: Broadcast):
    """The finds of a block, of the texts that have any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, hashes = shared.value, _WordHashes()
        for batch in batches:
            for part, texts in chunks(batch):
                out = []
                for t, md5 in zip(texts, part.column(1).to_pylist(), strict=True):
                    hit, items = windows.scan(fixed_words(t), hashes)
                    if items:
                        out.append((md5, _runs(hit), sorted(items)))
                kinds = (pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["sum", "runs", "items"])

    return find


def _scanner(shared: Broadcast, text: str, out: list[str]):
    """Scans for the last block, and puts the finds of the others to its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, hashes = shared.value, _WordHashes()
        for batch in batches:
            for part, texts in chunks(batch, text):
                field = part.schema.get_field_index
                runs, items, sizes, hits = [], [], [], []
                for t, old_runs, old_items in zip(texts, part.column(field("_runs")).to_pylist(), part.column(field("_items")).to_pylist(), strict=True):
                    words = fixed_words(t)
                    hit, found = windows.scan(words, hashes)
                    for a, b in old_runs or ():
                        hit[a:b] = True
                    found.update(old_items or ())
                    runs.append(_runs(hit))
                    items.append(sorted(found))
                    sizes.append(len(words))
                    hits.append(int(hit.sum()))
                columns = {n: part.column(field(n)) for n in out} | {
                    "n_words": pa.array(sizes, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "hit_runs": pa.array(runs, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string())), "n_items": pa.array(map(len, items), pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hits, sizes, strict=True)], pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    rows, (k, t), names = positional(documents, key, text)
    found = find_contamination(rows, benchmark, k, t, keep=tuple(n for n in names if n not in (k, t)), keep_text=True)
    return found.where("NOT contaminated").select(*names).toDF(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every run of hit words cut out of the text, from its first word's start to its last word's end."""
    rows, (k, t), names = positional(documents, key, text)
    found = find_contamination(rows, benchmark, k, t, keep=tuple(n for n in names if n not in (k, t)), keep_text=True)
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, t):
                field, done = part.schema.get_field_index, []
                for x, null, runs in zip(texts, part.column(field(t)).is_null().to_pylist(), part.column(field("hit_runs")).to_pylist(), strict=True):
                    if runs:
                        spans, left, at = [m.span() for m in word.finditer(x)], [], 0
                        for a, b in runs:
                            left.append(x[at : spans[a][0]])
                            at = spans[b - 1][1]
                        x = b"".join([*left, x[at:]])
                    done.append(None if null else x.decode())
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if n == t else part.column(field(n)) for n in names], names=names)

    return found.mapInArrow(strip, rows.schema).toDF(*documents.columns)
