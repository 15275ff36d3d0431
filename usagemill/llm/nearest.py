"""Nearest neighbours by cosine: randomly rotated one-bit codes with error bounds, and reranking of what the bounds leave.

Vectors are brought to length one, padded with zeros and rotated by one random
orthogonal matrix; the signs of the result, packed, are the code. A code's
correction scalar is the inner product of the vector with its code: the product
of query and code, divided by it, estimates the cosine, with an error of about
sqrt(1 - fit^2) / fit / sqrt(bits - 1), of which ``SIGMAS`` are allowed for. Vectors
whose upper bound reaches the best exact cosines that a query has so far are
reranked by the exact measure, so an answer is lost only where an error exceeds
the bound; no number of candidates is fixed.

The index holds each vector beside its code, as one Parquet table in the shared
folder, so reranking needs no shuffle: a task scans its part, keeps the best of
each query, and only these travel. Queries come in blocks of bounded size
(``MAX_BLOCK_BYTES``), broadcast one after the other; equal query vectors are
searched once. Of equal vectors in one batch only as many as can be answers are
compared, those of the smallest ids, so thousands of copies cost no more than a few.

Semantics for odd input: vectors that are null or zero, or hold null, NaN or
infinity, and rows without an id take no part; vectors of different lengths are
never near; a row that repeats an id counts once, by its best vector; as a query
it is answered for its smallest vector (as Spark orders arrays); an empty
table, or one without queries, gives an empty result; further columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, scratch_path

#: Bits of a code, for vectors of fewer dimensions; longer ones get their dimensions, in whole bytes.
BITS = 256
#: Standard errors that the bounds allow for.
SIGMAS = 3.5
#: Bytes of query vectors (as doubles) that are broadcast at once.
MAX_BLOCK_BYTES = 32 << 20
#: Numbers of one array that a task makes at once.
_AT_ONCE = 2_000_000


@lru_cache(maxsize=4)
def rotation(dims: int, bits: int) -> np.ndarray:
    """bits x dims: columns of a random orthogonal matrix, the same in every task."""
    bits = max(bits, -(-dims // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dims])


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors, as doubles, of each length: those that have a direction, scaled by a power of two so that squares stay finite."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        x = np.asarray(vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float).reshape(len(rows), n)
        most = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (most > 0)
        rows, x, most = rows[good], x[good], most[good]
        if len(rows):
            yield rows, np.ldexp(x, -np.frexp(most)[1][:, None])


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """vec_id, vector, code (packed signs) and fit (the correction scalar) of every row that takes part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch.column(1)):
                turn = rotation(x.shape[1], bits)
                for at in range(0, len(rows), step := max(1, _AT_ONCE // len(turn))):
                    r = (x[at : at + step] / np.linalg.norm(x[at : at + step], axis=1, keepdims=True)) @ turn.T
                    fit = np.abs(r).sum(axis=1) / np.sqrt(len(turn))
                    codes = np.packbits(r > 0, axis=1)
                    here = batch.take(pa.array(rows[at : at + step]))
                    yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(fit)], names=["vec_id", "vector", "code", "fit"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return rows.mapInArrow(encode, f"vec_id long, vector {df.schema[vector].dataType.simpleString()}, code binary, fit double")


class Queries:
    """A block of different query vectors of one length, made ready for codes."""

    def __init__(self, first: int, vectors: np.ndarray, bits: int) -> None:
        self.first, self.vectors = first, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.turned = ((vectors / self.norms[:, None]) @ rotation(vectors.shape[1], bits).T).astype(np.float32)


def _exact(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray, norms_b: np.ndarray) -> np.ndarray:
    """Cosines of rows in pairs, in double precision; a pair's does not depend on its neighbours."""
    return (a * b).sum(axis=1) / (norms_a * norms_b)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k different ids by score, the smaller id on a tie."""
    order = np.lexsort((ids, -scores))
    once = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return scores[order][once], ids[order][once]


class Search:
    """The best k of each query of a block among the vectors seen so far."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.q, self.k = queries, k
        n = len(queries.vectors)
        self.scores, self.ids = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf)
        self.compared = 0

    def _rerank(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of queries (in order) and vectors, compared exactly."""
        if not len(rows):
            return
        self.compared += len(rows)
        scores = np.concatenate([_exact(self.q.vectors[rows[i : i + s]], x[cols[i : i + s]], self.q.norms[rows[i : i + s]], norms[cols[i : i + s]]) for s in [max(1, _AT_ONCE // x.shape[1])] for i in range(0, len(rows), s)])
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(at, [*at[1:], len(rows)], strict=True):
            i = rows[a]
            self.scores[i], self.ids[i] = _best(np.concatenate([self.scores[i], scores[a:b]]), np.concatenate([self.ids[i], ids[cols[a:b]]]), self.k)
            if len(self.ids[i]) == self.k:
                self.least[i] = self.scores[i][-1]

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, fit: np.ndarray) -> None:
        # Of equal vectors only the k smallest ids can be answers.
        frame = pd.DataFrame({"v": [v.tobytes() for v in x], "id": ids}).drop_duplicates().sort_values("id", kind="stable")
        keep = frame.index[frame.groupby("v").cumcount() < self.k].to_numpy()
        ids, x, codes, fit = ids[keep], x[keep], codes[keep], fit[keep]
        norms = np.sqrt((x * x).sum(axis=1))
        bits = codes.shape[1] * 8
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        wide = SIGMAS * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(bits - 1) + 1e-5
        for at in range(0, len(self.q.vectors), step := max(1, _AT_ONCE // len(ids))):
            guess = (self.q.turned[at : at + step] @ signs.T) / (fit * np.sqrt(bits))
            # The likeliest ones first: they raise what the others have to reach.
            few = min(2 * self.k, len(ids))
            top = np.argpartition(-guess, few - 1, axis=1)[:, :few]
            rows = np.repeat(np.arange(len(guess)), few)
            hopeful = (guess[rows, top.ravel()] + wide[top.ravel()]) >= self.least[at + rows]
            self._rerank(at + rows[hopeful], top.ravel()[hopeful], x, norms, ids)
            reach = guess + wide >= self.least[at : at + step, None]
            reach[rows[hopeful], top.ravel()[hopeful]] = False
            rows, cols = np.nonzero(reach)
            self._rerank(at + rows, cols, x, norms, ids)

    def found(self) -> pa.RecordBatch:
        sizes = [len(i) for i in self.ids]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.q.first + np.arange(len(sizes)), sizes), pa.int64()), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*self.scores, np.zeros(0)]), pa.float64())],
            names=["q", "vec_id", "score"],
        )


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    """Queries (vec_id, vector) in blocks of bounded bytes, equal vectors one after the other."""
    block, size = [], 0
    for row in queries.orderBy("vector", "vec_id").toLocalIterator(prefetchPartitions=False):
        if block and size + 8 * len(row["vector"]) > MAX_BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["vec_id"], row["vector"]))
        size += 8 * len(row["vector"])
    if block:
        yield block


def nearest(df: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows of each row for which ``asks`` (over vec_id) is true, but for its own id."""
    spark = df.sparkSession
    path, out = scratch_path(spark, "codes"), scratch_path(spark, "nearest")
    build_index(df, key, vector, bits).write.parquet(path)
    index = spark.read.parquet(path)
    asked = index.where(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    kind = "query_id long, rank int, vec_id long, score double"
    spark.createDataFrame([], kind).write.parquet(out)
    for block in _blocks(asked):
        found = _search(index, block, k, bits)
        found.write.mode("append").parquet(out)
    remove(spark, path)
    return spark.read.schema(kind).parquet(out)


def _search(index: DataFrame, block: list[tuple[int, list[float]]], k: int, bits: int) -> DataFrame:
    spark = index.sparkSession
    same: dict[tuple, int] = {}
    of = [(same.setdefault(tuple(v), len(same)), i) for i, v in block]
    by: list[Queries] = []
    numbers: list[int] = []
    for rows, x in _by_length(pa.array([list(v) for v in same], pa.list_(pa.float64()))):
        by.append(Queries(len(numbers), x, bits))
        numbers += rows.tolist()
    place = {n: i for i, n in enumerate(numbers)}
    shared = spark.sparkContext.broadcast(by)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {q.vectors.shape[1]: Search(q, k + 1) for q in shared.value}
        for batch in batches:
            for rows, x in _by_length(batch.column(1)):
                if search := own.get(x.shape[1]):
                    here = batch.take(pa.array(rows))
                    codes = np.frombuffer(b"".join(here.column(2).to_pylist()), np.uint8).reshape(len(rows), -1)
                    search.add(here.column(0).to_numpy(), x, codes, here.column(3).to_numpy())
        for search in own.values():
            yield search.found()

    found = index.mapInArrow(scan, "q long, vec_id long, score double").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    first = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")).cast("int")
    best = found.withColumn("r", first("q", k)).where(F.col("r") <= k + 1).drop("r")
    who = spark.createDataFrame([(place[n], i) for n, i in of], "q long, query_id long")
    told = best.join(F.broadcast(who), "q").where("vec_id != query_id").withColumn("rank", first("query_id", k))
    return told.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
