"""Phrase collocations of each language, by prefix-free parsing.

A text's pieces (between marks and line ends) are cut where a window of three
words triggers, by its hash, into chunks that overlap by these three words; the
parse depends on content alone, so copies of a passage give equal chunks. Spark
counts the distinct chunks: the dictionary, with parse frequencies. Phrases are
then counted inside distinct chunks, times their frequency. A phrase of up to
four words belongs to the chunk in which it begins before the overlap (``owned``
begins), so what overlaps counts once.

Words and pairs are counted first. Longer phrases can only be frequent where all
their pairs are, so a bitmap of the frequent pairs' hashes (``FILTER_BITS``, a
fixed size) keeps the rest of the longer phrases from being shuffled; a false
positive costs a row and is dropped with its count. Counts of parts come from
these tables too, as a part of a frequent phrase is frequent itself.

Semantics for odd input: a null text is empty and a null language is ``und``; texts
without words count nothing; rows that repeat count each time; texts are read
whole, and a piece without triggers is one chunk; an empty table gives an empty
result; further columns are not read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, scratch_path

#: Words of a phrase at most, its occurrences at least, and phrases a language.
MAX_WORDS, MIN_COUNT, MOST = 4, 30, 2_000
#: Words that overlapping chunks share, which is also the width of the windows that trigger: one in so many does.
OVERLAP, ONE_IN = MAX_WORDS - 1, 64
#: Words of chunks that a task counts before it passes the counts on.
MAX_HELD = 4_000_000
#: Different words that a task numbers at once.
MAX_WORDS_HELD = 500_000
#: Bits of the bitmap of frequent pairs: 16 MB.
FILTER_BITS = 1 << 27

_MARKS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers for words, given on first sight, with the words' own hashes and lengths; the empty word is 0 and a line end 1."""

    def __init__(self) -> None:
        self._hashes, self._sizes = array("Q"), array("q")
        self.of([b"", b"\n"])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self._hashes.append(xxhash.xxh64_intdigest(word))
        self._sizes.append(len(word))
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def hashes(self) -> np.ndarray:
        return np.array(self._hashes)

    @property
    def sizes(self) -> np.ndarray:
        return np.array(self._sizes)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * _ODD + b) * _ODD
    return h ^ (h >> np.uint64(31))


def pair_places(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places in the bitmap of pairs of words, from their hashes."""
    return (_mix(words, others) >> np.uint64(20)) % np.uint64(FILTER_BITS)


def parse(texts: list[bytes], known: _Words, one_in: int = ONE_IN) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Chunks of texts: the text's place, the words joined by spaces, and how many of them begin phrases of the chunk."""
    pieces = [t.translate(_MARKS) for t in texts]
    of = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in pieces])
    data = b"\n".join(pieces).replace(b"\n", b" \n ")
    ids = known.of(data.split(b" "))
    sizes = known.sizes[ids]
    at = np.cumsum(sizes + 1) - sizes - 1
    piece = np.cumsum(ids == 1)
    words = ids > 1
    ids, at, sizes, piece = ids[words], at[words], sizes[words], piece[words]
    n = len(ids)
    if not n:
        return of[:0], [], of[:0]
    begins = np.flatnonzero(np.diff(piece, prepend=-1))
    last = np.repeat(np.append(begins[1:], n), np.diff(begins, append=n))
    triggers = np.zeros(n, bool)
    if n >= OVERLAP:
        h = known.hashes[ids]
        window = h[: n - OVERLAP + 1]
        for i in range(1, OVERLAP):
            window = _mix(window, h[i : n - OVERLAP + 1 + i])
        triggers[: len(window)] = (window >> np.uint64(40)) % np.uint64(one_in) == 0
    # A window that reaches past its piece is none.
    triggers &= np.arange(n) + OVERLAP <= last
    triggers[begins] = True
    starts = np.flatnonzero(triggers)
    owned = np.diff(starts, append=n)
    stops = np.minimum(starts + owned + OVERLAP, last[starts])
    low, high = at[starts], at[stops - 1] + sizes[stops - 1]
    total = np.cumsum(sizes + 1)
    spaced = high - low + 1 != total[stops - 1] - total[starts] + sizes[starts] + 1  # more than one space between words
    chunk = [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    for i in np.flatnonzero(spaced):
        chunk[i] = b" ".join(chunk[i].split())
    return of[piece[starts]], chunk, owned


def chunk_dictionary(df: DataFrame, lang: str = "lang", text: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """The distinct chunks of each language: chunk, owned, and weight, how often the parses have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                of, words, owned = parse(texts, known, one_in)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(owned.astype(np.int32))], names=["lang", "chunk", "owned"])
                if len(known) > MAX_WORDS_HELD:
                    known = _Words()

    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t")).mapInArrow(cut, "lang string, chunk string, owned int")
    return rows.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("weight"))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the exact sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(weights, at)


class _Held:
    """Chunks of a task, as numbers of words, until there are enough to count."""

    def __init__(self) -> None:
        self.words: dict[str, _Words] = {}
        self.parts: dict[str, list[tuple[np.ndarray, ...]]] = {}
        self.n = 0

    def add(self, lang: str, chunk: pa.Array, owned: np.ndarray, weight: np.ndarray) -> None:
        words = self.words.setdefault(lang, _Words())
        data = pc.binary_join(pa.ListArray.from_arrays([0, len(chunk)], chunk), b" \n ")[0].as_py()
        ids = words.of(data.split(b" "))
        ends = np.append(np.flatnonzero(ids == 1), len(ids))
        sizes = np.diff(ends, prepend=-1) - 1
        self.parts.setdefault(lang, []).append((ids[ids > 1], sizes, owned, weight))
        self.n += len(ids)

    def counted(self, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Counts of words and pairs; with the bitmap of frequent pairs, of phrases of three and four words all of whose pairs are in it."""
        for lang, parts in self.parts.items():
            ids, sizes, owned, weight = (np.concatenate([p[i] for p in parts]) for i in range(4))
            words = pa.array(list(self.words[lang]), pa.binary())
            ends = np.cumsum(sizes)
            place = np.arange(len(ids))
            left = np.repeat(ends, sizes) - place  # words from here to the chunk's end
            own = place < np.repeat(ends - sizes + owned, sizes)
            weights = np.repeat(weight, sizes)
            word = lambda k, words=words: words.take(pa.array(k))
            two = lambda k, word=word: pc.binary_join_element_wise(word(k >> 32), word(k & 0xFFFFFFFF), b" ")
            if frequent is None:
                n = np.zeros(len(words), np.int64)
                np.add.at(n, ids[own], weights[own])
                some = np.flatnonzero(n)
                yield from _told(lang, 1, some, n[some], word)
                some = np.flatnonzero(own & (left > 1))
                yield from _told(lang, 2, *_summed((ids[some] << 32) | ids[some + 1], weights[some]), two)
                continue
            h = self.words[lang].hashes[ids]
            bits = pair_places(h[:-1], h[1:])
            good = np.zeros(len(ids) + 2, bool)
            good[: len(bits)] = (frequent[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1
            some = np.flatnonzero(own & (left > 2) & good[:-2] & good[1:-1])
            # Pairs that begin here or two words on, as numbers.
            four = (left[some] > 3) & good[some + 2]
            pair = (ids[some] << 32) | ids[some + 1]
            rest = (ids[some[four] + 2] << 32) | ids[some[four] + 3]
            pairs, number = np.unique(np.concatenate([pair, rest]), return_inverse=True)
            first, last = number[: len(pair)], number[len(pair) :]
            pair_of = lambda k, pairs=pairs, two=two: two(pairs[k])
            yield from _told(lang, 3, *_summed((first << 32) | ids[some + 2], weights[some]), lambda k, p=pair_of, w=word: pc.binary_join_element_wise(p(k >> 32), w(k & 0xFFFFFFFF), b" "))
            yield from _told(lang, 4, *_summed((first[four] << 32) | last, weights[some[four]]), lambda k, p=pair_of: pc.binary_join_element_wise(p(k >> 32), p(k & 0xFFFFFFFF), b" "))
        self.__init__()


def _told(lang: str, size: int, keys: np.ndarray, sums: np.ndarray, phrase) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 500_000):
        k = keys[at : at + 500_000]
        yield pa.RecordBatch.from_arrays(
            [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(k), np.int8)), pa.array([lang])).cast(pa.string()), pa.array(np.full(len(k), size, np.int32)), phrase(k).cast(pa.string()), pa.array(sums[at : at + 500_000])],
            names=["lang", "size", "phrase", "f"],
        )


def count_phrases(dictionary: DataFrame, min_count: int, frequent: np.ndarray | None = None) -> DataFrame:
    """lang, size, phrase and f of words and pairs with enough occurrences; with the bitmap of frequent pairs, of phrases of three and four words."""
    shared = dictionary.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            where: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                where.setdefault(lang, []).append(i)
            for lang, rows in where.items():
                part = batch.take(pa.array(rows))
                held.add(lang, part.column(1).cast(pa.binary()), part.column(2).to_numpy(), part.column(3).to_numpy())
            if held.n >= MAX_HELD:
                yield from held.counted(shared.value)
        yield from held.counted(shared.value)

    rows = dictionary.select("lang", "chunk", "owned", "weight").mapInArrow(count, "lang string, size int, phrase string, f long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """The bitmap of pairs, put together where they are; of its fixed size, whatever their number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [p.split(b" ") for p in batch.column(0).cast(pa.binary()).to_pylist()]
            h = np.array([[xxhash.xxh64_intdigest(a), xxhash.xxh64_intdigest(b)] for a, b in words], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair_places(h[:, 0], h[:, 1]).astype(np.int64))], names=["at"])

    at = pairs.select("phrase").mapInArrow(places, "at long")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[(row["b"] - 1) * len(part) :][: len(part)] = part
    return out


def _words(phrase: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def _big(x: Column | str) -> Column:
    """Products of counts may pass 64 bits."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(25,0)")


def phrase_collocations(df: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, most: int = MOST, one_in: int = ONE_IN) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a (its count), l and r (of the parts at the weakest cut), n (the language's words), score."""
    spark = df.sparkSession
    path = scratch_path(spark, "chunks")
    chunk_dictionary(df, lang, text, one_in).write.parquet(path)
    dictionary = spark.read.parquet(path)
    counts = scratch_path(spark, "phrases")
    count_phrases(dictionary, min_count).write.parquet(counts)
    frequent = pair_bitmap(spark.read.parquet(counts).where("size = 2"))
    count_phrases(dictionary, min_count, frequent).write.mode("append").parquet(counts)
    told = spark.read.parquet(counts)

    f = lambda phrase, n: told.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(n))
    phrases = told.where("size > 1")
    at = phrases.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = at.select("*", _words(F.col("phrase"), F.lit(1), F.col("k")).alias("_first"), _words(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"))
    parts = parts.join(f("_first", "l"), ["lang", "_first"]).join(f("_rest", "r"), ["lang", "_rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(25,0))) div (cast(l as decimal(25,0)) + cast(r as decimal(25,0)))")
    weakest = parts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda s: F.struct(s.alias("s"), n.alias("n")))))
    inside = told.where("size > 2").select("lang", "phrase", "f", F.explode(spans).alias("p"))
    inside = inside.select("lang", _words(F.col("phrase"), F.col("p.s"), F.col("p.n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_big("longer") * 100 < _big("a") * 80))

    n = dictionary.groupBy("lang").agg(F.sum(F.col("weight") * F.col("owned")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("w.score").desc(), F.col("a").desc(), "phrase"))
    first = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return first.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
