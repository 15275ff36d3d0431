"""Spelling variants of a corpus' words, by asymmetric q-chunks.

One word of a pair contributes two disjoint chunks, its first and its last
``size div 2`` code points; the other its positional grams of that length. One
edit leaves at least one chunk whole: the first where it stood, the last moved by
the difference of the lengths, which is one at most. So only grams at these
places can meet a chunk, and no others are written. Chunks and grams meet in an
equi-join, and a pair's edit distance decides. The shorter word of a pair gives
the chunks, or the smaller one of equal length, so a pair is met once or twice.

A chunk that many words share is made longer before the join: as the edit lies in
what is left of the word, that is cut into two chunks again, and so on. The last
chunks leave one code point open, so no group can stay large, whatever the words.

Words are counted in each task before they are shuffled. Of all texts the tables
that follow hold the distinct words with enough occurrences only.

Semantics for odd input: a null text has no words, a null id is an empty text;
rows that repeat count each time; texts are read whole; an empty table, or one
whose words are all short or rare, gives an empty result; further columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut

#: Code points and occurrences that a word has at least.
MIN_SIZE, MIN_COUNT = 6, 5
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: One occurrence in so many, by its checksum, loses a code point.
SLIP = 199
#: Words that a task counts before it passes them on.
MAX_HELD = 300_000
#: A chunk that more words share is made longer.
MAX_SHARED = 1_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _as_read(run: str, start: int) -> str:
    """The word that stands for a run in a document; ``start`` is the checksum of its id and a colon."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", min_size: int = MIN_SIZE, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n, its occurrences in all texts, of words with enough of both."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_size},}}")  # a shorter run can't become a longer word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                for doc, t in zip(part.column(0).to_pylist(), texts, strict=True):
                    start = zlib.crc32(f"{doc}:".encode())
                    for run, n in Counter(runs.findall(t.translate(_LOWER).decode())).items():
                        total[_as_read(run, start)] += n
                if len(total) > MAX_HELD:
                    yield told()
                    total.clear()
        yield told()

    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return rows.where(F.length("word") >= min_size).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _pieces(word: Column, size: Column, key: Column, more: int) -> Column:
    """The two chunks of a word of that size, or the grams that meet them in a word longer by ``more``: the key so far with the chunk, and what is left."""
    q, whole = F.floor(size / 2).cast("int"), size + more
    first = F.struct(F.xxhash64(key, F.lit(0), F.substring(word, F.lit(1), q)).alias("key"), F.substring(word, q + 1, whole - q).alias("rest"), (size - q).alias("left"))
    last = F.struct(F.xxhash64(key, F.lit(1), F.substring(word, whole - q + 1, q)).alias("key"), F.substring(word, F.lit(1), whole - q).alias("rest"), (size - q).alias("left"))
    return F.array(first, last)


def near_pairs(words: DataFrame, max_shared: int = MAX_SHARED) -> DataFrame:
    """Pairs (a, b) of distinct words, with n_a and n_b, that one inserted, deleted or replaced code point turns into each other; each pair once, the shorter (or smaller) word as a."""
    size = F.length("word")
    told = lambda more: words.withColumns({"left": size - more, "rest": F.col("word"), "key": (size - more).cast("long"), "more": F.lit(more)})
    side = {"a": told(0), "b": told(0).unionByName(told(1))}
    met = None
    while True:
        longer = {}
        for s, rows in side.items():
            at = [_pieces(F.col("rest"), F.col("left"), F.col("key"), m) for m in (0, 1)]
            longer[s] = rows.select("word", "n", "more", F.explode(F.when(F.col("more") == 0, at[0]).otherwise(at[1])).alias("p")).select("word", "n", "more", "p.*")
        shared = longer["b"].groupBy("key").agg(F.count("*").alias("_n")).where((F.col("_n") > max_shared)).select("key")
        large = cut(shared.join(longer["a"].where("left > 1").select("key").distinct(), "key", "left_semi"))
        again = not large.isEmpty()
        few = {s: rows.join(large, "key", "left_anti") if again else rows for s, rows in longer.items()}
        a, b = (few[s].select("key", F.col("word").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
        found = a.join(b, "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).drop("key")
        met = found if met is None else met.unionByName(found)
        if not again:
            return met.dropDuplicates(["a", "b"])
        side = {s: cut(rows.join(large, "key", "left_semi")) for s, rows in longer.items()}


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps, and counts grow ``TIMES`` fold with each step, so rounds are few."""
    roots = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("_moved")))
    while not roots.where("_moved").isEmpty():
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = cut(roots.select("word", "root").join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
    return roots.select("word", "root")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", min_size: int = MIN_SIZE, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """Per word: form (its most frequent near word, if that has ``times`` its occurrences), root (where forms lead), n, n_near and form_n."""
    words = cut(count_words(df, key, text, min_size, min_count))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(near, "word", "left").withColumn("_of", -F.col("best.less") >= times * F.col("n"))
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_of"), F.col("best.near")).alias("form"), F.when(F.col("_of"), -F.col("best.less")).alias("form_n")))
    out = told.join(_roots(told.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
