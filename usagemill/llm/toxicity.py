"""Toxicity by class-conditional Kneser-Ney models over word pairs, with shared backoff counts.

Each class c, toxic and ordinary, has a model

    P_c(w | v) = kept_c(v, w) / n_c(v) + left_c(v) P_c(w)
    P_c(w)     = (kept_c(w) + (N_c - K_c) shared(w)) / N_c

n_c(v, w) counts the pair in the class's texts and n_c(v) the word as a context.
As in Kneser-Ney models a lower order counts where a word goes on, not how often:
n_c(w) is in how many of the class's texts w stands, N_c their sum. (After how many
different words w stands is worse here: a word that one text repeats is counted
with each of its neighbours.) What a discount takes off the
counts goes to the lower order: left_c(v) is one less what is kept after v, K_c
the sum of kept_c(w), and shared(w), which both classes back off to, is in
proportion to what was discounted of w in both together, half an occurrence at
least. The discount falls with the evidence that the classes differ (``differs``,
the posterior probability of that given the counts in both): kept_c(w) =
differs x n_c(w), so a word found once keeps little of its own and takes most
from the shared counts, and no word is dropped. A pair keeps its counts once the
classes differ after v by more than their words do with a probability of a half,
and backs off whole before. The same fixed discount in both classes does not do
this: as they differ in size, what it takes off their rare words differs too, and
these then outweigh the others.

A text's difference is that of its log-likelihoods, normalised by the number of
its words and by this number's root (by which the difference of ordinary texts of
any length spreads alike); a logistic curve over these two, neither weight below
zero, fitted on held-back labelled rows, gives the score.

What is counted: every word and word pair of all labelled texts but the held-out
rows and the rows of the curve; a word in none of these texts has what both classes share.
Words are known by 64-bit hashes, so two of a billion words or pairs share a
count with a chance of about 3 in 100. Up to MAX_HELD words are read by each
worker from the shared folder, by ``pyarrow.fs``, which must know the store; more
stay a table, partitioned by hash, that the pairs, and the words and pairs of
each text, are joined to. Both ways give the same scores.

Semantics for odd input: null and empty texts get the curve's value at zero
difference; texts are scored whole; repeated rows are scored alike, and counted
as often as they stand; on the curve an id with several texts counts with the
least; without labels of both classes every score is the base rate of the labels
(0 if there are none); an empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fixed_words, positional, scratch_path

#: Share of the words, and of the pairs beyond their words, that the classes are expected to differ in.
DIFFERENT_WORDS, DIFFERENT_PAIRS = 0.01, 1e-6
#: How many occurrences a context's share of the toxic class is smoothed by.
CONTEXT = 10
#: Labelled rows that the logistic curve is fitted on, about, at most; the others of their part are counted.
MAX_CURVE_ROWS = 20_000
#: Words that a worker holds at most (40 bytes each while pairs are judged, then 16); if there are more, pairs and texts are joined to them.
MAX_HELD = 6_000_000
#: Labels are broadcast up to this many rows (16 bytes each); beyond it the join shuffles.
MAX_BROADCAST_LABELS = 4_000_000
_U = np.uint64
#: What stands before the first word of a text; no word is empty.
_START = np.int64(0)
#: Stands for the text as a whole, of which a word is a part.
_TEXT = np.int64(1)
#: Tells the keys of contexts from those of words.
_AS_CONTEXT = np.uint64(0x632BE59BD9B4E019)
_COUNTED = ["c0", "c1", "t0", "t1"]


def part_of(key: Column) -> Column:
    """0 and 1: counting; 3: the curve, and counting beyond its rows; 2: held out."""
    return F.crc32(key.cast("string").cast("binary")) % 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(before.view(_U)) * _U(31) + word.view(_U)).view(np.int64)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and of the words before them; where each text's words end."""
    lists = [fixed_words(t) for t in texts]
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    flat = np.array([w for x in lists for w in x] + [b""], object)[:-1]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ends
    codes, distinct = pd.factorize(flat)
    word = pd.util.hash_array(distinct, categorize=False).view(np.int64)[codes]
    before = np.concatenate(([_START], word[:-1]))
    starts = np.concatenate(([0], ends[:-1]))
    before[starts[starts < len(word)]] = _START
    return word, before, ends


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, four steps further on."""
    z = x + 4.0
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) - np.log(x * (x + 1) * (x + 2) * (x + 3))


def differs(n0: np.ndarray, n1: np.ndarray, odds: np.ndarray | float, expected: float) -> np.ndarray:
    """The probability that the classes differ, given counts in both and the log-odds of the toxic one if they do not.

    Either the counts fall to the toxic class by these odds, or by any share (Beta(1/2, 1/2)); ``expected`` is the second's
    probability before anything was counted.
    """
    share1, share0 = 1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))
    factor = _log_gamma(n1 + 0.5) + _log_gamma(n0 + 0.5) - _log_gamma(n0 + n1 + 1) - np.log(np.pi) - n1 * np.log(share1) - n0 * np.log(share0)
    return 1 / (1 + np.exp(-np.clip(factor + np.log(expected / (1 - expected)), -500, 500)))


def _context_key(word: np.ndarray) -> np.ndarray:
    return _mix(word.view(_U) ^ _AS_CONTEXT).view(np.int64)


@dataclass
class Evidence:
    """By key, sorted: the log-ratio of a word, what a context adds to every word after it, and the log-ratio of a pair that is kept."""

    keys: np.ndarray
    ratios: np.ndarray
    unknown: float  # the log-ratio of a word that only the shared counts speak for

    @classmethod
    def of(cls, keys: np.ndarray, ratios: np.ndarray, unknown: float) -> Evidence:
        order = np.argsort(keys)
        return cls(keys[order], ratios[order], unknown)

    def _ratio(self, keys: np.ndarray, otherwise: float | np.ndarray) -> np.ndarray:
        at = _place(self.keys, keys)
        return np.where(at >= 0, self.ratios[at], otherwise) if len(self.keys) else np.broadcast_to(otherwise, keys.shape).astype(float)

    def differences(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-probability of every word after the one before it."""
        out = self._ratio(word, self.unknown) + self._ratio(_context_key(before), 0.0)
        return self._ratio(_pair_key(before, word), out)

    def features(self, texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), 2))
        word, before, ends = _hashed(texts)
        differences, start = self.differences(word, before), 0
        for i, end in enumerate(ends):
            if end > start:
                d = differences[start:end]
                x[i] = d.mean(), d.sum() / np.sqrt(len(d))
            start = end
        return x


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys are, -1 for none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    distinct, back = np.unique(wanted, return_inverse=True)
    at = np.searchsorted(keys, distinct)
    at[at == len(keys)] = 0
    return np.where(keys[at] == distinct, at, -1)[back]


_NOTHING = Evidence.of(np.zeros(0, np.int64), np.zeros(0), 0.0)


def _files(path: str) -> ds.Dataset:
    system, path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return ds.dataset(path, format="parquet", filesystem=system)


def _sorted(path: str, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Columns of a stored table, sorted by the first; one column at a time, so that little more than the result is held."""
    files, out, order = _files(path), [], None
    for c in columns:
        got = files.to_table(columns=[c], use_threads=False)[c].to_numpy()
        order = np.argsort(got) if order is None else order
        out.append(got[order])
    pa.default_memory_pool().release_unused()
    return tuple(out)


@lru_cache(maxsize=1)
def _read(path: str, unknown: float) -> Evidence:
    """The stored evidence, once for each worker."""
    return Evidence(*_sorted(path, ["k", "x"]), unknown)


@dataclass
class Model:
    """The evidence: none, the path of a stored table (k, x) that workers hold, or such a table that texts are joined to; the curve over the features."""

    evidence: Evidence | str | DataFrame
    curve: np.ndarray  # intercept and a weight for each feature
    range: np.ndarray  # lowest and highest value of each feature that the curve tells apart
    unknown: float = 0.0  # the log-ratio of a word in no labelled text

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + np.clip(x, *self.range) @ self.curve[1:], -30, 30)))


def _labelled(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, chosen: Column) -> DataFrame:
    """Texts with their label (y), of the labelled keys asked for. A key with several labels takes the largest."""
    known = labels.where(F.col(label).isNotNull() & chosen).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    send = F.broadcast if labels.count() <= MAX_BROADCAST_LABELS else lambda df: df
    return documents.select(key, F.col(text).alias("text")).join(send(known), key).select("text", "y")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (w) after others (v) per chunk, and of the texts that hold them (v is _TEXT); each text starts after nothing."""
    for batch in batches:
        for part, texts in chunks(batch):
            toxic = np.array([c == 1 for c in part.column(part.schema.get_field_index("y")).to_pylist()], bool)
            word, before, ends = _hashed(texts)
            of = np.repeat(toxic, np.diff(ends, prepend=0))
            key, at, back = np.unique(_pair_key(before, word), return_index=True, return_inverse=True)
            n1 = np.bincount(back[of], minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(before[at]), pa.array(word[at]), pa.array(np.bincount(back, minlength=len(key)) - n1), pa.array(n1)], names=["v", "w", "n0", "n1"])
            once = pd.DataFrame({"t": np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)), "w": word}).drop_duplicates()
            held, back = np.unique(once["w"].to_numpy(), return_inverse=True)
            n1 = np.bincount(back[toxic[once["t"].to_numpy()]], minlength=len(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), _TEXT)), pa.array(held), pa.array(np.bincount(back, minlength=len(held)) - n1), pa.array(n1)], names=["v", "w", "n0", "n1"])


def for_curve(labels: DataFrame, key: str, label: str) -> Column:
    """Whether a key is one of the curve's: its part's rows, by their hash about MAX_CURVE_ROWS of them where there are more."""
    third = part_of(F.col(key)) == 3
    share = max(1, -(-labels.where(F.col(label).isNotNull() & third).count() // MAX_CURVE_ROWS))
    return third & (F.pmod(F.xxhash64(key), F.lit(share)) == 0)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _discounted(base: float):
    """Adds what each class keeps of a word's texts (k0, k1), and what of both is left to share (s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c0, c1 = _column(b, "c0"), _column(b, "c1")
            kept = differs(c0, c1, base, DIFFERENT_WORDS)
            # A word that only serves as a context (it ends no pair) is none of the models' words.
            rest = np.where(c0 + c1 > 0, np.maximum((1 - kept) * (c0 + c1), 0.5), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, (kept * c0, kept * c1, rest))], names=[*b.schema.names, "k0", "k1", "s"])

    return run


def _kept_pairs(base: float, words_at: str | None):
    """Pairs of which the classes keep their counts, with the word's probabilities and the context's counts.

    The latter are looked up in the stored words, or are columns of the batch if it comes from a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            v, w, n0, n1 = (_column(b, c) for c in ("v", "w", "n0", "n1"))
            if words_at is None:
                told = [_column(b, c) for c in ("p0", "p1", "t0", "t1")]
            else:
                known = known or _sorted(words_at, ["k", "p0", "p1", "t0", "t1"])
                at_w, at_v = _place(known[0], w), _place(known[0], v)
                told = [known[1][at_w], known[2][at_w], known[3][at_v], known[4][at_v]]
            p0, p1, t0, t1 = told
            odds = np.log((t1 + CONTEXT / (1 + np.exp(-base))) / (t0 + CONTEXT / (1 + np.exp(base)))) + np.log(p1 / p0)
            stays = np.flatnonzero(differs(n0, n1, odds, DIFFERENT_PAIRS) >= 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(x[stays]) for x in (v, w, n0, n1, *told)], names=["v", "w", "n0", "n1", "p0", "p1", "t0", "t1"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, w or null, x) under the keys of contexts and pairs."""
    for b in batches:
        v, x = _column(b, "v"), _column(b, "x")
        w = b.column(b.schema.get_field_index("w"))
        alone = np.asarray(w.is_null())
        k = np.where(alone, _context_key(v), _pair_key(v, w.fill_null(0).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x)], names=["k", "x"])


def _stored(spark, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written to the shared folder and read again, and its place: counted once, and safe from lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def fit_models(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Counts and fits everything from the labelled rows that are not held out."""
    spark = documents.sparkSession
    empty = Model(_NOTHING, np.array([-30.0, 0, 0]), np.array([[-np.inf] * 2, [np.inf] * 2]))
    curve = for_curve(labels, key, label)
    rows = _labelled(documents, labels, key, text, label, (part_of(F.col(key)) != 2) & ~curve)
    found, _ = _stored(spark, rows.mapInArrow(_pair_counts, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    pairs = found.where(F.col("v") != int(_TEXT))
    # Texts by word, and totals by first word.
    second = found.where(F.col("v") == int(_TEXT)).select("w", *(F.col(f"n{i}").alias(f"c{i}") for i in (0, 1)))
    first = pairs.groupBy(F.col("v").alias("w")).agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in (0, 1)))
    counted = second.join(first, "w", "full").na.fill(0).select(F.col("w").alias("k"), *(F.col(n).cast("double") for n in _COUNTED))
    counted, _ = _stored(spark, counted, "counts")
    total = counted.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    if not total["c0"] or not total["c1"]:
        share = labels.where(F.col(label).isNotNull() & (part_of(F.col(key)) != 2)).agg(F.avg(F.col(label).cast("double"))).first()[0]
        if share is not None:
            share = min(max(share, 1e-12), 1 - 1e-12)
            empty.curve[0] = np.log(share / (1 - share))
        return empty
    base = float(np.log(total["c1"] / total["c0"]))
    words = counted.mapInArrow(_discounted(base), "k long, " + ", ".join(f"{c} double" for c in (*_COUNTED, "k0", "k1", "s")))
    kept = words.agg(*(F.sum(c).alias(c) for c in ("k0", "k1", "s")), F.count("*").alias("n")).first()
    p = [(F.col(f"k{c}") + (total[f"c{c}"] - kept[f"k{c}"]) * F.col("s") / kept["s"]) / total[f"c{c}"] for c in (0, 1)]
    words, words_at = _stored(spark, words.select("k", p[0].alias("p0"), p[1].alias("p1"), "t0", "t1"), "words")
    held = kept["n"] <= MAX_HELD
    if held:
        judged = pairs
    else:
        judged = pairs.join(words.select(F.col("k").alias("w"), "p0", "p1"), "w").join(words.select(F.col("k").alias("v"), "t0", "t1"), "v").select("v", "w", "n0", "n1", "p0", "p1", "t0", "t1")
    stay, _ = _stored(spark, judged.mapInArrow(_kept_pairs(base, words_at if held else None), "v long, w long, n0 long, n1 long, p0 double, p1 double, t0 double, t1 double"), "kept")
    # What is left to the words after a context; a class that never has the context leaves all.
    share = [F.when(F.col(f"t{c}") > 0, F.col(f"n{c}") / F.col(f"t{c}")).otherwise(0.0) for c in (0, 1)]
    left = stay.groupBy("v").agg(*(F.greatest(1 - F.sum(share[c]), F.lit(0.0)).alias(f"l{c}") for c in (0, 1)))
    # Where nothing is left, and so the ratio would not be finite, half an occurrence is.
    half = [F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"l{c}"), 0.5 / F.col(f"t{c}"))).otherwise(F.col(f"l{c}")).alias(f"l{c}") for c in (0, 1)]
    left = left.join(stay.groupBy("v").agg(F.max("t0").alias("t0"), F.max("t1").alias("t1")), "v").select("v", *half)
    after = stay.join(left, "v").select("v", "w", F.log((share[1] + F.col("l1") * F.col("p1")) / (share[0] + F.col("l0") * F.col("p0"))).alias("x"))
    named = after.unionByName(left.select("v", F.lit(None).cast("long").alias("w"), F.log(F.col("l1") / F.col("l0")).alias("x")))
    # A word that ends no pair is known as a context only.
    ratios = words.where("p0 > 0 AND p1 > 0").select("k", F.log(F.col("p1") / F.col("p0")).alias("x")).unionByName(named.mapInArrow(_keyed, "k long, x double"))
    evidence, at = _stored(spark, ratios, "ratios")
    model = Model(at if held else evidence, empty.curve, empty.range, float(np.log((1 - kept["k1"] / total["c1"]) / (1 - kept["k0"] / total["c0"]))))
    model.curve, model.range = _fit_curve(model, documents, labels, key, text, label, curve)
    return model


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the different words, contexts and pairs of each text."""
    for batch in batches:
        for part, texts in chunks(batch, "_t"):
            word, before, ends = _hashed(texts)
            context, pair, ids, start = _context_key(before), _pair_key(before, word), part.column(part.schema.get_field_index("_r")).to_pylist(), 0
            for r, end in zip(ids, ends, strict=True):
                k = np.unique(np.concatenate((word[start:end], context[start:end], pair[start:end])))
                start = end
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r)), pa.array(k)], names=["r", "k"])


def _with_features(rows: DataFrame, model: Model, text: str, made: str, make) -> DataFrame:
    """``make(part, features)`` for all rows, by the evidence a worker holds or by a join of every text's words and pairs to its table."""
    at, unknown = model.evidence, model.unknown
    if not isinstance(at, DataFrame):

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            evidence = at if isinstance(at, Evidence) else _read(at, unknown)
            for batch in batches:
                for part, texts in chunks(batch, text):
                    yield make(part, evidence.features(texts))

        return rows.mapInArrow(read, made)

    # Equal texts want the same, so they are known by their hash; should two others share it, each finds its own among what both want.
    r = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    wanted = rows.select(r.alias("_r"), F.col(text).alias("_t")).mapInArrow(_wanted, "r long, k long")
    found = wanted.join(at.hint("shuffle_hash"), "k").groupBy(F.col("r").alias("_r")).agg(F.collect_set(F.struct("k", "x")).alias("_found"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(batch.schema.get_field_index("_found"))
            for i in range(batch.num_rows):
                f = got.slice(i, 1).flatten()
                evidence = Evidence.of(f.field(0).to_numpy(zero_copy_only=False), f.field(1).to_numpy(zero_copy_only=False), unknown)
                for part, texts in chunks(batch.slice(i, 1), text):
                    yield make(part, evidence.features(texts))

    return rows.withColumn("_r", r).join(found, "_r", "left").mapInArrow(judge, made)


def _fit_curve(model: Model, documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, curve: Column) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic regression, by Newton's method, on about MAX_CURVE_ROWS labelled rows at most that were not counted."""
    chosen = labels.where(F.col(label).isNotNull() & curve).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = documents.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text").alias("text"), F.max("y").alias("y"))
    make = lambda part, x: pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")).cast(pa.float64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])
    got = _with_features(rows, model, "text", "y double, x array<double>", make).toArrow()
    y = got.column("y").to_numpy() if got.num_rows else np.zeros(0)
    if len(y) < 20 or y.min() == y.max():
        return np.array([-1.5, 4.0, 4.0]), model.range
    raw = np.array(got.column("x").to_pylist())
    ends = np.quantile(raw, [0.01, 0.99], axis=0)  # odd texts reach far and would flatten the curve
    x = np.column_stack([np.ones(len(y)), np.clip(raw, *ends)])
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, used = x / scale, [0, 1, 2]
    while True:
        w = np.zeros(3)
        w[used] = _logistic(z[:, used], y)
        if not (below := [i for i in used[1:] if w[i] < 0]):
            break
        # More of the toxic model's likelihood never lowers the score: the weight that falls furthest below is zero.
        used.remove(min(below, key=lambda i: w[i]))
    return w / scale, ends


def _logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method; the first column is the intercept."""
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[1] * (z.shape[1] - 1)]) * 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Per row: key, ``keep`` (and the text if asked for), log_ratio (per word), score and predicted."""
    rows = documents.select(key, text, *keep)
    kept = [key, *keep, *([text] if keep_text else [])]
    curve = Model(_NOTHING, model.curve, model.range)

    def judged(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        s = curve.scores(x)
        return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in kept), pa.array(x[:, 0]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "log_ratio", "score", "predicted"])

    return _with_features(rows, model, text, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "log_ratio double, score double, predicted int"]), judged)


def drop_toxic(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    rows, (k, t), names = positional(documents, key, text)
    scored = score_toxicity(rows, model, k, t, threshold, keep=tuple(n for n in names if n not in (k, t)), keep_text=True)
    return scored.where("predicted = 0").select(*names).toDF(*documents.columns)
