"""Quality rules: document statistics, a hard base rule, and boosted trees with monotonic constraints.

Semantics for odd input: a null or empty text has no words, fails the base rule
and is not kept; very long texts are read whole; repeated rows are judged
alike; an empty table gives an empty result; labels that are null, or of
documents that are not there, do not count; of a labelled id with several texts
the least is learnt from. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, fit
from .common import WordIds, chunks

#: Labelled rows that the trees are fitted on, at most; taken by the hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Words that a task remembers numbers for.
MAX_WORD_IDS = 400_000
WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_BLANK = b" \t\n\x0b\x0c\r"

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees and the direction in which each may move the score.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "words_per_line": 0, "distinct_word_share": 0, "stop_share": 0, "digit_share": 0, "upper_share": 0, "ends_with_mark": 0,
}


def _scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of five which is found twice or more, the first one included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = _scramble(ids.astype(np.uint64) + np.uint64(1))
    key = sum((mixed[i : i + n] * _MIX[i] for i in range(WINDOW)), np.zeros(n, np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    # Equal hashes are taken at their words: windows of one hash stand together.
    for i in range(WINDOW):
        same &= ids[order[1:] + i] == ids[order[:-1] + i]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(texts: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The counts of STATISTICS and the values of FEATURES, a row for each text."""
    counts, features = np.zeros((len(texts), len(STATISTICS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if n == 0:
            continue
        if len(ids) > MAX_WORD_IDS:
            ids.clear()
        numbers = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        packed = t.translate(None, _BLANK)
        chars = len(packed) if packed.isascii() else len(packed.decode())
        symbols = len(t) - len(t.translate(None, b"#*$%&|<>"))
        lines = [x for x in t.split(b"\n") if x and x.strip(_BLANK)]
        dup = len(lines) - len(set(lines))
        repeat = repeated_words(numbers)
        counts[i] = n, chars, symbols, dup, repeat
        features[i] = (
            np.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, n / len(lines), len(set(words)) / n,
            len([w for w in words if len(w) <= 3]) / n, (len(t) - len(t.translate(None, b"0123456789"))) / chars,
            (len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / chars, float(t.rstrip(_BLANK)[-1:] in (b".", b"!", b"?")),
        )
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def fit_quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAINING_ROWS) -> BoostedTrees:
    """Trees fitted on at most ``most`` labelled documents, those of the least hashes of their ids."""
    known = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(most)
    rows = documents.select(key, text).join(F.broadcast(chosen), key)  # bounded by ``most``

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for part, texts in chunks(batch, text):
                _, f = statistics(texts, ids)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")).cast(pa.float64()), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["y", "f"])

    # A key with many rows could bring more than ``most`` rows back; one row of each counts.
    got = rows.groupBy(key).agg(F.min(text).alias(text), F.max("y").alias("y")).mapInArrow(read, "y double, f array<double>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got.column("f").to_pylist()), got.column("y").to_numpy()
    return fit(x, y, monotone=list(FEATURES.values()))


def judge_quality(documents: DataFrame, model: BoostedTrees, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: key, STATISTICS, base_failed, quality_score (the trees' probability) and kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, ids = shared.value, WordIds()
        for batch in batches:
            for part, texts in chunks(batch, text):
                c, f = statistics(texts, ids)
                bad, score = base_failed(c), trees.predict(f)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c[:, j]) for j in range(len(STATISTICS))), pa.array(bad), pa.array(score), pa.array(~bad & (score >= threshold))],
                    names=[key, *STATISTICS, "base_failed", "quality_score", "kept"],
                )

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(judge, f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in STATISTICS) + ", base_failed boolean, quality_score double, kept boolean")
