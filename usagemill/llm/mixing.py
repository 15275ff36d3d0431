"""Mixing sources to target weights by hash-threshold histograms, without sorting rows.

Each row has a hash in [0, 2^32), a function of its id and text. A source whose
target is m sizes and a remainder takes every row m times, and once more the
rows whose hash lies below a threshold. Words are summed by source and hash
bucket; the buckets that fit the remainder set the threshold, and only the one
bucket that the budget ends in is split further, level by level.

Semantics for odd input: a null or empty text has size 0; null is a source of
its own, the last; a source of size 0 has target 0; repeated rows have equal
hashes and are taken alike; an empty table gives an empty result. Only the
columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, positional

WEIGHTS = (3, 1, 2)
HASH_BITS = 32
#: Hash bits that each level of the histogram resolves; three levels use up the hash.
LEVEL_BITS = (11, 11, 10)
#: The per-source table is broadcast up to this many sources, a few MB; with more, joins shuffle.
MAX_BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words, as runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words by source, for a table of one row per source (source, source_size).

    Targets are weight x level, stopped at ``most`` times the size; the level at
    which they add up to ``share`` of all sizes is where resharing the excess ends.
    It is found from running sums over the sources in order of the level at which
    each one stops.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = sizes.withColumn("weight", w).withColumn("stop", F.col("source_size") * most / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * share
    # If this source is the first that does not stop, the level is what is left over the weights that are left.
    level = (budget - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level_here", level).withColumn("level", F.max(F.when(F.col("level_here") <= F.col("stop"), F.col("level_here"))).over(every))
    target = F.least(F.col("source_size") * most, F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return found.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: passes (rows taken that often at least) and the hash threshold for one more.

    A level keeps, per source, the start of the bucket in which the budget ends
    and what is left of the budget there.
    """
    state = targets.withColumns({
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        "low": F.lit(0).cast("long"),
    }).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    bits = HASH_BITS
    send = _sender(targets)
    for step in LEVEL_BITS:
        span, bits = 1 << bits, bits - step
        inside = rows.join(send(state.select(F.col("source").alias("s"), "low")), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span))
        bins = inside.groupBy("source", F.shiftright("h", bits).alias("b")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("b")
        sums = bins.withColumn("upto", F.sum("words").over(run))
        joined = sums.join(send(state.select(F.col("source").alias("s"), "left")), F.col("source").eqNullSafe(F.col("s")))
        # The first bucket that goes past the budget: it is split next. If none does, the source takes all.
        edge = joined.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e")
        state = state.join(send(edge), F.col("source").eqNullSafe(F.col("s")), "left").select(
            *targets.columns, "passes",
            F.when(F.col("e").isNull(), F.col("low") + span).otherwise(F.shiftleft(F.col("e.b"), bits)).alias("low"),
            F.when(F.col("e").isNull(), 0.0).otherwise(F.col("left") - F.col("e.before")).alias("left"),
            F.col("e.words").alias("edge"),
        )
        state = cut(state)
    # The last bucket is one hash value: it goes in if that comes nearer to the budget.
    nearer = (F.col("edge").isNotNull()) & (F.col("left") * 2 >= F.col("edge"))
    return state.withColumn("threshold", F.col("low") + F.when(nearer, 1).otherwise(0))


def mix_sources(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """Per row: key, size, source_size, target (both of its source) and taken, the words that the mix takes of it, repeats counted."""
    rows = cut(
        documents.select(
            F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
            (F.xxhash64(F.col(key), F.col(text)).bitwiseAND((1 << HASH_BITS) - 1)).alias("h"),
        )
    )
    found = _thresholds(rows, _targets(rows, weights, share)).withColumnRenamed("source", "s")
    out = rows.join(_sender(found)(found), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def _targets(rows: DataFrame, weights: tuple[int, ...], share: float) -> DataFrame:
    return cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))


def _sender(per_source: DataFrame):
    """How a table of a row per source reaches the rows: broadcast if its counted size allows, else as the join falls out."""
    return F.broadcast if per_source.count() <= MAX_BROADCAST_SOURCES else lambda df: df


def _times() -> Column:
    return (F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("long")


def mixed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    docs, (k, t, s), names = positional(documents, key, text, source)
    hashed = F.xxhash64(F.col(k), F.col(t)).bitwiseAND((1 << HASH_BITS) - 1)
    rows = cut(docs.select(F.col(s).alias("source"), size_of(F.col(t)).alias("size"), hashed.alias("h")))
    found = _thresholds(rows, _targets(rows, weights, share))
    taken = docs.withColumn("h", hashed).join(_sender(found)(found.select(F.col("source").alias("s"), "passes", "threshold")), F.col(s).eqNullSafe(F.col("s")))
    return taken.select(*names, F.explode(F.array_repeat(F.lit(0), _times().cast("int")))).select(*names).toDF(*documents.columns)
