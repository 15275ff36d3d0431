"""Statistics over event streams: rates, gauges, percentiles, call outcomes, last posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slots(events: DataFrame, ts: str, size: int, now: int) -> DataFrame:
    """Adds ``slot``, 0 for that of now and 1 for the one before; others go."""
    slot = F.lit(now // size) - F.floor(F.col(ts) / size)
    return events.withColumn("slot", slot).where("slot IN (0, 1)")


def rate_windows(events: DataFrame, name: str, ts: str, size: int, now: int) -> DataFrame:
    """Events a second in the slot before, in the current one so far, and in both."""
    n = _slots(events, ts, size, now).groupBy(name).agg(F.count_if(F.col("slot") == 1).alias("p"), F.count_if(F.col("slot") == 0).alias("c"))
    gone = now % size
    return n.select(name, (F.col("p") * (1000 / size)).alias("previous_rate"), (F.col("c") * (1000 / max(1, gone))).alias("current_rate"), ((F.col("p") + F.col("c")) * (1000 / (size + gone))).alias("composite_rate"))


def gauge_windows(events: DataFrame, name: str, value: str, ts: str, size: int, now: int) -> DataFrame:
    """Least, greatest and mean of a value in the slot before, the current one, and both."""
    rows = _slots(events, ts, size, now)
    parts = {"previous": F.col("slot") == 1, "current": F.col("slot") == 0, "composite": F.lit(True)}
    return rows.groupBy(name).agg(*(f(F.when(w, F.col(value))).alias(f"{k}_{n}") for k, w in parts.items() for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))


#: The percentiles that are told.
PERCENTS = [0, 25, 50, 75, 90, 95, 99, 99.5, 100]


def latency_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Percentiles by rank p/100 x n, interpolated and rounded between ranks, and the mean.

    Equal values are counted first, in a map-side combine; ranks come from running
    sums of the counts over a key's different values, which spill. No key's values
    are gathered in a row. ``approximate_percentiles`` needs no order at all.
    """
    w = Window.partitionBy(*keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    ranked = counts.select(*keys, "v", "k", F.sum("k").over(w.orderBy("v")).alias("upto"), F.sum("k").over(w).alias("n"))
    aggs: list[Column] = [(F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.max("n").alias("n")]
    holds = lambda i: (F.col("upto") - F.col("k") <= i) & (i < F.col("upto"))
    for j, p in enumerate(PERCENTS):
        rank = F.lit(p / 100) * F.col("n")
        aggs += [F.max(F.when(holds(F.floor(rank)), F.col("v"))).alias(f"_l{j}"), F.max(F.when(holds(F.least(F.ceil(rank), F.col("n") - 1)), F.col("v"))).alias(f"_h{j}")]
    told = ranked.groupBy(*keys).agg(*aggs)

    def pick(j: int, p: float) -> Column:
        rank = F.lit(p / 100) * F.col("n")
        between = F.floor(F.col(f"_l{j}") + (rank - F.floor(rank)) * (F.col(f"_h{j}") - F.col(f"_l{j}")) + 0.5).cast("double")
        return F.when(F.ceil(rank) >= F.col("n"), F.col(f"_h{j}")).when(F.floor(rank) == F.ceil(rank), F.col(f"_l{j}")).otherwise(between)

    return told.select(*keys, *(pick(j, p).alias("p" + str(p).replace(".", "_")) for j, p in enumerate(PERCENTS)), "mean")


def approximate_percentiles(df: DataFrame, keys: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """Percentiles within n / ``accuracy`` ranks, from mergeable summaries of bounded size, and the mean."""
    at = F.percentile_approx(value, [p / 100 for p in PERCENTS], accuracy)
    told = df.groupBy(*keys).agg(at.alias("_p"), F.avg(value).alias("mean"))
    return told.select(*keys, *(F.col("_p")[j].alias("p" + str(p).replace(".", "_")) for j, p in enumerate(PERCENTS)), "mean")


def call_stats(events: DataFrame, name: str, ts: str, outcome: str, n: int, size: int) -> DataFrame:
    """Outcome counts over the last ``n`` buckets of ``size`` ms, for each bucket; buckets without events inside the range count too."""
    kinds = ("ok", "error", "timeout", "reject")
    # Counted by bucket first: what is copied to n buckets are counts, not events.
    counts = events.groupBy(name, F.floor(F.col(ts) / size).alias("_b")).agg(*(F.count_if(F.col(outcome) == k).alias(k) for k in kinds))
    each = counts.withColumn("bucket", F.explode(F.sequence(F.col("_b"), F.col("_b") + (n - 1))))
    return each.groupBy(name, (F.col("bucket") * size).alias("bucket_ms")).agg(*(F.sum(k).alias(k) for k in kinds))


def recent_posts(df: DataFrame, name: str, order: list[Column], n: int = 3) -> DataFrame:
    """The last ``n`` rows of each name, ``rank`` 1 being the newest."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where(F.col("rank") <= n)
