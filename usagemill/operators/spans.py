"""Continuous usage: start and stop events to spans, spans to discrete usage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bounds, trunc_dim

TARGET = ["organization_id", "space_id", "consumer_id", "resource_id", "plan_id", "resource_instance_id"]


def build_spans(events: DataFrame, target: list[str], order: list[str], ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(spans, rejects) of events (kind start or stop) whose order is that of their times.

    A start is taken if the event before it is a stop or none, a stop if it is a
    start; a span runs from the first start of a run to the stop after it, and
    is open without one. Rejected starts are conflicts, rejected stops miss a span.
    """
    w = Window.partitionBy(*target).orderBy(*order)
    told = events.withColumn("_before", F.lag("kind").over(w))
    started = (F.col("kind") == "start") & (F.col("_before").isNull() | (F.col("_before") == "stop"))
    stopped = (F.col("kind") == "stop") & (F.col("_before") == "start")
    told = told.withColumns({"_start": started, "_stop": F.coalesce(stopped, F.lit(False))})
    taken = told.where("_start OR _stop").withColumn("end_ms", F.lead(ts).over(w))
    spans = taken.where("_start").withColumnRenamed(ts, "start_ms").drop("_before", "_start", "_stop", "kind")
    rejects = told.where("NOT _start AND NOT _stop").withColumn("reason", F.when(F.col("kind") == "start", "conflict").otherwise("missing"))
    return spans, rejects.drop("_before", "_start", "_stop")


def build_spans_by_fold(events: DataFrame, target: list[str], order: str, ts: str = "timestamp") -> DataFrame:
    """Spans of events that may come out of order: per target (start_ms, end_ms, null while open) and the rejects by reason.

    A target's events are dealt to one task and sorted there by order of arrival,
    which spills; they stream past a state of one open start, and a closed span
    leaves at once, so no target's events are ever held together. A stop before
    its span's start is out of order and leaves the span open.
    """
    names = [f"_t{i}" for i in range(len(target))]
    rows = events.select(*(F.col(t).alias(n) for t, n in zip(target, names, strict=True)), F.col(order).alias("_o"), F.col(ts).cast("long").alias("ts"), "kind")
    kinds = ", ".join(f"{n} {events.schema[t].dataType.simpleString()}" for t, n in zip(target, names, strict=True))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "_o", "ts", "kind").drop("_o")
    told = dealt.mapInPandas(_folded(names), f"{kinds}, start_ms long, end_ms long, conflicts long, missing long, disordered long")
    # A target's counts come with its last row; spans take them from there.
    totals = told.where("conflicts IS NOT NULL").select(*(F.col(n).alias(f"{n}_") for n in names), "conflicts", "missing", "disordered")
    found = told.drop("conflicts", "missing", "disordered").where("start_ms IS NOT NULL")
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    both = totals.join(found, same, "left").select(*(F.col(f"{n}_").alias(t) for t, n in zip(target, names, strict=True)), "start_ms", "end_ms", "conflicts", "missing", "disordered")
    return both


def _folded(names: list[str]):
    """Closed spans as they close; with a target's end its open span, if there is one, and its counts of rejects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, counts, out = None, None, [0, 0, 0], []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[*names, "start_ms", "end_ms", "conflicts", "missing", "disordered"], dtype=object)
            return made.astype({c: "Int64" for c in made.columns[len(names) :]})

        for batch in batches:
            for *now, ts, kind in batch.itertuples(index=False, name=None):
                if now != key:
                    if key is not None:
                        out.append((*key, start, None, *counts))
                    key, start, counts = now, None, [0, 0, 0]
                if kind == "start" and start is None:
                    start = int(ts)
                elif kind == "start":
                    counts[0] += 1
                elif start is None:
                    counts[1] += 1
                elif ts < start:
                    counts[2] += 1
                else:
                    out.append((*key, start, int(ts), None, None, None))
                    start = None
            if out:
                yield frame()
                out.clear()
        if key is not None:
            out.append((*key, start, None, *counts))
            yield frame()

    return run


def next_interval_end(last_end: Column, span_end: Column, dim: str = "D") -> Column:
    """Where the interval after ``last_end`` ends: forward at the next boundary or the span's end, backward at the one before."""
    _, up = bounds(last_end, dim)
    down = trunc_dim(last_end - 1, dim)
    return F.when(span_end.isNull(), up).when(span_end >= last_end, F.least(up, span_end)).otherwise(F.greatest(down, span_end))


def sample_spans(spans: DataFrame, now: int, dim: str = "D", sampled_to: str | None = None) -> DataFrame:
    """Intervals of spans (start_ms, end_ms) that cross no boundary of ``dim`` (s, m, h or D), numbered by ``n``.

    A closed span is sampled to its end, an open one to the first boundary at or
    after now less one ``dim``. From ``sampled_to`` a span that ended before it
    is taken back in intervals of negative length. A span of no length gives one.
    """
    width = bounds(F.lit(0).cast("long"), dim)[1]
    last = F.col(sampled_to) if sampled_to else F.col("start_ms")
    horizon = F.lit(now) - width
    # The first boundary at or after the horizon, if that is beyond what is sampled.
    ahead = F.when(last < horizon, trunc_dim(horizon + width - 1, dim))
    to = F.coalesce("end_ms", ahead)
    told = spans.withColumns({"_last": last, "_to": to}).where("_to IS NOT NULL")
    first_up, first_down = trunc_dim(F.col("_last"), dim) + width, trunc_dim(F.col("_last") - 1, dim)
    none = F.array().cast("array<bigint>")
    up = F.when(first_up < F.col("_to"), F.sequence(first_up, F.col("_to") - 1, width)).otherwise(none)
    down = F.when(first_down > F.col("_to"), F.sequence(first_down, F.col("_to") + 1, -width)).otherwise(none)
    points = F.concat(F.array("_last"), F.when(F.col("_to") >= F.col("_last"), up).otherwise(down), F.array("_to"))
    pairs = F.expr("transform(sequence(1, size(_p) - 1), i -> struct(i AS n, _p[i - 1] AS s, _p[i] AS e))")
    return told.withColumn("_p", points).withColumn("_i", F.explode(pairs)).select(*spans.columns, F.col("_i.n").cast("int").alias("n"), F.col("_i.s").alias("from_ms"), F.col("_i.e").alias("until_ms"))


def correct_spans(spans: DataFrame, sampled_to: str, now: int, dim: str = "D") -> DataFrame:
    """Intervals from what was sampled already to the true end, backward where that lies before."""
    return sample_spans(spans, now, dim, sampled_to)


def interval_usage(intervals: DataFrame, target: list[str]) -> DataFrame:
    """Usage in the middle of an interval with its length as ``duration``; the id is a hash of target and interval, the same on every run."""
    mid = F.floor((F.col("from_ms") + F.col("until_ms")) / 2)
    key = F.sha2(F.concat_ws("|", *target, F.col("from_ms").cast("string"), F.col("until_ms").cast("string")), 256)
    return intervals.withColumns({"usage_ms": mid.cast("long"), "duration": F.col("until_ms") - F.col("from_ms"), "dedup_id": key})


def span_cleanup(spans: DataFrame, now: int) -> DataFrame:
    """Without spans that ended more than a month ago."""
    least = F.unix_millis(F.timestamp_millis(F.lit(now)) - F.expr("INTERVAL 1 MONTH"))
    return spans.where(F.col("end_ms").isNull() | (F.col("end_ms") >= least))
