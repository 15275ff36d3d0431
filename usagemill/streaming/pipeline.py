"""The pipeline as Structured Streaming: idempotent micro-batches and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.accumulate import merge_accumulated
from ..sources.state import upsert_state


def run_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str], version: str, partition: str) -> StreamingQuery:
    """Runs ``process`` on what there is and merges its rows into a state table; a repeated batch changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        upsert_state(process(batch), path, keys, version, partition)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SpanPairing(StatefulProcessor):
    """Pairs starts and stops of a target across batches; its state is the open start, so a target that is stopped leaves none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of the target's events of one batch only these columns are held, to be put in order.
        events = pd.concat([part[["seq", "kind", "timestamp"]] for part in rows]).sort_values("seq", kind="stable")
        start = self.open.get()[0] if self.open.exists() else None
        out = []
        for kind, ts in zip(events["kind"], events["timestamp"], strict=True):
            if kind == "start" and start is None:
                start = int(ts)
            elif kind == "start":
                out.append((*key, None, int(ts), "conflict"))
            elif start is None:
                out.append((*key, None, int(ts), "missing"))
            elif ts < start:
                out.append((*key, start, int(ts), "out of order"))
            else:
                out.append((*key, start, int(ts), None))
                start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start,))
        if out:
            yield pd.DataFrame(out, columns=["target", "start_ms", "end_ms", "reason"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    def close(self) -> None:
        pass


def pair_spans(events: DataFrame) -> DataFrame:
    """Closed spans and rejects of a stream of events (target, kind, timestamp, seq)."""
    return events.groupBy("target").transformWithStateInPandas(SpanPairing(), "target string, start_ms long, end_ms long, reason string", "append", "none")


def accumulate_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Accumulates each micro-batch by itself (``process`` gives mergeable accumulated states) as a part of its own; a repeated batch replaces its part.

    The states of all batches add up when they are read (``accumulated``), as a
    change of state adds to the tree. ``compact`` puts parts together.
    """

    def sink(batch: DataFrame, n: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The states of all batches, days and months, put together."""
    return merge_accumulated(spark.read.parquet(path).drop("batch"), keys)


def compact(spark: SparkSession, path: str, to: str, keys: list[str]) -> None:
    """Writes the states so far as one part of a new table, which later batches may follow."""
    accumulated(spark, path, keys).write.parquet(f"{to}/batch=-1")
