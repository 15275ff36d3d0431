"""User folds of a plan: ordered lambdas, and mergeable folds of zero, step, merge and finish.

A mergeable fold is told as
``zero: <expr>; step: (a, x) -> <expr>; merge: (a, b) -> <expr>; finish: a -> <expr>``
(merge must not depend on order; finish gives the quantity, and is the state itself
where it is left out). Its usages become states where they are, by packs of up to
``MAX_PACK`` rows; only states are shuffled and merged, and states of different
batches merge as well (``accumulated states`` hold them as JSON). A step that gives
null skips the usage. An ordered lambda ``(a, x) -> <expr>`` sees the usages in
order of arrival, and can't be merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sandbox import X, refusal, safe, wrong_types

FOLDS = ("sum", "max", "avg", "time_based")
#: Usages that become one state at once.
MAX_PACK = 100_000
_FIELDS = ["value", "start_ms", "end_ms", "from_ms", "to_ms"]
_LAMBDA = re.compile(r"\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)\s*->")


@dataclass(frozen=True)
class Fold:
    """A user fold; ``zero`` is null for an ordered lambda, which has a step only."""

    text: str
    step: str
    zero: str | None = None
    merge: str | None = None
    finish: str | None = None

    @property
    def mergeable(self) -> bool:
        return self.zero is not None

    @property
    def reads_cells(self) -> bool:
        return bool(re.search(r"\bx\.(day|month)\b", self.step))

    @property
    def reads_window(self) -> bool:
        """Whether the step may tell a day from its month."""
        return bool(re.search(r"\b(from_ms|to_ms)\b", self.step, re.I)) or self._reads_whole

    @property
    def _reads_whole(self) -> bool:
        """Whether the step names its usage other than by a field."""
        found = _LAMBDA.match(self.step)
        return found is None or bool(re.search(rf"\b{found[2]}\b(?!\s*\.)", self.step[found.end():]))

    def refusal(self) -> str | None:
        """Why the fold may not run, or None: each part is judged, then analyzed with the state's own type."""
        if self.mergeable and self.reads_cells:
            return "cells depend on order"
        for part, names in ((self.zero, ()), (self.step, ()), (self.merge, ()), (self.finish, ())):
            if part is not None and (reason := refusal(part, frozenset(names))):
                return reason
        zero = self.zero or "cast(null as double)"
        try:
            state = self.state_type()
        except Exception:
            return "does not fit: zero"
        try:
            parts = [f"aggregate(cast(null as array<struct<{_struct(X)}>>), cast({zero} as {state}), {_kept(self.step)})"]
            if self.mergeable:
                parts.append(f"aggregate(cast(null as array<{state}>), cast({zero} as {state}), {self.merge})")
                parts.append(f"cast(element_at(transform(array(cast({zero} as {state})), {self.finish or 'a -> a'}), 1) as double)")
        except ValueError as e:
            return str(e)
        return next((r for p in parts if (r := wrong_types(F.expr(p), "_none int"))), None)

    def state_type(self) -> str:
        if self.zero is None:
            return "double"
        safe(self.zero, frozenset())
        return SparkSession.active().range(0).select(F.expr(self.zero).alias("s")).schema["s"].dataType.simpleString()

    def checked(self) -> Fold:
        if reason := self.refusal():
            raise ValueError(f"plan expression refused ({reason}): {self.text[:200]}")
        return self

    def stepped(self, xs: str) -> Column:
        """The state of an array of usages."""
        zero = self.zero or "cast(null as double)"
        return F.expr(f"aggregate({xs}, cast({zero} as {self.state_type()}), {_kept(self.step)})")

    def merged(self, states: str) -> Column:
        """One state of an array of states."""
        return F.expr(f"aggregate({states}, cast({self.zero} as {self.state_type()}), {self.merge})")

    def finished(self, state: str) -> Column:
        return F.expr(f"cast(element_at(transform(array({state}), {self.finish or 'a -> a'}), 1) as double)")


def _struct(fields: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.split() for x in fields.split(", ")))


def _kept(step: str) -> str:
    """The step, where null leaves the state as it was."""
    found = _LAMBDA.match(step)
    if not found:
        raise ValueError("no lambda of two: " + step[:100])
    return f"({found[1]}, {found[2]}) -> coalesce({step[found.end():]}, {found[1]})"


def fold_of(text: str) -> Fold:
    """The fold that a plan's ``accumulate`` tells; what is none raises an error."""
    if re.match(r"\s*zero\s*:", text):
        parts = re.split(r"(?:^|;)\s*(zero|step|merge|finish)\s*:", text.strip())
        told = dict(zip(parts[1::2], (p.strip().rstrip(";").strip() for p in parts[2::2]), strict=True))
        if parts[0].strip() or not {"zero", "step", "merge"} <= set(told) or len(told) != len(parts) // 2 or not _LAMBDA.match(told["merge"]) or not _LAMBDA.match(told["step"]):
            raise ValueError(f"no such fold: {text[:200]}")
        return Fold(text, told["step"], told["zero"], told["merge"], told.get("finish"))
    if (found := _LAMBDA.match(text)) and found.groups() == ("a", "x"):
        return Fold(text, text)
    raise ValueError(f"no such fold: {text[:200]}")


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows' keys with ``xs``, arrays of up to ``MAX_PACK`` usages of one task, put together where they are, without a shuffle."""
    told = rows.select(*keys, "latest_ms", *(F.col(c).cast(t).alias(c) for c, t in zip(_FIELDS, ["double", *["long"] * 4], strict=True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MAX_PACK:
                yield from grouped(held)
                held, n = [], 0
        if held:
            yield from grouped(held)

    def grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.Table.from_batches(held).group_by(keys).aggregate([("latest_ms", "max"), *((c, "list") for c in _FIELDS)])
        yield from lists.select([*keys, "latest_ms_max", *(f"{c}_list" for c in _FIELDS)]).rename_columns([*keys, "latest_ms", *_FIELDS]).combine_chunks().to_batches()

    schema = ", ".join([*(f"`{k}` {told.schema[k].dataType.simpleString()}" for k in keys), "latest_ms long", *(f"{c} array<{'double' if c == 'value' else 'long'}>" for c in _FIELDS)])
    packed = told.mapInArrow(pack, schema)
    return packed.select(*keys, "latest_ms", F.arrays_zip(*_FIELDS).alias("xs"))


def stepped_states(rows: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """keys, n, latest_ms and the state ``s`` of each pack of usages, stepped where they are; not merged yet."""
    fold = fold.checked()
    return _packed(rows, keys).select(*keys, F.size("xs").cast("long").alias("n"), "latest_ms", fold.stepped("xs").alias("s"))


def fold_states(rows: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """keys, n, latest_ms and ``state`` (JSON) of the rows' usages: stepped where they are, then merged."""
    return _merged(stepped_states(rows, fold, keys), fold, keys).select(*keys, "n", "latest_ms", _json(F.col("s")).alias("state"))


def read_states(states: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """keys, n, latest_ms and ``s`` of stored states."""
    fold = fold.checked()
    return states.select(*keys, "n", "latest_ms", _read(fold, F.col("state")).alias("s"))


def merge_states(states: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """States of the same keys put together."""
    return _merged(read_states(states, fold, keys), fold, keys).select(*keys, "n", "latest_ms", _json(F.col("s")).alias("state"))


def fold_quantities(states: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """keys, n, latest_ms, ``state`` (JSON) and ``quantity`` of states ``s`` put together."""
    told = _merged(states, fold, keys)
    return told.select(*keys, "n", "latest_ms", _json(F.col("s")).alias("state"), fold.finished("s").alias("quantity"))


def _merged(states: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """A row a key with its state ``s``; one state for each pack of usages comes together in it."""
    told = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("latest_ms").alias("latest_ms"), F.collect_list(F.struct("s")).alias("ss"))
    return told.select(*keys, "n", "latest_ms", fold.merged("transform(ss, y -> y.s)").alias("s"))


def finish_states(states: DataFrame, fold: Fold) -> DataFrame:
    """Adds ``quantity``, what the fold makes of a state."""
    return states.withColumn("_s", _read(fold, F.col("state"))).withColumn("quantity", fold.finished("_s")).drop("_s")


def _json(state: Column) -> Column:
    return F.to_json(F.struct(state.alias("s")))


def _read(fold: Fold, state: Column) -> Column:
    return F.from_json(state, f"s {fold.state_type()}").getField("s")
