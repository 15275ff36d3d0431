"""Sharding along a Hilbert curve over quantised metadata, with runs of the curve as shards.

Several metadata columns are quantised into 2^bits cells each: numbers and times
at approximate quantiles, strings where the rows of the whole values before them,
in order, make up the cells' shares. The cell's index on the Hilbert curve orders
the rows, and the curve is cut into shards whose row counts differ by at most one.
Neighbours on the curve agree in all dimensions at once, so the files' min/max
statistics prune on each of them. Everything is DataFrame functions: no Python
runs on executors.

Semantics for odd input: nulls in a dimension sort first, a dimension that the
table lacks is left out; a null text has size 8 and the CRC-32 of an empty string;
rows that tie in every key are equal in all that is returned or differ in columns
not read, and are dealt out by the place they were read from, so many equal ones
fill several ranges; texts are measured whole and, but for ``write_shards`` and
``shard_documents``, travel nowhere; tables of fewer rows than shards leave shards
empty; an empty table gives an empty result; columns of the table may have any
names (see ``write_shards`` for those of its own).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, positional

BITS = 5
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell given by its coordinates, each of ``bits`` bits.

    From the top bit down, the coordinates' bits pick a corner of the current
    cube; entry point and direction of the sub-cube's curve follow from Gray codes.
    """
    n = len(cells)
    mask = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(i) for i in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    turn = [0 if i == 0 else ones(i - 1) % n if i % 2 == 0 else ones(i) % n for i in range(1 << n)]
    # One table for a step: from entry, direction and corner to the next digit, entry and direction.
    table = []
    for e in range(1 << n):
        for d in range(n):
            for corner in range(1 << n):
                x = corner ^ e
                by = (d + 1) % n
                w = rank[((x >> by) | (x << (n - by))) & mask]
                s = entry[w]
                table.append((w, e ^ (((s << by) | (s >> (n - by))) & mask), (d + turn[w] + 1) % n))
    steps = F.array(*(F.lit((w << 16) | (e << 8) | d) for w, e, d in table))
    corners = [
        reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), j) for j, c in enumerate(cells)))
        for bit in range(bits - 1, -1, -1)
    ]

    def step(state: Column, corner: Column) -> Column:
        found = F.element_at(steps, (((F.shiftright(state, 8).bitwiseAND(255)) * n + state.bitwiseAND(255)) * (1 << n) + corner + 1).cast("int")).cast("long")
        return F.shiftleft(F.shiftleft(F.shiftright(state, 16), n).bitwiseOR(F.shiftright(found, 16)), 16).bitwiseOR(found.bitwiseAND(65535))

    return F.shiftright(F.aggregate(F.array(*(c.cast("long") for c in corners)), F.lit(0).cast("long"), step), 16)


def as_number(column: Column, kind: str) -> Column:
    """An order-keeping number for a dimension that is no string; null: null."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def string_bounds(df: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The values at which cells of a string dimension begin, at most 2^bits - 1 of them, in order.

    Rows are counted by whole value; the values are ordered by range, and where each stands among all rows comes from sums inside
    the ranges and one number a range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    order, _ = ranked(counts, ["v"])
    parts = order.withColumn("_p", F.col("range"))
    totals = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(totals):
        first[p], total = total, total + totals[p]
    if not total:
        return []
    starts = F.broadcast(df.sparkSession.createDataFrame(list(first.items()), "_p int, first long"))
    upto = F.sum("n").over(Window.partitionBy("_p").orderBy("rank")) - F.col("n") + F.col("first")
    cells = parts.join(starts, "_p").select("v", F.floor(upto * (1 << bits) / total).alias("cell"))
    return sorted((r["v"] for r in cells.where("cell > 0").groupBy("cell").agg(F.min("v").alias("v")).collect()), key=lambda v: v.encode())


def cell_bounds(df: DataFrame, numbers: dict[str, Column], bits: int = BITS) -> dict[str, list[float]]:
    """Approximate quantiles of every dimension, 2^bits - 1 of them: a row for the whole table."""
    if not numbers:
        return {}
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*(F.percentile_approx(c, at, 1000).alias(k) for k, c in numbers.items())).first()
    return {k: sorted(set(row[k] or [])) for k in numbers}


def curve_order(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, names: dict[str, str] | None = None) -> Column:
    """The Hilbert index of each row by the quantised ``dimensions`` that the table has; ``names`` says what they are called where the index is used."""
    kinds = {d: dict(df.dtypes)[d] for d in dimensions if d in df.columns}
    strings = {d: string_bounds(df, d, bits) for d, kind in kinds.items() if kind == "string"}
    numbers = {d: as_number(F.col(d), kind) for d, kind in kinds.items() if kind != "string"}
    bounds = cell_bounds(df, numbers, bits)
    used = {d: F.col((names or {}).get(d, d)) for d in kinds}

    # A dimension of few values takes the whole range of cells too, or the curve would split it last.
    def place(passed: list[Column]) -> Column:
        return F.floor(reduce(lambda x, y: x + y, (F.when(p, 1).otherwise(0) for p in passed), F.lit(0)) * (1 << bits) / (len(passed) + 1))

    cells = [place([used[d] >= v for v in strings[d]] if d in strings else [as_number(used[d], kinds[d]) > v for v in bounds[d]]) for d in kinds]
    return hilbert_index([F.coalesce(c, F.lit(0)) for c in cells], bits) if cells else F.lit(0).cast("long")


def ranked(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds ``rank``, from 0 and gapless in the order of ``keys``, and ``range``, and gives the row count.

    Rows are dealt by range and sorted inside the ranges; a range's first rank
    comes from the ranges' row counts, one number each.
    """
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    per = sorted((r["p"], r["n"]) for r in ordered.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect())
    first, total = {}, 0
    for p, n in per:
        first[p], total = total, total + n
    starts = F.broadcast(df.sparkSession.createDataFrame(list(first.items()), "range int, first long"))
    rank = F.col("first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("range", F.shiftright("_at", 33).cast("int")).join(starts, "range").withColumn("rank", rank).drop("_at", "first"), total


def _shard_of(rank: Column, shards: int, total: int) -> tuple[Column, Column]:
    """Shard and slot of a rank: the first ``total % shards`` shards have one row more."""
    each, more = divmod(total, shards)
    wide = more * (each + 1)
    shard = F.when(rank < wide, F.floor(rank / (each + 1))).otherwise(more + F.floor((rank - wide) / max(each, 1)))
    start = F.when(shard < more, shard * (each + 1)).otherwise(wide + (shard - more) * each)
    return shard.cast("int"), (rank - start).cast("long")


def hilbert_shards(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Per row: key, size (UTF-8 bytes of the text and 8), text_crc32, curve (Hilbert index), shard and slot."""
    # Texts are read once: what ranges are made from and dealt by are these few numbers.
    rows = cut(df.select(F.col(key).alias("key"), curve_order(df, dimensions, bits).alias("curve"), *_measured(F.col(text)), F.monotonically_increasing_id().alias("read_at")))
    order, total = ranked(rows, ["curve", "text_crc32", "key", "size", "read_at"])
    shard, slot = _shard_of(F.col("rank"), shards, total)
    return order.select(F.col("key").alias(key), "size", "text_crc32", "curve", shard.alias("shard"), slot.alias("slot"))


def _measured(text: Column) -> list[Column]:
    data = F.coalesce(F.encode(text, "utf-8"), F.lit(b""))
    return [(F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")]


def _free(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it; names differ by more than their case."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def shard_documents(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Whole rows along the curve: the columns of the table, then size, text_crc32, curve, shard and slot; one of these names that is taken gets underscores in front."""
    rows, (k, t), names = positional(df, key, text)
    whole = cut(rows.select(*names, curve_order(df, dimensions, bits, dict(zip(df.columns, names, strict=True))).alias("curve"), *_measured(F.col(t)), F.monotonically_increasing_id().alias("read_at")))
    order, total = ranked(whole, ["curve", "text_crc32", k, "size", "read_at"])
    shard, slot = _shard_of(F.col("rank"), shards, total)
    added = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "curve": F.col("curve"), "shard": shard, "slot": slot}
    return order.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), *(c.alias(_free(n, df.columns)) for n, c in added.items()))


def write_shards(df: DataFrame, path: str, shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> None:
    """Writes whole rows as Parquet, one folder a shard, each sorted along the curve so that row groups prune too; the folders' column is ``shard``, with underscores in front if that is taken."""
    named = _free("shard", df.columns)
    placed = shard_documents(df, shards, key, text, dimensions, bits)
    slot = placed.columns[-1]
    placed.sortWithinPartitions(named, slot).select(*df.columns, named).write.partitionBy(named).parquet(path)
