"""Accumulation per instance and calendar window, and the organization tree.

A batch groups what the pipeline folds document by document: sums of changes
telescope to the sum of the last states (the tests hold this against an ordered
fold). Sums are kept as whole numbers or decimals, so they do not depend on order.
States of different batches add up (``merge_accumulated``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import add_months, trunc_dim
from ..plans.catalog import Catalog, formula_columns, gathered, resolved
from .folds import FOLDS, Fold, finish_states, fold_of, fold_quantities, fold_states, read_states, stepped_states

WINDOW = ["metric", "accumulate", "dimension", "bucket_ms"]


def buckets(df: DataFrame, ts: str = "end_ms") -> DataFrame:
    """A row for the day and one for the month that hold the time; finer windows carry nothing."""
    w = F.array(*(F.struct(F.lit(d).alias("dimension"), trunc_dim(F.col(ts), d).alias("bucket_ms")) for d in ("D", "M")))
    return df.withColumn("_w", F.explode(w)).select("*", "_w.dimension", "_w.bucket_ms").drop("_w")


def bucket_end(dimension: Column, bucket_ms: Column) -> Column:
    return F.when(dimension == "D", bucket_ms + 86_400_000).otherwise(add_months(bucket_ms, 1))


def decimal(x: Column) -> Column:
    return x.cast("decimal(28,9)")


#: Numbers from here on add up as doubles.
_FAR = 1e11


#: Whole parts add up in two longs, so that no count of them passes 64 bits.
_SPLIT = 1_000_000


def number_parts(x: Column) -> dict[str, Column]:
    """A number in parts that add up as longs, whatever the order: the whole part, in two, and billionths; and numbers from 1e11 on, as they are. NaN and infinity are left out."""
    near = F.when(F.abs(x) < _FAR, x)
    whole = near.cast("long")
    return {"high": F.floor(whole / _SPLIT), "low": F.pmod(whole, F.lit(_SPLIT)), "parts": F.round((near - whole) * 1e9).cast("long"), "far": F.when((F.abs(x) >= _FAR) & (F.abs(x) < float("inf")), x)}


def number_of(parts: dict[str, Column]) -> Column:
    """The number that sums of parts make, null if nothing was added."""
    whole = (parts["high"].cast("decimal(20,0)") * F.lit(Decimal(_SPLIT)) + parts["low"].cast("decimal(20,0)")).cast("double")
    near = whole + parts["parts"].cast("double") / 1e9
    return F.when(parts["far"].isNull(), near).otherwise(F.coalesce(near, F.lit(0.0)) + parts["far"])


def exact_sum(x: Column) -> Column:
    """The sum to nine decimal places, whatever the order, for numbers below 1e11 and up to 9 * 10^9 fractional ones of a group; larger ones add as doubles. NaN and infinity are left out."""
    return number_of({k: F.sum(c) for k, c in number_parts(x).items()})


def _real(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def side_by_side(usage: DataFrame, ids: list[str] = schemas.INSTANCE, ts: str = "end_ms") -> DataFrame:
    """Documents of an instance (``ids`` tell it) and month put side by side, before they are metered.

    Metering and windows make several rows of a document. Where documents lie as they
    came, map sides find little to combine, and all these rows are shuffled; so a
    document is shuffled once, and states after it. An instance of very many documents
    is dealt to several tasks, and its states are put together by ``accumulate`` as ever.
    """
    return usage.withColumn("_month", trunc_dim(F.col(ts), "M")).hint("rebalance", *ids, "_month").drop("_month")


#: Usages of one key and window that a user fold gathers in one row.
MAX_PIECE = 100_000


def accumulate(metered: DataFrame, keys: list[str] = schemas.KEYS, order: str = "arrival_ms", mergeable: bool = False) -> DataFrame:
    """Per key, metric and window: quantity, the time-based state (consuming, consumed, since_ms), count and _sum; if ``mergeable``, also what ``merge_accumulated`` and an aggregate of last states need (latest, latest_ms).

    The metric's ``accumulate`` picks the fold: sum; max, never below 0; avg;
    time_based, whose ``consuming`` is that of the latest start, the later arrival
    on a tie. Another name raises an error. NaN counts nowhere (``check_metered``
    tells of it).
    """
    w = buckets(metered)
    span = (F.col("bucket_ms") + bucket_end(F.col("dimension"), F.col("bucket_ms")) - 2 * F.col("start_ms")).cast("decimal(14,0)")
    change = (F.coalesce("consuming", F.lit(0.0)) + F.coalesce("previous_consuming", F.lit(0.0))).cast("decimal(18,6)")
    timed = F.col("accumulate") == "time_based"
    # Start and arrival as one number: unlike a struct it can be kept in a hash aggregate.
    latest = F.when(F.col("consuming").isNotNull(), (F.col("start_ms").cast("decimal(18,0)") * F.lit(Decimal(10) ** 19) + F.col(order).cast("decimal(19,0)")).cast("decimal(38,0)"))
    more = [F.max(latest).alias("latest"), F.max(F.col(order).cast("long")).alias("latest_ms")] if mergeable else []
    grouped = w.groupBy(*keys, *WINDOW).agg(
        exact_sum(F.col("value")).alias("_sum"), F.max(_real(F.col("value"))).alias("_max"), F.count("*").alias("n"),
        F.sum(F.when(timed, (change * span).cast("decimal(28,6)"))).cast("double").alias("_consumed"),
        F.max_by("consuming", latest).alias("_consuming"), F.max("start_ms").alias("_since"), *more,
    )
    state = [F.when(timed, F.col(f"_{c}")).alias(n) for c, n in (("consuming", "consuming"), ("consumed", "consumed"), ("since", "since_ms"))]
    return grouped.select(*keys, *WINDOW, "n", "_sum", _quantity(F.col("_sum"), F.col("_max"), F.col("n")).alias("quantity"), *state, *(["latest", "latest_ms"] if mergeable else []))


def _quantity(total: Column, greatest: Column, n: Column) -> Column:
    """The quantity of a window by its fold."""
    fold = F.col("accumulate")
    unknown = F.raise_error(F.concat(F.lit("no such fold: "), F.coalesce(fold, F.lit("null")))).cast("double")
    return F.when(fold == "sum", total).when(fold == "max", F.greatest(F.lit(0.0), greatest)).when(fold == "avg", total / n).when(fold == "time_based", F.lit(None).cast("double")).when(F.col("metric").isNotNull(), unknown)


def merge_accumulated(states: DataFrame, keys: list[str] = schemas.KEYS, catalog: Catalog | None = None) -> DataFrame:
    """Mergeable states of the same keys and windows, accumulated from different usage, put together: what ``accumulate`` gives for all of it.

    With a catalog, the states of its mergeable folds merge by these; an ordered
    lambda has no states that merge, and raises an error.
    """
    named, custom = states, []
    if catalog is not None and (folds := user_folds(catalog)):
        if ordered := [f.text for f in folds if not f.mergeable]:
            raise ValueError(f"an ordered fold can't be merged: {ordered[0][:200]}")
        custom = folds
        named = states.where(~F.coalesce(F.col("accumulate").isin([f.text for f in folds]), F.lit(False)))
    told = named.groupBy(*keys, *WINDOW).agg(
        F.sum("n").alias("n"), exact_sum(F.col("_sum")).alias("_sum"), F.max("quantity").alias("_max"), F.max_by("consuming", "latest").alias("consuming"),
        F.sum(F.col("consumed").cast("decimal(28,6)")).cast("double").alias("consumed"), F.max("since_ms").alias("since_ms"), F.max("latest").alias("latest"), F.max("latest_ms").alias("latest_ms"),
    )
    out = told.select(*keys, *WINDOW, "n", "_sum", _quantity(F.col("_sum"), F.col("_max"), F.col("n")).alias("quantity"), "consuming", "consumed", "since_ms", "latest", "latest_ms")
    for fold in custom:
        merged = fold_quantities(read_states(states.where(F.col("accumulate") == fold.text), fold, [*keys, *WINDOW]), fold, [*keys, *WINDOW])
        out = out.unionByName(merged, allowMissingColumns=True)
    return out


def user_folds(catalog: Catalog) -> list[Fold]:
    """The catalog's own folds; a name that is no fold raises an error."""

    def read() -> list[Fold]:
        _, exprs = resolved(formula_columns(catalog.metrics).select("accumulate"), ["accumulate"])
        return [fold_of(f) for f in exprs["accumulate"] if f not in FOLDS]

    return catalog.kept("folds", read)


def accumulate_custom(metered: DataFrame, merge: str, zero: str = "cast(null as double)", keys: list[str] = schemas.KEYS, order: str = "arrival_ms", cells: bool = False, piece: int = MAX_PIECE) -> DataFrame:
    """A user fold in order of arrival: ``merge`` is a SQL lambda body over a (state) and x (value, start_ms, end_ms, from_ms, to_ms); where it gives null the usage is skipped.

    With ``cells``, x has the sums of the key's usage that arrived before it in the
    same day (``day``) and month (``month``), null if there was none.

    Up to ``piece`` usages of one key and window are gathered in one row. A window
    of more is folded piece by piece, in as many rounds as the longest one has
    pieces, each round taking up the states of the one before; such a fold has no
    other order than one after the other, so mergeable ones belong in ``accumulate``.
    """
    fields = ["value", "start_ms", "end_ms"]
    if cells:
        # Usages that arrive at once and are equal may change places: the fold sees the same.
        before = lambda d: Window.partitionBy(*keys, "metric", trunc_dim(F.col("end_ms"), d)).orderBy(order, "value", "start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
        metered = metered.withColumns({"day": F.sum("value").over(before("D")), "month": F.sum("value").over(before("M"))})
        fields += ["day", "month"]
    x = F.struct(F.col(order).alias("o"), *fields, F.col("bucket_ms").alias("from_ms"), bucket_end(F.col("dimension"), F.col("bucket_ms")).alias("to_ms"))
    ids = [*keys, "metric", "dimension", "bucket_ms"]
    folded = lambda rows, *month: rows.groupBy(*ids, *month).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # A month holds its days, so no window has more usages than the fullest month. Usages are shuffled once, by month, before they are put into both windows.
    dated = metered.select(*keys, "metric", F.col(order), *fields, trunc_dim(F.col("end_ms"), "M").alias("_month"))
    if (dated.groupBy(*keys, "metric", "_month").count().agg(F.max("count")).first()[0] or 0) <= piece:
        rows = buckets(dated.repartition(*keys, "metric", "_month")).select(*ids, "_month", x.alias("x"))
        return folded(rows, "_month").select(*ids, F.expr(f"aggregate(xs, {zero}, (a, x) -> coalesce({merge}, a))").alias("quantity"))
    rows = buckets(metered).select(*ids, x.alias("x"))
    turn = F.floor((F.row_number().over(Window.partitionBy(*ids).orderBy("x")) - 1) / piece)
    rows = rows.withColumn("_turn", turn).checkpoint()
    done = folded(rows.where("_turn = 0")).select(*ids, F.expr(f"aggregate(xs, {zero}, (a, x) -> coalesce({merge}, a))").alias("quantity"))
    for i in range(1, int(rows.agg(F.max("_turn")).first()[0]) + 1):
        after = folded(rows.where(F.col("_turn") == i)).select(*(F.col(c).alias(f"_{c}") for c in ids), "xs")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
        done = done.join(after, same, "left").select(*ids, F.expr(f"if(xs IS NULL, quantity, aggregate(xs, quantity, (a, x) -> coalesce({merge}, a)))").alias("quantity")).checkpoint()
    return done


def accumulate_by_plan(metered: DataFrame, catalog: Catalog, keys: list[str] = schemas.KEYS, order: str = "arrival_ms", mergeable: bool = False) -> DataFrame:
    """``accumulate`` for the named folds of the catalog, and each of its own: a mergeable one where its usages are, an ordered lambda in order of arrival; a name that is neither raises an error.

    If ``mergeable``, rows have ``state``, by which those of mergeable folds merge with other batches' (``merge_accumulated``).
    """
    folds = user_folds(catalog)
    texts = [f.text for f in folds]
    out = accumulate(metered.where(~F.coalesce(F.col("accumulate").isin(texts), F.lit(False))) if folds else metered, keys, order, mergeable)
    for fold in folds:
        rows = metered.where(F.col("accumulate") == fold.text)
        if fold.mergeable:
            found = _fold_windows(rows.withColumn("latest_ms", F.col(order).cast("long")), fold, keys)
            found = found if mergeable else found.drop("state", "latest_ms")
        else:
            fold.checked()
            found = accumulate_custom(rows, fold.step.split("->", 1)[1], keys=keys, order=order, cells=fold.reads_cells).withColumn("accumulate", F.lit(fold.text))
        out = out.unionByName(found, allowMissingColumns=True)
    if mergeable and "state" not in out.columns:
        out = out.withColumn("state", F.lit(None).cast("string"))
    return out


def _fold_windows(rows: DataFrame, fold: Fold, keys: list[str]) -> DataFrame:
    """States and quantities of a mergeable fold by day and month. One that does not see its window's bounds is stepped by day only, and a month's state is merged from its days'."""
    ends = lambda w: w.withColumns({"from_ms": F.col("bucket_ms"), "to_ms": bucket_end(F.col("dimension"), F.col("bucket_ms"))})
    if fold.reads_window:
        return fold_quantities(stepped_states(ends(buckets(rows)), fold, [*keys, *WINDOW]), fold, [*keys, *WINDOW])
    day = rows.withColumns({"dimension": F.lit("D"), "bucket_ms": trunc_dim(F.col("end_ms"), "D")})
    days = stepped_states(ends(day), fold, [*keys, *WINDOW])
    both = buckets(days.withColumnRenamed("bucket_ms", "_day").drop("dimension"), "_day").drop("_day")
    return fold_quantities(both, fold, [*keys, *WINDOW])


AGGREGATES = ("sum", "max", "last")


def aggregate_folds(catalog: Catalog) -> tuple[DataFrame, list[Fold]]:
    """(the metrics that name an aggregate, by metering plan; those of their aggregates that are folds, which must be mergeable)."""

    def read() -> tuple[DataFrame, list[Fold]]:
        table = gathered(catalog.metrics.select(F.col("plan_id").alias("metering_plan_id"), "metric", F.col("aggregate").alias("_by")).where("_by IS NOT NULL"))
        _, exprs = resolved(catalog.metrics.select("aggregate"), ["aggregate"])
        folds = [aggregate_of(a) for a in exprs["aggregate"] if a not in AGGREGATES]
        return table, folds

    return catalog.kept("aggregates", read)


def aggregate_of(text: str) -> Fold:
    """The mergeable fold that a plan's ``aggregate`` tells."""
    try:
        fold = fold_of(text)
    except ValueError:
        fold = None
    if fold is None or not fold.mergeable:
        raise ValueError(f"no such aggregate: {text[:200]}")
    return fold


def aggregate_tree(acc: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Instances per organization, space and consumer, all levels in one shuffle; ``level`` names the grouping.

    With a catalog, a metric's ``aggregate`` may be max, or last: the quantity of
    the latest arrival that changed an instance (``latest_ms`` of mergeable states);
    or a mergeable fold over the instances' quantities.
    """
    node = [*schemas.NODE, *WINDOW]
    three = ["organization_id", "space_id", "consumer_id"]
    timed, mean = F.col("accumulate") == "time_based", F.col("accumulate") == "avg"
    # The average of a node is that of all its usages; the state of a time-based one is summed in its quantity's place.
    more, quantity, folded = [], F.when(mean, F.col("_total") / F.col("n")).when(~timed, F.col("_total")), None
    if catalog is not None:
        table, folds = aggregate_folds(catalog)
        acc = acc.join(table, ["metering_plan_id", "metric"], "left").withColumn("_at", F.col("latest_ms") if "latest_ms" in acc.columns else F.lit(None).cast("long"))
        for fold in folds:
            part = _folded_tree(acc.where(F.col("_by") == fold.text), fold, three, node)
            folded = part if folded is None else folded.unionByName(part)
        if folds:
            acc = acc.where(~F.coalesce(F.col("_by").isin([f.text for f in folds]), F.lit(False)))
        more = [F.max("_by").alias("_by"), F.max("quantity").alias("_greatest"), F.max_by("quantity", "_at").alias("_last")]
        quantity = F.when(F.col("_by") == "max", F.col("_greatest")).when(F.col("_by") == "last", F.col("_last")).otherwise(quantity)
    tree = acc.groupingSets([[F.col(c) for c in lv + node] for lv in (three[:1], three[:2], three)], *three, *node).agg(
        exact_sum(F.when(timed, F.col("consuming")).when(mean, F.col("_sum")).otherwise(F.col("quantity"))).alias("_total"), F.sum(decimal(F.col("consumed"))).cast("double").alias("consumed"), F.sum("n").alias("n"),
        F.grouping("space_id").alias("_g1"), F.grouping("consumer_id").alias("_g2"), *more,
    )
    out = tree.select(*three, *node, quantity.alias("quantity"), F.when(timed, F.col("_total")).alias("consuming"), "consumed", _level().alias("level"))
    return out if folded is None else out.unionByName(folded)


def _level() -> Column:
    return F.when(F.col("_g1") == 1, "org").when(F.col("_g2") == 1, "space").otherwise("consumer")


def resource_tree(acc: DataFrame) -> DataFrame:
    """``rollup_resource`` of the tree, straight from the instances and in one shuffle: for metrics that a node sums over its instances. An average, which is not their sum, raises an error."""
    three, node = ["organization_id", "space_id", "consumer_id"], ["resource_id", "metric", "dimension", "bucket_ms"]
    summed = F.when(F.col("accumulate") == "avg", F.raise_error(F.lit("an average is rolled up from its tree")).cast("double")).when(F.col("accumulate") != "time_based", F.col("quantity"))
    tree = acc.groupingSets([[F.col(c) for c in lv + node] for lv in (three[:1], three[:2], three)], *three, *node).agg(exact_sum(summed).alias("quantity"), F.grouping("space_id").alias("_g1"), F.grouping("consumer_id").alias("_g2"))
    return tree.select(_level().alias("level"), *three, *node, F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def _folded_tree(acc: DataFrame, fold: Fold, three: list[str], node: list[str]) -> DataFrame:
    """The tree of metrics with an aggregate of their own: each instance's quantity is one x of the fold, in every level's node."""
    none = F.lit(None).cast("string")
    levels = F.array(*(F.struct(F.lit(name).alias("level"), *((F.col(c) if c in kept else none).alias(c) for c in three[1:])) for name, kept in (("org", ()), ("space", three[1:2]), ("consumer", three[1:]))))
    rows = acc.withColumn("_l", F.explode(levels)).select(
        "_l.*", three[0], *node, F.col("quantity").alias("value"), F.col("bucket_ms").alias("start_ms"), F.coalesce("_at", "bucket_ms").alias("end_ms"), F.col("bucket_ms").alias("from_ms"),
        bucket_end(F.col("dimension"), F.col("bucket_ms")).alias("to_ms"), F.coalesce("_at", "bucket_ms").alias("latest_ms"),
    )
    found = finish_states(fold_states(rows, fold, ["level", *three, *node]), fold)
    return found.select(*three, *node, "quantity", F.lit(None).cast("double").alias("consuming"), F.lit(None).cast("double").alias("consumed"), "level")


def rollup_resource(tree: DataFrame) -> DataFrame:
    """Totals of a resource over its plans; a time-based state has no number and counts 0."""
    return tree.groupBy("level", "organization_id", "space_id", "consumer_id", "resource_id", "metric", "dimension", "bucket_ms").agg(F.coalesce(exact_sum(F.col("quantity")), F.lit(0.0)).alias("quantity"))


def instance_refs(usage: DataFrame) -> DataFrame:
    """Instances per consumer, resource and plan with their last time and arrival."""
    return usage.groupBy("organization_id", "space_id", "consumer_id", "resource_id", "plan_id", "resource_instance_id").agg(F.max("end_ms").alias("t"), F.max_by("arrival_ms", F.struct("end_ms", "arrival_ms")).alias("p"))


def aggregate_last(acc: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The custom aggregate in which the last state wins."""
    return acc.groupBy(*keys).agg(F.max_by(value, order).alias(value))
