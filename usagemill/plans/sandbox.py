"""What expressions of a plan may say: judged before any of them runs.

Plans come from tables that others write. An expression is parsed by Spark's own
parser; every node of its tree must be of an allowed kind, every function in
``FUNCTIONS`` (under its bare name), and every name one that the plan function
sees. So neither functions that reach the JVM, files or the session, nor user
functions, subqueries, windows, aggregates or other columns can be named. What
passes is analyzed against an empty table with those names, which tells of wrong
fields and types. ``catalog.picked`` and the folds refuse whatever was not judged.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that plans may call; all give a value of their arguments alone, of bounded size.
FUNCTIONS = frozenset(
    "abs ceil ceiling floor round bround sign signum sqrt cbrt exp ln log log10 log2 pow power pmod mod greatest least coalesce if ifnull nvl nvl2 nullif nanvl isnan isnull isnotnull"
    " between try_add try_subtract try_multiply try_divide try_mod div double bigint int float boolean string decimal named_struct struct map_contains_key try_element_at element_at"
    " size cardinality concat lower upper trim length".split()
)
#: Kinds of nodes besides functions and names.
NODES = frozenset(
    "Literal Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual"
    " In IsNull IsNotNull CaseWhen If Cast UnresolvedExtractValue LambdaFunction".split()
)
_NUMBERS = "quantity double, consuming double, consumed double"
#: What each plan function sees, as a schema. ``accumulate`` sees the state a and the usage x, ``merge`` two states a and b, ``finish`` one.
SEES = {
    "meter": "m map<string,double>, start_ms long, end_ms long",
    "summarize": f"t long, {_NUMBERS}, from_ms long, to_ms long",
    "rate": f"price double, {_NUMBERS}",
    "charge": f"t long, {_NUMBERS}, from_ms long, to_ms long, price double, cost double",
    "zero": "",
}
X = "value double, start_ms long, end_ms long, from_ms long, to_ms long, day double, month double"
#: Characters of an expression, and nodes of its tree.
MAX_CHARS, MAX_NODES = 10_000, 1_000


def names_seen(kind: str) -> frozenset[str]:
    return frozenset(re.findall(r"(\w+) (?:map|long|double|struct)", SEES[kind]))


@lru_cache(maxsize=10_000)
def refusal(text: str, names: frozenset[str]) -> str | None:
    """Why an expression is refused, or None; ``names`` are those it may use besides its own lambdas' parameters."""
    if len(text) > MAX_CHARS:
        return "too long"
    try:
        tree = SparkSession.active()._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException:
        return "syntax"
    todo, n = [(tree, names)], 0
    while todo:
        node, known = todo.pop()
        if (n := n + 1) > MAX_NODES:
            return "too long"
        kind, seen = node.getClass().getSimpleName(), known
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in FUNCTIONS or node.isDistinct() or node.filter().isDefined():
                return f"function not allowed: {name}"
        elif kind in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
            if (name := node.nameParts().apply(0)) not in known:
                return f"unknown name: {name}"
        elif "Subquery" in kind or kind in ("Exists", "ListQuery"):
            return "subquery"
        elif kind == "LambdaFunction":
            arguments = node.arguments()
            seen = known | {arguments.apply(i).nameParts().apply(0) for i in range(arguments.size())}
        elif kind not in NODES:
            return f"not allowed: {kind}"
        children = node.children()
        todo += [(children.apply(i), seen) for i in range(children.size())]
    return None


def safe(text: str, names: frozenset[str]) -> Column:
    """The expression as a column, if it may run; else an error."""
    if reason := refusal(text, names):
        raise ValueError(f"plan expression refused ({reason}): {text[:200]}")
    return F.expr(f"({text})")


def judged(text: str, kind: str) -> str | None:
    """Like ``refusal``, for a kind of plan function; what passes is also analyzed against an empty table with the names it sees."""
    if kind == "accumulate":
        from ..operators.folds import FOLDS, fold_of

        if text in FOLDS:
            return None
        try:
            return fold_of(text).refusal()
        except ValueError as e:
            return str(e)
    if kind == "aggregate":
        from ..operators.accumulate import AGGREGATES, aggregate_of

        if text in AGGREGATES:
            return None
        try:
            return aggregate_of(text).refusal()
        except ValueError as e:
            return str(e)
    if reason := refusal(text, names_seen(kind)):
        return reason
    schema = SEES[kind]
    return wrong_types(F.expr(f"({text})") if kind == "meter" else F.expr(f"({text})").cast("double"), schema)


def wrong_types(column: Column, schema: str) -> str | None:
    try:
        SparkSession.active().createDataFrame([], schema or "_none int").select(column)
    except AnalysisException as e:
        return f"does not fit: {e.getCondition() or 'analysis'}"
    return None


def expression_rejects(metrics: DataFrame, rating: DataFrame) -> DataFrame:
    """plan_id, metric, kind, expression and reason of every expression of a catalog that is refused.

    Each different expression is judged once; only these pass through the driver.
    """
    from .catalog import formula_columns, numbered

    out = None
    for table, kinds in ((formula_columns(metrics), ("meter", "accumulate", "aggregate", "summarize")), (rating, ("rate", "charge"))):
        for kind in kinds:
            told, exprs = numbered(table, kind)
            reasons = {i: r for i, e in enumerate(exprs) if (r := judged(e, kind))}
            if not reasons:
                continue
            reason = F.create_map(*(F.lit(x) for pair in reasons.items() for x in pair))[F.col(f"{kind}_n")]
            found = told.select("plan_id", "metric", F.lit(kind).alias("kind"), F.col(kind).alias("expression"), reason.alias("reason")).where("reason IS NOT NULL")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else metrics.sparkSession.createDataFrame([], "plan_id string, metric string, kind string, expression string, reason string")
