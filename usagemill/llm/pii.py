"""Personal data: overlapping candidates from high-recall generators, boosted trees, calibrated thresholds.

Everything is Spark functions inside one row, without a shuffle: generators are
regular expressions whose matches are located by the lengths of the pieces
between them, features are columns of a candidate, and the fitted trees are a
CASE expression. Trees are fitted on the driver from a bounded sample of
candidates of all kinds together. As no labels exist for this, they come from
where a candidate comes from: in half of the rows the base matches are disguised
first (spelled-out signs, other separators, no plus sign, see ``disguised``), and
a candidate is right if it is a base match of the row as it was, disguised or
not. Wrong is one whose plain form breaks its kind's rule (``plausible``) or that
touches a base span of another kind. What is neither, such as an address that the
text itself spells out, is in no label and is left for the trees to judge. These
see kind, format and context. The threshold of a kind is the least score at which
its held-back labelled candidates are right often enough.

The base spans (strict rules, see ``base_spans``) always stay. A candidate that
overlaps no base span is added if its score reaches the threshold of its kind;
of overlapping ones the best scored stays, and then the best of those that no
kept one overlaps, and so on.

Semantics for odd input: a null text is empty and has no spans; texts are
scanned whole; repeated rows are judged alike; with too few candidates of a
kind to calibrate on, none of it is added; an empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import BoostedTrees, fit

KINDS = ("email", "ip", "card", "phone")
#: Candidates of a kind that the trees are fitted on, at most, taken from all rows by their hash.
MAX_CANDIDATES = 8_000
#: Share of held-back candidates at or above a threshold that must be right, and how many of a kind must be held back.
PRECISION, LEAST_HELD_BACK = 0.97, 20
CONTEXT = 24
N_FEATURES = 19

_LOCAL = "A-Za-z0-9._%+-"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Base patterns, written so that no start is tried twice: the same leftmost matches in linear time. What a match
#: begins with is looked for before what must not stand in front of it, as most characters fail at the former.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators beyond the base patterns: spelled-out addresses, other separators, numbers without a plus sign.
MORE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:[\[({<]at[\])}>]|@) ?[a-z0-9-]++(?: ?(?:[\[({<]dot[\])}>]|\.) ?[a-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9.])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}+(?![0-9])|(?=[0-9A-Fa-f]{1,4}+:)(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ ./_-])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?=[0-9(])(?<![0-9+])(?<![0-9][ ().-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
_HINTS = {"email": r"(?i)mail|contact|write|kontakt|correo|courriel", "ip": r"(?i)\bip\b|host|server|addr|login|from", "card": r"(?i)card|visa|pay|credit|karte|tarjeta|carte", "phone": r"(?i)phone|tel|call|fax|mobil|cell|ruf"}


def _block_sums(lengths: Column) -> Column:
    """Sums before each element, in blocks of 128 so that long arrays stay cheap."""
    size = 128
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / size).cast("int")), lambda b: total(F.slice(lengths, b * size + 1, F.lit(size))))
    return F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 1),
        lambda i: total(F.slice(starts, F.lit(1), F.floor(i / size).cast("int"))) + total(F.slice(lengths, (F.floor(i / size) * size + 1).cast("int"), (i % size).cast("int"))),
    )


def matches(text: str, pattern: str, name: str, sign: Column | None = None) -> list[tuple[str, Column]]:
    """Steps (column, expression) that give ``name``: all matches as (s, e, m), in code points, end exclusive. A text without the ``sign`` that every match has is passed over."""
    hits, lens = f"_{name}_h", f"_{name}_l"
    searched = F.col(text) if sign is None else F.when(sign, F.col(text)).otherwise("")
    return [
        (hits, F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))),
        (lens, F.when(F.size(hits) > 0, F.flatten(F.zip_with(F.split(F.col(text), pattern, -1), F.col(hits), lambda g, h: F.array(F.length(g), F.coalesce(F.length(h), F.lit(0))))))),
        (lens, F.when(F.col(lens).isNotNull(), _block_sums(F.col(lens)))),
        (name, F.when(F.col(lens).isNotNull(), F.transform(F.col(hits), lambda h, i: F.struct(F.element_at(F.col(lens), i * 2 + 2).alias("s"), (F.element_at(F.col(lens), i * 2 + 2) + F.length(h)).alias("e"), h.alias("m")))).otherwise(F.expr("cast(array() AS array<struct<s:int,e:int,m:string>>)"))),
    ]


def _bound(f, first):
    """``f`` of one argument, the first one given; a lambda's default would count as the element's index."""
    return lambda c: f(first, c)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def holds(kind: str, m: Column) -> Column:
    """The strict rule of a kind for a whole match."""
    n = F.length(_digits(m))
    return {
        "email": m.rlike(rf"^[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"),
        "ip": m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": n.between(14, 19) & F.call_function("luhn_check", _digits(m)),
        "phone": m.startswith("+") & n.between(10, 15),
    }[kind]


def plausible(kind: str, m: Column) -> Column:
    """The rule of a kind for the plain form of a candidate, which need not be written as base spans are."""
    if kind == "email":
        return holds(kind, _undone(m))
    if kind == "ip":
        return holds(kind, F.regexp_replace(m, " ", "")) | m.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$")
    if kind == "phone":
        return F.length(F.regexp_replace(_digits(m), "^00", "")).between(10, 15)
    return holds(kind, m)


#: Disguises of base matches, by kind: pattern and replacement, two of each.
DISGUISES = {
    "email": ((r"(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])", " [at] "), (r"(?<=[A-Za-z0-9._%+-])@([A-Za-z0-9-]++)\.([A-Za-z0-9-]++)(?![.A-Za-z0-9-])", " (at) $1 (dot) $2")),
    "ip": ((r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])", "$1 . $2 . $3 . $4"), (r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])", "fe80:0:0:0:$1:$2:$3:$4")),
    "card": ((r"(?<![0-9])([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{2,7})(?![0-9])", "$1/$2/$3/$4"), (r"(?<![0-9])([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{2,7})(?![0-9])", "$1.$2.$3.$4")),
    "phone": ((r"\+[0-9]{1,3}[ .-]?(?=\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]))", ""), (r"\+(?=[0-9])", "00")),
}


def disguised(rows: DataFrame, style: Column) -> DataFrame:
    """The texts with what looks like base matches written otherwise, in one of two ways by ``style`` (0 or 1; others leave them as they are), where a row has matches of the kind (n_<kind>)."""
    text = F.col("text")
    # A column a kind: one expression for all would name the text again and again.
    for kind, ways in DISGUISES.items():
        of = F.when(F.col(f"n_{kind}") == 0, 2).otherwise(style)
        rows = rows.withColumn("text", F.when(of == 0, F.regexp_replace(text, *ways[0])).when(of == 1, F.regexp_replace(text, *ways[1])).otherwise(text))
    return rows


def _undone(m: Column) -> Column:
    """An address with its signs written out again."""
    for sign, word in (("@", "at"), (".", "dot")):
        m = F.regexp_replace(m, rf"(?i) ?[\[({{<]{word}[\])}}>] ?", sign)
    return m


def _same(kind: str, m: Column) -> Column:
    """What a match and its disguise have in common."""
    if kind == "email":
        return F.lower(_undone(m))
    if kind == "ip":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "^fe80:0:0:0:", ""), ":", "."), " ", "")
    return F.right(_digits(m), F.lit(9)) if kind == "phone" else _digits(m)


def _touches(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def _glued(c: Column, text: Column) -> Column:
    """Whether a letter or digit stands right before or after a candidate."""
    around = F.concat(F.substring(text, c["s"], F.when(c["s"] > 0, F.lit(1)).otherwise(0)), F.lit(" "), F.substring(text, c["e"] + 1, F.lit(1)))
    return around.rlike(r"[\p{L}\p{N}]")


def _features(kind: str, c: Column, text: Column) -> list[Column]:
    """Kind, format and context of a candidate (s, e, m). None of them is the strict rule."""
    m, before = c["m"], F.substring(text, F.greatest(c["s"] - CONTEXT + 1, F.lit(1)), F.least(c["s"], F.lit(CONTEXT)))
    last, next_ = F.substring(text, c["s"], F.when(c["s"] > 0, F.lit(1)).otherwise(0)), F.substring(text, c["e"] + 1, F.lit(1))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        *(F.lit(float(k == kind)) for k in KINDS), F.length(m).cast("double"), count("[0-9]"), F.size(groups).cast("double"), count("[^0-9A-Za-z]"), count("[A-Za-z]"),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        count(" "), count("@"), count(r"\."), flag(m.startswith("+")), flag(m.startswith("0")),
        flag(before.rlike(_HINTS[kind])), flag(last.rlike(r"[\p{L}\p{N}_=/\"'.]")), flag(next_.rlike(r"[\p{L}\p{N}_=/\"'@]")),
    ]


def _located(documents: DataFrame, key: str, text: str, more: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, text, ``keep``, and for each kind its base matches b_<kind> that hold, how many match the pattern alone (n_<kind>), and candidates c_<kind>."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    seen = F.col("text")
    signs = {"b_email": seen.contains("@"), "b_phone": seen.contains("+"), "c_email": seen.contains("@") | seen.rlike(r"[\[({<][aA][tT][\])}>]")}
    found = {f"b_{kind}": BASE[kind] for kind in KINDS} | ({f"c_{kind}": MORE[kind] for kind in KINDS} if more else {})
    # All kinds go step by step together.
    for step in zip(*(matches("text", pattern, name, signs.get(name)) for name, pattern in found.items()), strict=True):
        rows = rows.withColumns(dict(step))
    held = {f"b_{kind}": F.filter(f"b_{kind}", _bound(lambda k, c: holds(k, c["m"]), kind)) for kind in KINDS}
    # A part of a longer word, such as a run of digits in a hash, is no candidate.
    whole = {f"c_{kind}": F.filter(f"c_{kind}", lambda c: ~_glued(c, F.col("text"))) for kind in KINDS if more}
    counts = {f"n_{kind}": F.size(f"_b_{kind}_h") for kind in KINDS}
    return rows.withColumns(held | whole | counts).drop(*(f"_{name}_{x}" for name in found for x in "hl"))


@dataclass
class Redactor:
    """Trees and threshold by kind; a kind that could not be fitted adds no spans."""

    trees: dict[str, BoostedTrees]
    thresholds: dict[str, float]


def fit_redactor(documents: DataFrame, key: str = "doc_id", text: str = "text") -> Redactor:
    """Fits on at most MAX_CANDIDATES labelled candidates of each kind, chosen from all rows by their hash.

    Two thirds of the candidates fit the trees that all kinds share, and a third calibrates the threshold of each.
    """
    plain = _located(documents, key, text, False)
    known = {k: F.transform(f"b_{k}", _bound(lambda kind, c: _same(kind, c["m"]), k)).alias(f"known_{k}") for k in KINDS}
    style = F.pmod(F.xxhash64("key", F.lit("style")), F.lit(4))
    rows = disguised(plain.withColumn("style", style), F.col("style")).select("key", "text", *known.values())
    sample = _located(rows, "key", "text", True, tuple(f"known_{k}" for k in KINDS))
    both = {kind: F.array_union(f"b_{kind}", f"c_{kind}") for kind in KINDS}
    others = {kind: F.concat(*(F.col(f"b_{k}") for k in KINDS if k != kind)) for kind in KINDS}
    right = lambda k, c: F.when(F.array_contains(F.col(f"known_{k}"), _same(k, c["m"])), 1).when(~plausible(k, c["m"]) | _touches(others[k], c), 0)
    hashed = lambda c: F.xxhash64(F.col("key"), c["s"], c["e"], c["m"])
    # About how many there are, by the rows of a sixteenth of the keys.
    totals = sample.where(F.pmod(F.xxhash64("key", F.lit("total")), F.lit(16)) == 0).agg(*(F.sum(F.size(both[k])).alias(k) for k in KINDS)).first()
    # Somewhat more than are taken, so that the window sees a bounded number of each kind.
    share = {k: int(min(1.0, 2 * MAX_CANDIDATES / max(16 * (totals[k] or 0), 1)) * (1 << 40)) for k in KINDS}
    candidate = lambda k, c: F.struct(F.lit(k).alias("kind"), F.array(*_features(k, c, F.col("text"))).alias("x"), right(k, c).alias("y"), hashed(c).alias("h"))
    few = {k: F.filter(both[k], _bound(lambda n, c: F.pmod(hashed(c), F.lit(1 << 40)) < n, share[k])) for k in KINDS}
    named = [F.transform(few[k], _bound(candidate, k)) for k in KINDS]
    labelled = sample.select(F.explode(F.concat(*named)).alias("c")).select("c.*").where("y IS NOT NULL")
    got = labelled.select("*", F.row_number().over(Window.partitionBy("kind").orderBy(F.pmod("h", F.lit(1 << 40)), "h")).alias("n")).where(F.col("n") <= MAX_CANDIDATES).orderBy("kind", "n").collect()
    out, rows, held = Redactor({}, {}), [], []
    for kind in KINDS:
        mine = [r for r in got if r["kind"] == kind]
        rows += mine
        held += [i % 3 == 2 for i in range(len(mine))]
    kept = np.array(held, bool)
    x, y, kinds = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float), np.array([r["kind"] for r in rows])
    if kept.sum() < LEAST_HELD_BACK or y[~kept].min() == y[~kept].max():
        return out
    trees = fit(x[~kept], y[~kept], trees=20, depth=3, rate=0.3)
    for kind in KINDS:
        mine = kept & (kinds == kind)
        if mine.sum() < LEAST_HELD_BACK:
            continue
        score, is_right = trees.margin(x[mine]), y[mine]
        order = np.argsort(-score, kind="stable")
        good = np.cumsum(is_right[order]) / np.arange(1, mine.sum() + 1)
        last = np.flatnonzero((good >= PRECISION) & (np.append(score[order][1:], -np.inf) < score[order]))
        if len(last):
            # Sums of the same leaves may round differently on the two sides.
            out.trees[kind], out.thresholds[kind] = trees, float(score[order][last[-1]]) - 1e-9
    return out


def best_of(scored: Column) -> Column:
    """Spans of (score, span), best first, that touch none kept before."""
    ranked = F.sort_array(F.transform(scored, lambda c: F.struct(c["score"].alias("score"), (-c["span"]["s"]).alias("s"), (-c["span"]["k"]).alias("k"), (-c["span"]["e"]).alias("e"), c["span"].alias("span"))), asc=False)
    spans = F.transform(ranked, lambda c: c["span"])
    return F.aggregate(spans, F.filter(spans, lambda c: F.lit(False)), lambda kept, c: F.when(_touches(kept, c), kept).otherwise(F.array_append(kept, c)))


def find_personal_data(documents: DataFrame, redactor: Redactor, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: key, base and spans, arrays of (s, k, e, kind) in order; k is the kind's place in KINDS."""
    rows = _located(documents, key, text, bool(redactor.trees))
    kind_of = lambda kind, c: F.struct(c["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), c["e"].alias("e"), F.lit(kind).alias("kind"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(F.transform(f"b_{k}", _bound(kind_of, k)) for k in KINDS))))
    added = []
    for kind, trees in redactor.trees.items():
        # Scored only where nothing that the base found is touched.
        free = F.filter(f"c_{kind}", lambda c: ~_touches(F.col("base"), c))
        seen = lambda k, c: F.struct(F.array(*_features(k, c, F.col("text"))).alias("x"), kind_of(k, c).alias("span"))
        score = lambda t, c: F.struct(t.column([c["x"][j] for j in range(N_FEATURES)]).alias("score"), c["span"].alias("span"))
        scored = F.transform(F.transform(free, _bound(seen, kind)), _bound(score, trees))
        added.append(F.filter(scored, _bound(lambda least, c: c["score"] >= least, redactor.thresholds[kind])))
    if added:
        rows = rows.withColumn("_more", F.concat(*added) if len(added) > 1 else added[0])
        rows = rows.withColumn("spans", F.array_sort(F.concat("base", best_of(F.col("_more")))))
    else:
        rows = rows.withColumn("spans", F.col("base"))
    return rows.select(F.col("key").alias(key), "base", "spans", *([F.col("text").alias("_text")] if keep_text else []))


def of_kind(kind: str):
    """Picks the spans of a kind."""
    return lambda c: c["kind"] == kind


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(documents: DataFrame, redactor: Redactor, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and the text with every span replaced by its kind in brackets; spans that overlap go as one, named by the first."""
    found = find_personal_data(documents, redactor, key, text, keep_text=True)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda a, c: F.when(c["e"] <= a["at"], a).otherwise(F.struct(c["e"].alias("at"), F.when(c["s"] < a["at"], a["done"]).otherwise(F.concat(a["done"], F.substring(F.col("_text"), a["at"] + 1, c["s"] - a["at"]), F.lit("["), c["kind"], F.lit("]"))).alias("done")))
    return found.select(key, F.aggregate("spans", start, step, lambda a: F.concat(a["done"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text")))).alias("redacted"))
