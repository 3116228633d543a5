"""Rule detectors: patterns, checks and offsets in built-in expressions.

Each detector is gated by a cheap test that its matches imply; only texts that pass
run the pattern, and only texts with matches are split to find offsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions import risk as r
from textveil.functions import text as t
from textveil.operators import spans as sp

_ALNUM = ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])")
_DIGIT = (r"(?<!\p{Nd})", r"(?!\p{Nd})")


@dataclass(frozen=True)
class Detector:
    """A type, its pattern, confidence, check of a candidate, and gate of a text."""

    kind: str
    pattern: str
    confidence: float
    check: Callable[[Column], Column] | None
    gate: str


# In the order in which their spans are joined.
DETECTORS: tuple[Detector, ...] = (
    Detector("TW_ID", rf"{_ALNUM[0]}[A-Za-z]\p{{Nd}}{{9}}{_ALNUM[1]}", 0.99, t.valid_tw_id, r"[A-Za-z]\p{Nd}{9}"),
    Detector("TW_TAX", rf"{_ALNUM[0]}\p{{Nd}}{{8}}{_ALNUM[1]}", 0.95, t.valid_tw_tax, r"\p{Nd}{8}"),
    Detector("TW_NHI", rf"{_ALNUM[0]}\p{{Nd}}{{12}}{_ALNUM[1]}", 0.6, t.valid_tw_nhi, r"\p{Nd}{12}"),
    Detector("TW_PHONE_M", rf"{_DIGIT[0]}09\p{{Nd}}{{2}}-?\p{{Nd}}{{3}}-?\p{{Nd}}{{3}}{_DIGIT[1]}", 0.9, t.valid_tw_phone_m, r"09\p{Nd}{2}"),
    Detector("TW_PHONE_L", rf"{_DIGIT[0]}\(?0[2-8]\p{{Nd}}{{0,2}}\)?(?:-|{t.SPACE})?\p{{Nd}}{{3,4}}-?\p{{Nd}}{{3,4}}{_DIGIT[1]}", 0.85, t.valid_tw_phone_l, r"0[2-8]"),
    Detector("EMAIL", rf"(?<![A-Za-z0-9._%+-]){t.EMAIL}(?![A-Za-z0-9._%+-])", 0.95, None, "@"),
    Detector("CREDIT_CARD", rf"{_ALNUM[0]}\p{{Nd}}(?:[ -]?\p{{Nd}}){{12,18}}{_ALNUM[1]}", 0.95, t.valid_credit_card, r"\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}"),
)
KEY_CONFIDENCE = 0.9
KEY_PATTERN = rf"(?<![A-Za-z0-9_-]){t.KEY}(?![A-Za-z0-9_-])"
KEY_GATE = "sk-|ghp_|AKIA|AIza|xox|eyJ"
# group 1 is what stands before the value, group 2 the value
ASSIGNMENT = rf"(?iu)((?<![\p{{L}}\p{{N}}_])(?:API[_-]?KEY|TOKEN|PASSWORD){t.SPACE}*={t.SPACE}*['\"]?)([A-Za-z0-9_\-./+]{{6,}})['\"]?"


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (start, text) of the pattern's matches, left to right."""
    none = F.expr("array()").cast("array<struct<start:int,text:string>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), x["m"].alias("text"))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
        return F.when(F.size(found) > 0, F.aggregate(pairs, first, step, lambda acc: acc["out"])).otherwise(none)

    return F.when(gate, t.bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _spans(found: Column, kind: str, confidence: float) -> Column:
    return F.transform(
        found,
        lambda m, i: sp.span(m["start"], m["start"] + F.length(m["text"]), F.lit(kind), m["text"], F.lit(confidence), F.lit("rule"), F.concat(F.lit(f"[{kind}_"), (i + 1).cast("string"), F.lit("]"))),
    )


def detect(text: Column, d: Detector) -> Column:
    found = matches(text, d.pattern, F.contains(text, F.lit(d.gate)) if d.gate == "@" else text.rlike(d.gate))
    if d.check:
        found = F.filter(found, lambda m: d.check(m["text"]))
    return _spans(found, d.kind, d.confidence)


def detect_api_key(text: Column) -> Column:
    """Vendor tokens and assigned values; of those that overlap the earlier, then longer stays."""
    gate = F.contains(text, F.lit("="))
    whole = matches(text, ASSIGNMENT, gate)
    before = F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(2))
    heads = F.zip_with(before, value, lambda b, v: F.struct(b.alias("b"), v.alias("v")))
    shifted = lambda w: F.zip_with(w, heads, lambda m, x: F.struct((m["start"] + F.length(x["b"])).alias("start"), x["v"].alias("text")))
    assigned = t.bind(whole, lambda w: F.when(F.size(w) > 0, shifted(w)).otherwise(w))
    tokens = matches(text, KEY_PATTERN, text.rlike(KEY_GATE))
    order = F.array_sort(F.transform(F.concat(tokens, assigned), lambda m: F.struct(m["start"].alias("start"), (-F.length(m["text"])).alias("size"), m["text"].alias("text"))))
    first = F.struct(F.lit(-1).alias("end"), F.expr("array()").cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        taken = F.struct((m["start"] + F.length(m["text"])).alias("end"), F.array_append(acc["out"], F.struct(m["start"].alias("start"), m["text"].alias("text"))).alias("out"))
        return F.when(m["start"] < acc["end"], acc).otherwise(taken)

    kept = F.aggregate(order, first, step, lambda acc: acc["out"])
    return _spans(kept, "API_KEY", KEY_CONFIDENCE)


def rule_spans(text: Column, detectors: tuple[Detector, ...] = DETECTORS, plain: Column | None = None) -> Column:
    """All detectors' spans of a text, in the detectors' order, not arbitrated.

    plain: the normalised text, where it is a column already.
    """
    plain = t.normalize_fullwidth(F.coalesce(text, F.lit(""))) if plain is None else plain
    found = F.concat(*(detect(plain, d) for d in detectors), detect_api_key(plain))
    return sp.reslice(found, F.coalesce(text, F.lit("")))


_columns: dict[tuple, Column] = {}


def _built(df: DataFrame, text: str, detectors: tuple[Detector, ...]) -> Column:
    """rule_spans over columns text and __plain: expressions cost more to build than to plan, so they are kept."""
    key = (df.sparkSession.sparkContext.applicationId, text, detectors)
    if key not in _columns:
        _columns[key] = rule_spans(F.col(text), detectors, F.col("__plain"))
    return _columns[key]


def detect_all(
    df: DataFrame,
    text: str = "text",
    extra: str | None = None,
    today: str | None = None,
    detectors: tuple[Detector, ...] = DETECTORS,
    allowed: tuple[str, ...] | None = None,
    strict: bool = True,
) -> DataFrame:
    """df with spans (arbitrated, renumbered) and combination_risk (null if its score is 0).

    extra: a column of model spans, filtered by the allowed types before arbitration;
    today: the date by which ages follow from years (the current date if None).
    """
    df = df.withColumn("__plain", t.normalize_fullwidth(F.coalesce(F.col(text), F.lit(""))))
    found = _built(df, text, detectors)
    if extra:
        outside = sp.keep_allowed(F.coalesce(F.col(extra).cast(sp.SPANS), sp.none()), allowed)
        found = F.concat(found, sp.validate(outside, strict))
    df = df.withColumn("__found", found).drop("__plain")
    df = df.withColumn("spans", sp.renumber(sp.resolve_overlaps(F.col("__found")))).drop("__found")
    scored = r.combination_risk(F.coalesce(F.col(text), F.lit("")), F.col("spans"), today)
    return df.withColumn("__risk", scored).withColumn("combination_risk", F.when(F.col("__risk.score") > 0, F.col("__risk"))).drop("__risk")
