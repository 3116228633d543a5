"""Span algebra on arrays of spans, as higher-order functions: no shuffle, no UDF.

A span is typed, positioned (code points, half open) and scored. Arrays are
arbitrated inside the row of their text, so work follows the texts, not their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.text import bind, normalize_type

SPAN = "struct<start:int,end:int,type:string,text:string,confidence:double,source:string,replacement:string>"
SPANS = f"array<{SPAN}>"


def none() -> Column:
    return F.expr("array()").cast(SPANS)


def span(start: Column, end: Column, kind: Column, text: Column, confidence: Column, source: Column, replacement: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"), text.alias("text"),
        confidence.cast("double").alias("confidence"), source.alias("source"), replacement.cast("string").alias("replacement"),
    )


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve_overlaps(spans: Column) -> Column:
    """Greedy: longest first, then most confident, then rules before models, then as they come.

    Texts whose spans are disjoint already (nearly all) skip the quadratic fold.
    """
    return bind(spans, _resolve)


def _resolve(spans: Column) -> Column:
    ranked = F.transform(
        spans,
        lambda s, i: F.struct((s["start"] - s["end"]).alias("size"), (-s["confidence"]).alias("doubt"), F.when(s["source"] == "rule", 0).otherwise(1).alias("rank"), i.alias("at"), s.alias("s")),
    )
    order = F.array_sort(ranked)
    chosen = F.aggregate(
        F.transform(order, lambda r: r["s"]),
        none(),
        lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.array_append(kept, s)),
    )

    def disjoint(ordered: Column) -> Column:
        beside = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: a["end"] > b["start"])
        return F.when(F.exists(beside, lambda x: F.coalesce(x, F.lit(False))), F.array_sort(chosen)).otherwise(ordered)

    return F.when(F.size(spans) <= 1, spans).otherwise(bind(F.array_sort(spans), disjoint))


def renumber(spans: Column) -> Column:
    """[TYPE_k] by order of start within the type, from 1; spans must be in order."""
    return bind(spans, _renumber)


def _renumber(spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s, i: s.withField("replacement", F.concat(F.lit("["), s["type"], F.lit("_"), F.size(F.filter(F.slice(spans, 1, i + 1), lambda x: x["type"] == s["type"])).cast("string"), F.lit("]"))),
    )


def keep_allowed(spans: Column, allowed: tuple[str, ...] | None) -> Column:
    """Spans of allowed types, by normalised type; an empty list allows all. Null stays null."""
    if not allowed:
        return spans
    return F.filter(spans, lambda s: normalize_type(s["type"]).isin(*allowed))


def to_mask(spans: Column, skip: tuple[str, ...]) -> Column:
    """Spans whose normalised type isn't on the skip list."""
    return F.filter(spans, lambda s: ~normalize_type(s["type"]).isin(*skip)) if skip else spans


def residual(spans: Column, skip: tuple[str, ...]) -> Column:
    """Spans that masking skips, with their types normalised."""
    if not skip:
        return none()
    return F.transform(F.filter(spans, lambda s: normalize_type(s["type"]).isin(*skip)), lambda s: s.withField("type", normalize_type(s["type"])))


def chosen(spans: Column, picks: Column) -> Column:
    """The spans at the picked positions (from 0), as a user has ticked them; null picks all."""
    return F.when(picks.isNull(), spans).otherwise(F.filter(spans, lambda _, i: F.array_contains(picks, i)))


def sound(s: Column) -> Column:
    """Whether an external span has a confidence, a known source and a positive length."""
    return F.coalesce(s["confidence"].isNotNull() & ~F.isnan(s["confidence"]) & s["source"].isin("rule", "model") & (s["start"] < s["end"]), F.lit(False))


def validate(spans: Column, strict: bool = True) -> Column:
    """External spans; an unsound one raises, or (not strict) is left out."""
    if not strict:
        return F.filter(spans, sound)
    return F.when(F.exists(spans, lambda s: ~sound(s)), F.raise_error(F.lit("a span without confidence, of unknown source or without length"))).otherwise(spans)


def reslice(spans: Column, text: Column) -> Column:
    """Spans found on a normalised copy, with the original's text."""
    return F.transform(spans, lambda s: s.withField("text", F.substr(text, s["start"] + 1, s["end"] - s["start"])))


def drop_contained(spans: Column) -> Column:
    """Without spans inside another of their type (of equal ones the first stays), by start."""
    return bind(F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("at"))), _outermost)


def _outermost(numbered: Column) -> Column:

    def inside(x: Column, k: Column) -> Column:
        wider = (k["s"]["end"] - k["s"]["start"]) > (x["s"]["end"] - x["s"]["start"])
        same = (k["s"]["end"] - k["s"]["start"]) == (x["s"]["end"] - x["s"]["start"])
        return (k["s"]["type"] == x["s"]["type"]) & (k["s"]["start"] <= x["s"]["start"]) & (x["s"]["end"] <= k["s"]["end"]) & (wider | (same & (k["at"] < x["at"])))

    kept = F.filter(numbered, lambda x: ~F.exists(numbered, lambda k: inside(x, k)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), x["at"].alias("at"), x["s"].alias("s")))), lambda x: x["s"])


def exploded(df: DataFrame, spans: str, *keys: str) -> DataFrame:
    """One row for each span: keys, ord (from 0) and the span's fields."""
    return df.select(*keys, F.posexplode(spans).alias("ord", "s")).select(*keys, "ord", "s.*")
