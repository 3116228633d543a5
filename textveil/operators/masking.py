"""Masking of texts by their spans, and restoring of tokens, as gap and token splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.text import bind, json_inner, normalize_type
from textveil.operators import mapping as m
from textveil.operators import spans as sp


def splice(text: Column, spans: Column, tokens: Column) -> Column:
    """The text with each span (disjoint, in order) replaced by its token."""
    pairs = F.zip_with(spans, tokens, lambda s, k: F.struct(s["start"].alias("start"), s["end"].alias("end"), k.alias("token")))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, x["token"]).alias("out"))

    end = lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(pairs, first, step, end)).otherwise(text)


def mask(rows: DataFrame, keys: list[str], order: list[str], scope: list[str], skip: tuple[str, ...] = (), mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(masked, mapping) of rows (keys, order..., scope..., text, spans).

    masked has masked (the text), n_masked and residual (spans that the skip list leaves).
    Values join their tokens by (scope, type, value); each text's spans come back by its keys.
    """
    rows = rows.withColumn("__mask", sp.to_mask(F.col("spans"), skip))
    head = list(dict.fromkeys([*keys, *order, *scope]))
    one = rows.select(*head, F.posexplode("__mask").alias("__ord", "__s"))
    one = one.select("*", normalize_type(F.col("__s.type")).alias("type"), F.col("__s.text").alias("value"), F.col("__s.start").alias("__start"))
    sights = one.select(*head, "type", "value", F.col("__start").alias("start"))
    table = m.build(sights, [*order, "start"], scope) if mapping is None else m.extend(mapping, sights, [*order, "start"], scope)
    tokens = one.join(table.select(*scope, "type", "value", "token"), [*scope, "type", "value"])
    tokens = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__ord", "token"))).alias("__t"))
    masked = rows.join(tokens, keys, "left")
    texts = F.when(F.col("__t").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("__mask"), F.transform("__t", lambda t: t["token"])))
    masked = masked.withColumns({"masked": texts, "n_masked": F.size("__mask").cast("long"), "residual": sp.residual(F.col("spans"), skip)})
    return masked.drop("__t", "__mask"), table


def restored(text: Column, values: Column, for_json: bool = False) -> Column:
    """(text, restored, unknown): known tokens of a text as their values, from a map column."""
    gaps = F.split(text, m.TOKEN, -1)
    looked = F.transform(F.regexp_extract_all(text, F.lit(f"({m.TOKEN})"), F.lit(1)), lambda t: F.struct(t.alias("t"), F.try_element_at(values, t).alias("v")))

    def spliced(found: Column) -> Column:
        shown = F.transform(found, lambda x: F.coalesce(json_inner(x["v"]) if for_json else x["v"], x["t"]))
        parts = F.zip_with(gaps, shown, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
        known = F.size(F.filter(found, lambda x: x["v"].isNotNull())).cast("long")
        return F.struct(F.array_join(parts, "").alias("text"), known.alias("restored"), (F.size(found) - known).alias("unknown"))

    return bind(looked, spliced)


def restore(rows: DataFrame, mapping: DataFrame, keys: list[str], scope: list[str], text: str = "text", for_json: bool = False) -> DataFrame:
    """rows with restored_text, restored and unknown; tokens join the mapping by (scope, token),
    so it may be of any size. A row without tokens passes as it is."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(f"({m.TOKEN})"), F.lit(1))
    one = rows.select(*dict.fromkeys([*keys, *scope]), F.explode(F.array_distinct(tokens)).alias("token"))
    known = one.join(mapping.select(*scope, "token", "value"), [*scope, "token"])
    known = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__v"))
    out = rows.join(known, keys, "left").withColumn("__v", F.coalesce("__v", F.expr("map()").cast("map<string,string>")))
    out = out.withColumn("__r", restored(F.col(text), F.col("__v"), for_json))
    return out.withColumns({"restored_text": F.col("__r.text"), "restored": F.col("__r.restored"), "unknown": F.col("__r.unknown")}).drop("__r", "__v")


def restore_body(body: Column, values: Column) -> Column:
    """Bytes of a JSON reply with tokens restored, or as they are where they aren't UTF-8."""
    done = restored(F.decode(body, "UTF-8"), values, for_json=True)["text"]
    return F.when(F.try_validate_utf8(body.cast("string")).isNotNull(), F.encode(done, "UTF-8")).otherwise(body)
