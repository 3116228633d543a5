"""Server-sent events: byte chunks to events and channels, in batch, with built-ins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(key, body): each stream's chunks (binary) in order, decoded once they are whole."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.hex(chunk).alias("h"))))
    return chunks.groupBy(key).agg(F.decode(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")), "UTF-8").alias("body"))


def events(bodies: DataFrame, key: str = "stream_id", body: str = "body") -> DataFrame:
    """(key, ord, data, obj): the data lines of events, in order; obj is null if it isn't JSON."""
    blocks = bodies.select(key, F.posexplode(F.split(body, "\n\n")).alias("b", "block"))
    lines = blocks.select(key, "b", F.posexplode(F.split("block", "\n")).alias("l", "line")).filter(F.startswith("line", F.lit("data: ")))
    data = F.substr("line", F.lit(7))
    return lines.select(key, F.struct("b", "l").alias("ord"), data.alias("data"), F.try_parse_json(data).alias("obj"))


def is_done(data: Column) -> Column:
    return F.trim(data) == "[DONE]"


def is_terminal(kind: Column) -> Column:
    """Whether a response event's type ends an item or the response."""
    return F.coalesce(kind.rlike(r"\Aresponse\..*(\.done|\.completed)\z") | kind.rlike(r"\Aresponse\.(done|completed)\z"), F.lit(False))


def deltas(found: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, channel, ord, delta): text, each tool call's arguments, each response item's deltas."""
    get = lambda path, kind="string": F.try_variant_get("obj", path, kind)
    text = found.select(key, F.lit("content").alias("channel"), "ord", get("$.choices[0].delta.content").alias("delta"))
    calls = found.select(key, "ord", F.posexplode(get("$.choices[0].delta.tool_calls", "array<variant>")).alias("p", "c"))
    call = lambda path, kind: F.try_variant_get("c", path, kind)
    calls = calls.select(key, F.concat(F.lit("tool:"), call("$.index", "int").cast("string")).alias("channel"), "ord", call("$.function.arguments", "string").alias("delta"))
    item = F.coalesce(get("$.item_id"), get("$.output_index"))
    response = found.filter(F.startswith(F.coalesce(get("$.type"), F.lit("")), F.lit("response.")) & F.endswith(get("$.type"), F.lit(".delta")))
    response = response.select(key, F.concat_ws(":", F.lit("resp"), item, get("$.content_index")).alias("channel"), "ord", get("$.delta").alias("delta"))
    return text.unionByName(calls).unionByName(response).filter("delta IS NOT NULL AND channel IS NOT NULL")


def texts(parts: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, channel, text): the deltas of a channel put together."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "delta")))
    return parts.groupBy(key, "channel").agg(F.array_join(F.transform(ordered, lambda p: p["delta"]), "").alias("text"))


OPEN_TAIL = r"\[[^\[\]]{0,63}\z"  # may yet become a token of 64 characters at most


def safe_deltas(parts: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, channel, ord, last, text): deltas cut anew, so that none ends within a token.

    What a delta holds back goes out with the next one of its channel; what the last one
    holds back is a row of its own (last) that belongs before the stream's or item's end.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "delta")))
    none = F.expr("array()").cast("array<struct<ord:struct<b:int,l:int>,last:boolean,text:string>>")
    first = F.struct(F.lit("").alias("held"), F.lit(None).cast("struct<b:int,l:int>").alias("ord"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        come = F.concat(acc["held"], x["delta"])
        held = F.regexp_extract(come, OPEN_TAIL, 0)
        safe = F.left(come, F.length(come) - F.length(held))
        return F.struct(held.alias("held"), x["ord"].alias("ord"), F.array_append(acc["out"], F.struct(x["ord"].alias("ord"), F.lit(False).alias("last"), safe.alias("text"))).alias("out"))

    def rest(acc: Column) -> Column:
        left = F.struct(acc["ord"].alias("ord"), F.lit(True).alias("last"), acc["held"].alias("text"))
        return F.when(acc["held"] != "", F.array_append(acc["out"], left)).otherwise(acc["out"])

    found = parts.groupBy(key, "channel").agg(ordered.alias("d")).select(key, "channel", F.explode(F.aggregate("d", first, step, rest)).alias("x"))
    return found.select(key, "channel", "x.ord", "x.last", "x.text").filter("text <> ''")


def frames(event: Column, data: Column) -> Column:
    """An event as it goes over the wire."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
