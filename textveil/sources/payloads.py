"""Request payloads: JSON of any shape flattened to (path, text) rows, and written back.

Payloads are untyped and recursive, and a path write has no built-in form, so both
are Arrow-batched pandas UDFs; all that happens to the texts in between is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators import detect, masking

SCANNED = r"(chat/completions|completions|embeddings|responses)$"
FIELDS = "array<struct<ord:int,path:string,text:string>>"
# Headers of one hop, and those that the upstream gets anew.
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers", "transfer-encoding", "upgrade", "host", "content-length")
REPLY_HEADERS = ("content-length", "content-encoding", "connection", "keep-alive", "transfer-encoding", "upgrade", "te", "trailer")

Path = tuple[str | int, ...]


def is_scanned(path: Column) -> Column:
    return path.rlike(SCANNED)


def is_event_stream(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("text/event-stream")), F.lit(False))


def upstream_headers(headers: Column, key: Column) -> Column:
    """Headers without those of one hop and with the upstream's own credentials."""
    kept = F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*HOP_HEADERS, "authorization", "x-api-key"))
    return F.map_concat(kept, F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer "), key)))


def agent_headers(headers: Column) -> Column:
    """Headers of an upstream's answer without those of one hop or of its encoding."""
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*REPLY_HEADERS))


def _texts(blocks: Any, at: Path) -> Iterator[tuple[Path, str]]:
    if isinstance(blocks, str):
        yield at, blocks
    elif isinstance(blocks, list):
        for i, b in enumerate(blocks):
            if isinstance(b, dict) and isinstance(b.get("text"), str):
                yield (*at, i, "text"), b["text"]


def leaves(value: Any, at: Path = ()) -> Iterator[tuple[Path, str]]:
    """Every string in a JSON value, in its order."""
    if isinstance(value, str):
        yield at, value
        return
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        yield from leaves(v, (*at, k))


def _message(m: Any, at: Path) -> Iterator[tuple[Path, str]]:
    if not isinstance(m, dict):
        return
    content = m.get("content")
    yield from _texts(content, (*at, "content"))
    for i, b in enumerate(content if isinstance(content, list) else ()):
        if not isinstance(b, dict):
            continue
        if b.get("type") == "tool_use" and isinstance(b.get("input"), dict):
            yield from leaves(b["input"], (*at, "content", i, "input"))
        elif b.get("type") == "tool_result":
            yield from _texts(b.get("content"), (*at, "content", i, "content"))
    calls = m.get("tool_calls")
    for i, c in enumerate(calls if isinstance(calls, list) else ()):
        f = c.get("function") if isinstance(c, dict) else None
        if isinstance(f, dict) and isinstance(f.get("arguments"), str):
            yield (*at, "tool_calls", i, "function", "arguments"), f["arguments"]


def fields(payload: Any) -> Iterator[tuple[Path, str]]:
    """(path, text) of every field that is scanned: messages, system, instructions, prompt, input."""
    if not isinstance(payload, dict):
        return
    messages = payload.get("messages")
    for i, m in enumerate(messages if isinstance(messages, list) else ()):
        yield from _message(m, ("messages", i))
    yield from _texts(payload.get("system"), ("system",))
    if isinstance(payload.get("instructions"), str):
        yield ("instructions",), payload["instructions"]
    for key in ("prompt", "input"):
        value = payload.get(key)
        if isinstance(value, str):
            yield (key,), value
        for i, item in enumerate(value if isinstance(value, list) else ()):
            if isinstance(item, str):
                yield (key, i), item
            elif isinstance(item, dict):
                for part in ("content", "arguments", "output"):
                    yield from _texts(item.get(part), (key, i, part))


def get_at(payload: Any, path: Path) -> Any:
    for k in path:
        payload = payload[k]
    return payload


def set_at(payload: Any, path: Path, value: Any) -> None:
    get_at(payload, path[:-1])[path[-1]] = value


def _parse(body: str | None) -> Any:
    try:
        return json.loads(body) if body else None
    except ValueError:
        return None


def _flatten(bodies: pd.Series) -> pd.Series:
    return pd.Series([[{"ord": i, "path": json.dumps(p), "text": t} for i, (p, t) in enumerate(fields(_parse(b)))] for b in bodies])


def _leaves(bodies: pd.Series) -> pd.Series:
    return pd.Series([[{"ord": i, "path": json.dumps(p), "text": t} for i, (p, t) in enumerate(leaves(_parse(b)))] for b in bodies])


def _rewrite(bodies: pd.Series, changes: pd.Series) -> pd.Series:
    out = []
    for body, changed in zip(bodies, changes, strict=True):
        payload = _parse(body)
        if payload is None or changed is None or not len(changed):
            out.append(body)  # nothing to do: not even written anew
            continue
        for c in changed:
            set_at(payload, tuple(json.loads(c["path"])), c["text"])
        out.append(json.dumps(payload, ensure_ascii=False))
    return pd.Series(out)


def flatten(body: Column) -> Column:
    """Array of (ord, path, text); malformed parts give nothing."""
    return F.pandas_udf(_flatten, FIELDS)(body)


def string_leaves(body: Column) -> Column:
    return F.pandas_udf(_leaves, FIELDS)(body)


def rewrite(body: Column, changes: Column) -> Column:
    """The payload with the texts of (path, text) changes; unchanged where there are none."""
    return F.pandas_udf(_rewrite, "string")(body, changes)


def scan(requests: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """(key, ord, path, text) of every field of scanned paths' payloads."""
    rows = requests.filter(is_scanned(F.col("path"))) if "path" in requests.columns else requests
    return rows.select(key, F.explode(flatten(F.col(body))).alias("f")).select(key, "f.*")


def mask_payloads(requests: DataFrame, scope: list[str], skip: tuple[str, ...] = ("POSITION", "COMPANY"), key: str = "request_id", body: str = "body", today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with masked_body, n_masked and residual_risk, mapping).

    The residual risk is that of the worst field of the masked payload: all fields
    count, also those without any span, each by what masking leaves in it.
    """
    found = detect.detect_all(scan(requests, key, body), today=today)
    fields_ = found.join(requests.select(key, *(s for s in scope if s != key)), key)
    masked, table = masking.mask(fields_, [key, "ord"], [key, "ord"], scope, skip)
    from textveil.functions.risk import combination_risk

    masked = masked.withColumn("risk", combination_risk(F.col("masked"), F.col("residual"), today))
    changes = F.filter(F.collect_list(F.struct("n_masked", "path", F.col("masked").alias("text"))), lambda c: c["n_masked"] > 0)
    worst = F.max(F.struct(F.col("risk.score").alias("score"), (-F.col("ord")).alias("first"), F.col("risk").alias("risk")))
    per = masked.groupBy(key).agg(changes.alias("__c"), F.sum("n_masked").alias("n_masked"), worst.alias("__w"))
    out = requests.join(per, key, "left").withColumn("masked_body", rewrite(F.col(body), F.transform("__c", lambda c: F.struct(c["path"].alias("path"), c["text"].alias("text")))))
    out = out.withColumns({"n_masked": F.coalesce("n_masked", F.lit(0)), "residual_risk": F.when(F.col("__w.score") > 0, F.col("__w.risk"))})
    return out.drop("__c", "__w"), table
