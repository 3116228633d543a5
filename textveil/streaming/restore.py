"""Streams of reply chunks, restored token by token; state is one buffer per stream.

What is held back: from the last [ on, while no ] follows it and it isn't longer
than a token can be. The stateful step only re-cuts chunks where no token is split;
tokens are then looked up natively, in a map column or by a stream-static join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textveil.operators.mapping import MAX_TOKEN


OPEN_TAIL = re.compile(rf"\[[^\[\]]{{0,{MAX_TOKEN - 1}}}\Z")


def cut(held: str) -> tuple[str, str]:
    """(safe to send, held back) of what has come: a tail that may yet become a token."""
    tail = OPEN_TAIL.search(held)
    return (held[: tail.start()], tail.group()) if tail else (held, "")


def _feed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, sent = state.get if state.exists else ("", 0)
    if state.hasTimedOut:
        state.remove()
        if held:
            yield pd.DataFrame({"stream_id": [key[0]], "part": [sent], "text": [held]})
        return
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for chunk, last in zip(rows["chunk"], rows["last"], strict=True):
        safe, held = cut(held + (chunk or ""))
        if last:
            safe, held = safe + held, ""
        if safe:
            out.append((key[0], sent, safe))
            sent += 1
    if bool(rows["last"].any()):
        state.remove()
    else:
        state.update((held, sent))
        state.setTimeoutDuration(600_000)
    yield pd.DataFrame(out, columns=["stream_id", "part", "text"])


def whole_tokens(chunks: DataFrame) -> DataFrame:
    """A stream (stream_id, seq, chunk, last) as (stream_id, part, text), no token split."""
    return chunks.groupBy("stream_id").applyInPandasWithState(
        _feed, "stream_id long, part long, text string", "held string, sent long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def idle_arrivals(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows of each user's events that a gap ends: count, first and last."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
        .select("user_id", "n", "first_at", "last_at")
    )
