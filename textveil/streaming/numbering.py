"""Online first-seen numbering: a scope is one key, so no number is given twice.

State of a scope: when it was last masked, the last number of each type and the values'
numbers. A longer pause than the idle time, whatever the type, forgets all of the scope
before numbering goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textveil.functions.text import normalize_type
from textveil.operators.mapping import IDLE_SECONDS

OUT = "scope string, type string, value string, n long, token string"


class Numbering(StatefulProcessor):
    def __init__(self, idle: int | None = IDLE_SECONDS):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.masked = handle.getValueState("masked", "at double")
        self.last = handle.getMapState("last", "type string", "n long")
        self.numbers = handle.getMapState("numbers", "type string, value string", "n long")

    def _number(self, kind: str, value: str) -> int:
        if self.numbers.containsKey((kind, value)):
            return self.numbers.getValue((kind, value))[0]
        n = (self.last.getValue((kind,))[0] if self.last.containsKey((kind,)) else 0) + 1
        self.last.updateValue((kind,), (n,))
        self.numbers.updateValue((kind, value), (n,))
        return n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.masked.get()[0] if self.masked.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "ord"]).itertuples(index=False):
            if self.idle and before is not None and r.at - before > self.idle:
                self.last.clear()
                self.numbers.clear()
            before = float(r.at)
            n = self._number(r.type, r.value)
            out.append((key[0], r.type, r.value, n, f"[{r.type}_{n}]"))
        self.masked.update((before,))
        yield pd.DataFrame(out, columns=["scope", "type", "value", "n", "token"])

    def close(self) -> None:
        pass


def number(sightings: DataFrame, idle: int | None = IDLE_SECONDS) -> DataFrame:
    """A stream (scope, type, value, ts, ord) with n and token; needs the RocksDB state store."""
    rows = sightings.select("scope", normalize_type(F.col("type")).alias("type"), "value", F.col("ts").cast("double").alias("at"), "ord")
    return rows.groupBy("scope").transformWithStateInPandas(Numbering(idle), OUT, "append", "none")
