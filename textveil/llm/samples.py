"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def held_out(doc_id: str, n: int, fold: int) -> Column:
    """Whether a row is of the held-out fold; a null id is of none, and is never learned from."""
    return F.coalesce(crc_mod(doc_id, n) == fold, F.lit(False)).alias("held_out")


def bounded(rows: DataFrame, group: str, key: list[str], limit: int, total: int | None = None) -> DataFrame:
    """About `limit` rows of each group at most, and `total` of all: those whose key hashes lowest.

    The share kept follows from one count by group; no group is sorted or moved.
    """
    counts = rows.groupBy(group).count().collect()
    limit = min(limit, (total or limit * max(1, len(counts))) // max(1, len(counts)))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(group) == F.lit(r[group]), F.lit(min(1.0, limit / r["count"]))).otherwise(share)
    unit = F.pmod(F.xxhash64(*key, F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(unit < share)
