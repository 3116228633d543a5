"""First-seen numbering of values, and the lookups that masking and restoring need.

A mapping is a table (scope, type, value, n, token, first): within a scope, the nth
distinct value of a type has token [TYPE_n], for good. Values are reduced to their
first sight before any ordering, so repeats (the common case) never reach the sort;
numbers of one (scope, type) are dense by definition and are one window's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.text import normalize_type

IDLE_SECONDS = 1800
TTL_HOURS = 12
TOKEN = r"\[[A-Z][A-Z_]*_\p{Nd}+\]"
MAX_TOKEN = 64


def idle_sessions(calls: DataFrame, scope: str = "scope", ts: str = "ts", tie: str | None = None, seconds: int | None = IDLE_SECONDS) -> DataFrame:
    """calls with session: it grows by one after a gap of more than `seconds` between masking calls."""
    if not seconds:
        return calls.withColumn("session", F.lit(0).cast("long"))
    w = Window.partitionBy(scope).orderBy(*([ts, tie] if tie else [ts]))
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double")
    return calls.withColumn("__new", F.when(gap > seconds, 1).otherwise(0)).withColumn("session", F.sum("__new").over(w).cast("long")).drop("__new")


def build(sightings: DataFrame, order: list[str], scope: list[str]) -> DataFrame:
    """The mapping of sightings (scope..., type, value, order...): first-seen numbers and tokens."""
    rows = sightings.withColumn("type", normalize_type(F.col("type")))
    first = rows.groupBy(*scope, "type", "value").agg(F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(Window.partitionBy(*scope, "type").orderBy("first", "value"))
    first = first.withColumn("n", n.cast("long"))
    return first.withColumn("token", F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("n").cast("string"), F.lit("]")))


def extend(mapping: DataFrame, sightings: DataFrame, order: list[str], scope: list[str]) -> DataFrame:
    """The mapping with the values of new sightings numbered after those it has."""
    rows = sightings.withColumn("type", normalize_type(F.col("type")))
    new = rows.join(mapping.select(*scope, "type", "value"), [*scope, "type", "value"], "left_anti")
    known = mapping.groupBy(*scope, "type").agg(F.max("n").alias("__top"))
    added = build(new, order, scope).join(known, [*scope, "type"], "left")
    added = added.withColumn("n", F.col("n") + F.coalesce("__top", F.lit(0))).drop("__top")
    added = added.withColumn("token", F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("n").cast("string"), F.lit("]")))
    return mapping.unionByName(added, allowMissingColumns=True)


def live(states: DataFrame, now: Column, updated: str = "updated_at", hours: int = TTL_HOURS) -> DataFrame:
    """States updated within the last `hours` (exactly that old is live)."""
    return states.filter(now.cast("double") - F.col(updated).cast("timestamp").cast("double") <= hours * 3600)


def issued_counts(mapping: DataFrame, scope: list[str]) -> DataFrame:
    return mapping.groupBy(*scope, "type").agg(F.max("n").alias("issued"))


def new_value_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Growth of issued counts between two snapshots; after a reset, all that there is."""
    b, a = before.withColumnRenamed("issued", "b"), after.withColumnRenamed("issued", "a")
    both = a.join(b, keys, "left").withColumn("b", F.coalesce("b", F.lit(0)))
    return both.select(*keys, F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - F.col("b")).alias("added")).filter("added > 0")
