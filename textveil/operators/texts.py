"""Chunking of long texts, memoised detection, model detectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.text import bind, fingerprint
from textveil.operators import spans as sp

CHUNK = 400
OVERLAP = 50
MIN_CONFIDENCE = 0.5
# Model types that rules cover, and letters that an address must have.
EXCLUDED = ("EMAIL", "MOBILE")
ADDRESS_LETTERS = "市縣區鄉鎮村里路街巷弄號樓段道"


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """(start, chunk) windows of a text; a text of at most `size` is one.

    The text is cut once into pieces that make up every window, so work follows its length.
    """
    n, step = F.length(text), size - overlap
    piece = math.gcd(size, step)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{piece}}}"), F.lit(0))

    def windows(cut: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.array_join(F.slice(cut, i * (step // piece) + 1, F.lit(size // piece)), "").alias("chunk")))

    return bind(pieces, windows)


def format_entities(entities: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Raw model entities (doc keys, chunk_start, entity_group, score, start, end, text of the entity)
    in document coordinates, without low scores, excluded types and unlikely addresses."""
    kind = F.upper("entity_group")
    rows = entities.filter((F.col("score") >= min_confidence) & ~kind.isin(*EXCLUDED))
    rows = rows.filter((kind != "ADDRESS") | F.col("text").rlike(f"[{ADDRESS_LETTERS}]"))
    return rows.withColumns({"type": kind, "start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start"), "confidence": F.col("score"), "source": F.lit("model")}).drop("entity_group", "score", "chunk_start")


def detect_model(df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[list[str]], list[list[tuple[str, float, int, int]]]]], min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(keys, spans) of a model: make() loads it once a worker; the model maps chunks, in
    batches over all documents, to (group, score, start, end). Contained spans go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            out = []
            for row, found in zip(pdf.itertuples(index=False), model(pdf["chunk"].tolist()), strict=True):
                head = tuple(row)[: len(keys)]
                out += [(*head, row.start, g, float(s), int(a), int(b), row.chunk[a:b]) for g, s, a, b in found]
            yield pd.DataFrame(out, columns=[*keys, "chunk_start", "entity_group", "score", "start", "end", "text"])

    parts = df.filter(F.col(text).isNotNull()).select(*keys, F.explode(chunks(F.col(text))).alias("c")).select(*keys, "c.start", "c.chunk")
    shape = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    raw = parts.mapInPandas(run, f"{shape}, chunk_start int, entity_group string, score double, start int, end int, text string")
    rows = format_entities(raw, min_confidence)
    one = sp.span(F.col("start"), F.col("end"), F.col("type"), F.col("text"), F.col("confidence"), F.col("source"), F.lit(None))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("spans")).withColumn("spans", sp.drop_contained(F.col("spans")))


def gazetteer(words: dict[str, str], score: float = 0.9) -> Callable[[], Callable[[list[str]], list[list[tuple[str, float, int, int]]]]]:
    """A model that finds given words of given groups: for tests, and where no model is at hand."""

    def make() -> Callable[[list[str]], list[list[tuple[str, float, int, int]]]]:
        import re

        pattern = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True))) or r"(?!)")
        return lambda texts: [[(words[x.group()], score, x.start(), x.end()) for x in pattern.finditer(t)] for t in texts]

    return make


def memoised(df: DataFrame, text: str, compute: Callable[[DataFrame, str], DataFrame], extra: str = "") -> DataFrame:
    """compute over distinct texts only, joined back by fingerprint: a text is worked on once."""
    marked = df.withColumn("__fp", fingerprint(F.coalesce(F.col(text), F.lit("")), extra))
    once = marked.select("__fp", F.coalesce(F.col(text), F.lit("")).alias(text)).dropDuplicates(["__fp"])
    done = compute(once, text).drop(text)
    return marked.join(done, "__fp").drop("__fp")


def cache_stats(lookups: DataFrame, order: list[str], extra: str = "") -> DataFrame:
    """hits, misses and hit_rate of looking texts up in turn, nothing being forgotten."""
    seen = lookups.withColumn("fp", fingerprint(F.col("text"), extra)).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("misses"))
    return total.select((F.col("all") - F.col("misses")).alias("hits"), "misses", F.when(F.col("all") > 0, (F.col("all") - F.col("misses")) / F.col("all")).otherwise(0.0).alias("hit_rate"))


def recent(events: DataFrame, keep: int = 100, since: int | None = None) -> DataFrame:
    """The last `keep` events by id, or of these the ones after an id."""
    last = events.orderBy(F.desc("id")).limit(keep)
    return last if since is None else last.filter(F.col("id") > since)


def traffic(arrivals: DataFrame, now: Column, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """count, first_at, last_at and seconds_since_last of arrivals."""
    out = arrivals.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("count"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return out.withColumn("seconds_since_last", now.cast("double") - F.col("last_at").cast("timestamp").cast("double"))


def last_of(rows: DataFrame, by: list[str], order: str, keep: int = 50) -> DataFrame:
    """The last `keep` rows of each group, in their order."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return rows.withColumn("__back", back).filter(F.col("__back") <= keep).drop("__back")


def first_arrival(arrivals: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """arrivals with is_first: the first of its key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(ts, tie))
    return arrivals.withColumn("is_first", n == 1)
