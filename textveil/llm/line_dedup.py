"""Line deduplication over levelled sorted runs of line hashes (native).

A line's key is the line without white space at both ends, A-Z lower-cased; keys under
`min_chars` code points are never dropped. Documents come in batches by a hash of their
id. LineRuns keeps sorted runs (h1, h2, n, last): 128 bits of a key's hash, how many
documents hold it, and the largest doc_id. A key stands in one run only:

1. A new batch's keys are merge-anti-joined with every run. What is left was never seen
   before, and becomes the batch's own run; what a run holds is an update of that run.
2. When `fanout` runs stand on a level they are compacted, with all updates so far, into
   one run of the next level. So a batch meets at most fanout - 1 runs of each level.
3. A key is frequent by its run's count and the updates since: updates merge-join the
   runs, and what they don't touch stands as it was.

A key found in at least `min_docs` documents keeps its lines in the largest doc_id only.

Defined results: null or empty text is one empty line; rows that repeat a doc_id are one
document when keys are counted, and are kept alike; rows with a null doc_id count for no
key and lose no line; an empty table gives no rows; other columns pass through, whatever
their names (n_chars, where there is one, is set anew where lines went).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import scratch
from textveil.llm.columns import unused

MIN_CHARS = 40
MIN_DOCS = 5
BATCH_BYTES = 1 << 30
BATCHES = (4, 64)  # at least, at most
FANOUT = 3

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_SPACE = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
_KEY = f"translate(trim(BOTH {_SPACE} FROM l), '{_UPPER}', '{_LOWER}')"
_LINES = "split(coalesce({text}, ''), '\n', -1)"
# The constant stands first: xxhash64 chains, so a trailing one would add nothing.
_HASH = "struct(xxhash64(k) AS h1, xxhash64(7, k) AS h2)"
KEY = ["h1", "h2"]


def postings(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): each long enough key of a row once."""
    keys = f"filter(transform({_LINES.format(text=f'`{text}`')}, l -> {_KEY}), k -> char_length(k) >= {int(min_chars)})"
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.explode(F.expr(f"array_distinct(transform({keys}, k -> {_HASH}))")).alias("h"))
    return rows.select("doc", "h.h1", "h.h2")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


class LineRuns:
    """Levelled runs of keys, and the updates of keys that they hold."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.updates: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of postings, of documents that no other batch has."""
        own = batch.distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
        if not self.runs():
            run = scratch.table(own.sortWithinPartitions(*KEY), "run")
        else:
            own = scratch.table(own.sortWithinPartitions(*KEY), "batch")
            fresh = own
            for held in self.runs():
                fresh = fresh.join(held.select(*KEY).hint("merge"), KEY, "left_anti")
            run = scratch.table(fresh.sortWithinPartitions(*KEY), "run")
            known = own.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
            self.updates.append(scratch.table(known.sortWithinPartitions(*KEY), "updates"))
            scratch.drop(own)
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        depth = 0
        while depth < len(self.levels):
            level = self.levels[depth]
            if len(level) >= self.fanout:
                rows, old = _union(level), list(level)
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                    if self.updates:  # the lowest level takes all: every key is in it or in a run above
                        held = _union(old).select(*KEY).withColumn("held", F.lit(True))
                        summed = _summed(_union(self.updates)).join(held.hint("merge"), KEY, "left")
                        summed = scratch.table(summed, "updates")
                        rows = _summed(rows.unionByName(summed.filter("held").drop("held")))
                        old += self.updates
                        self.updates = [summed.filter("held IS NULL").drop("held")]
                merged = scratch.table(rows.sortWithinPartitions(*KEY), "run")
                level.clear()
                self.levels[depth + 1].append(merged)
                scratch.drop(*old)
            depth += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, last) of keys that at least min_docs documents hold."""
        held = _union(self.runs())
        if self.updates:
            touched = _summed(_union(self.updates)).select(*KEY, F.col("n").alias("more"), F.col("last").alias("later"))
            grown = held.join(touched.hint("merge"), KEY).select(*KEY, (F.col("n") + F.col("more")).alias("n"), F.greatest("last", "later").alias("last"))
            held = held.filter(F.col("n") >= min_docs).join(touched.select(*KEY).hint("merge"), KEY, "left_anti").unionByName(grown)
        return held.filter(F.col("n") >= min_docs).select(*KEY, "last")


def _union(frames: list[DataFrame]) -> DataFrame:
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


def batch_count(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(BATCHES[0], min(BATCHES[1], -(-size // BATCH_BYTES)))


def frequent_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int, batches: int | None, fanout: int) -> DataFrame:
    """(doc, h1, h2) of the lines that go."""
    batches = batches or batch_count(docs, text)
    dealt = postings(docs, text, doc_id, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    held = scratch.table(dealt, "postings", partition_by="batch")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(held.filter(F.col("batch") == b).drop("batch"))
    frequent = scratch.table(runs.frequent(min_docs), "frequent")  # of known size; a hot key's postings can be split
    return held.join(frequent, KEY).filter(F.col("doc") < F.col("last")).select("doc", *KEY)


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int | None = None,
    fanout: int = FANOUT,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """docs with their kept lines as text; counts: names of columns for the number of lines
    before, and of dropped ones."""
    drops, doc, kept, whole = unused(docs, "drops", "doc", "kept", "whole")
    gone = frequent_lines(docs, text, doc_id, min_chars, min_docs, batches, fanout)
    gone = gone.groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct(*KEY)).alias(drops))
    lines = _LINES.format(text=f"`{text}`")
    key_hash = _HASH.replace("k)", f"{_KEY})")
    keep = f"filter({lines}, l -> char_length(l) < {int(min_chars)} OR NOT array_contains(`{drops}`, {key_hash}))"
    out = docs.join(gone, F.col(doc_id) == F.col(doc), "left").withColumn(kept, F.when(F.col(drops).isNotNull(), F.expr(keep)))
    n_lines = F.size(F.expr(lines)).cast("long")
    n_dropped = F.when(F.col(kept).isNotNull(), n_lines - F.size(kept)).otherwise(F.lit(0)).cast("long")
    out = out.withColumn(whole, F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)))

    def column(name: str) -> Column:
        if name == text:
            return F.col(whole).alias(name)
        if name == "n_chars":
            return F.when(n_dropped > 0, F.char_length(whole).cast(docs.schema[name].dataType)).otherwise(F.col(name)).alias(name)
        return F.col(f"`{name}`")

    more = [n_lines.alias(counts[0]), n_dropped.alias(counts[1])] if counts else []
    return out.select(*map(column, docs.columns), *more)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_dropped")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l,
         translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT lines.*, frequent.last IS NOT NULL AND frequent.last <> doc_id AS gone
      FROM lines LEFT JOIN frequent USING (k))
GROUP BY doc_id
"""
