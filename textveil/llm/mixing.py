r"""Mixing of sources to target weights by blocks of words.

Words ([^\x20\x09-\x0D]+) of a source's documents, in a pseudorandom order of the
documents, are packed into blocks of `block_words`. Target words per source follow
the weights (cycled over the sources by code point, null last), share 100 % of all
words and stop at `ceiling` times the source's words, the excess reshared. The mix
is a list of slots, dealt into output shards. Each shard's counts by source are
drawn multinomially, conditioned on the totals: a binary tree over the shards
splits the totals by multivariate hypergeometric draws whose seeds are the tree's
nodes, so any shard finds its counts and the slots before it by walking from the
root, without the others. Slot k of a source is block permutation_epoch(k mod N),
epoch k div N: every block once before any twice. Blocks join slots by index. The
last slot of a source may take a part of its block, so the words taken are the
target's to a word, and no document is taken more often than its source.

Draws of any size follow the same rule. Defined results: null or empty texts have size 0
and are never taken; rows that repeat a doc_id are documents of their own; a null source is a source; an empty
table gives no rows; columns besides text, doc_id and source pass through
materialise() and clash with nothing. The driver holds one number set per source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.llm import scratch, workers
from textveil.llm.columns import unused

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK_WORDS = 512
SHARD_SLOTS = 2048
BUCKET_ROWS = 20_000
SEED = 20_240_501
WORD = r"[^\x20\x09-\x0D]+"
SIGMAS = 12  # a draw's probabilities are summed so far around the mode; beyond is less than 10^-30


def targets(sizes: list[int], weights: list[float], ceiling: float = CEILING) -> list[float]:
    """Words per source: shares of the sum by weight, at most ceiling times the size."""
    got, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * share > ceiling * sizes[i]]
        for i in over or open_:
            got[i] = float(ceiling * sizes[i]) if over else weights[i] * share
        if not over:
            break
        left -= sum(got[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return got


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network, walked until it lands inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    rounds = [(key * 4 + r) & 0xFFFFFFFFFFFF for r in range(4)]
    x = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for r in reversed(rounds) if back else rounds:
            if back:
                left, right = right ^ (_mixed(left, r) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, r) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x


@dataclass(frozen=True)
class Source:
    """Totals of a source: words, target, blocks, full epochs, blocks and words of the last epoch."""

    number: int
    words: int
    target: float
    blocks: int
    epochs: int
    last_blocks: int
    last_take: int

    @property
    def slots(self) -> int:
        return self.epochs * self.blocks + self.last_blocks


def source_plan(number: int, words: int, target: float, block: int, seed: int, ceiling: int) -> Source:
    quota = min(int(target + 0.5), ceiling * words)
    if not quota:
        return Source(number, words, target, 0, 0, 0, 0)
    n = -(-words // block)
    tail = words - (n - 1) * block
    epochs, rest = divmod(quota, words)
    # where the short last block stands in the order of the epoch that is cut
    short = int(permute(np.array([n - 1]), n, _key(seed, number, epochs), back=True)[0])
    cum = lambda i: i * block - (block - tail) * (i > short)
    m = -(-rest // block)
    if cum(m) < rest:
        m = -(-(rest + block - tail) // block)
    return Source(number, words, target, n, epochs, m, rest - cum(m - 1) if m else 0)


def _key(seed: int, source: int, epoch: int) -> int:
    return seed * 1_000_003 + source * 8_191 + epoch


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample without replacement has, of any totals.

    By the inverse of the distribution function, from ratios of successive probabilities
    around the mode: work follows the standard deviation, the root of the totals.
    """
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    width = int(SIGMAS * (sample * (good / total) * (bad / total) * ((total - sample) / max(total - 1, 1))) ** 0.5) + 64
    low, high = max(low, mode - width), min(high, mode + width)
    k = np.arange(low, high, dtype=np.int64)
    ratio = ((good - k) / (k + 1.0)) * ((sample - k) / (bad - sample + k + 1.0))
    log = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    up_to = np.cumsum(np.exp(log - log.max()))
    return low + int(min(np.searchsorted(up_to, rng.random() * up_to[-1], side="right"), high - low))


def split(counts: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw of want slots from counts by source."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = hypergeometric(rng, c, rest, want) if c else 0
        want -= int(out[i])
    return out


def shard_counts(totals: np.ndarray, shard: int, shards: int, seed: int, held: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots by source in this shard, and in those before it. held: draws of nodes, for use again."""
    counts, before, lo, hi = totals.astype(np.int64), np.zeros(len(totals), np.int64), 0, shards
    total = int(totals.sum())
    edge = lambda i: i * total // shards
    held = {} if held is None else held
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = held.get((lo, hi))
        if left is None:
            left = split(counts, edge(mid) - edge(lo), np.random.default_rng([seed, lo, hi]))
            if len(held) < 4096:
                held[lo, hi] = left
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, before, lo = counts - left, before + left, mid
    return counts, before


def slots(spark: SparkSession, sources: list[Source], block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, epoch, block, take): the mix in its order."""
    totals = np.array([s.slots for s in sources], np.int64)
    shards = -(-int(totals.sum()) // shard_slots) if len(sources) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for shard in pdf["id"].tolist():
                counts, before = shard_counts(totals, shard, shards, seed, held)
                parts = []
                for s in np.flatnonzero(counts):
                    src = sources[s]
                    k = before[s] + np.arange(counts[s])
                    epoch, place = k // src.blocks, k % src.blocks
                    at = np.empty(len(k), np.int64)
                    for e in np.unique(epoch):
                        at[epoch == e] = permute(place[epoch == e], src.blocks, _key(seed, int(s), int(e)))
                    take = np.minimum(block, src.words - at * block)
                    take[(epoch == src.epochs) & (place == src.last_blocks - 1)] = src.last_take
                    parts.append(pd.DataFrame({"source_no": int(s), "epoch": epoch, "block": at, "take": take}))
                out = pd.concat(parts)
                out.insert(0, "slot", np.random.default_rng([seed, shards, shard, 1]).permutation(len(out)))
                out.insert(0, "shard", shard)
                yield out

    return spark.range(shards).mapInPandas(workers.lean(run), "shard long, slot long, source_no int, epoch long, block long, take long")


ROW = ["doc_id", "h", "copy_no"]  # what tells a row: its id, a hash of text and source, and its number among equal ones


def _rows(docs: DataFrame, h: str, copy_no: str) -> DataFrame:
    """docs with h and copy_no; rows with a null or repeated id are told apart by what they hold."""
    rows = docs.withColumn(h, F.xxhash64("text", "source"))
    return rows.withColumn(copy_no, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h)))


@dataclass
class Mix:
    """sizes: (ROW, source_no, size, source_size, target); slots: see slots(); uses: (ROW,
    epoch, first, past): words of a document that a slot takes."""

    sizes: DataFrame
    slots: DataFrame
    uses: DataFrame

    def taken(self) -> DataFrame:
        """sizes with taken: words that the mix takes of each document."""
        used = self.uses.groupBy(*ROW).agg(F.sum(F.col("past") - F.col("first")).alias("taken"))
        used = used.withColumnsRenamed({c: f"u_{c}" for c in ROW})
        on = [self.sizes[c].eqNullSafe(used[f"u_{c}"]) for c in ROW]
        return self.sizes.join(used, on, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop(*(f"u_{c}" for c in ROW))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    ceiling: int = CEILING,
    block: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """Plan the mix of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    found = docs.select("doc_id", "source", size, F.xxhash64("text", "source").alias("h"))
    found = found.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h")))
    found = scratch.table(found, "sizes")
    totals = found.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"]))
    words = [r["words"] for r in totals]
    want = targets(words, [weights[i % len(weights)] for i in range(len(words))], ceiling)
    sources = [source_plan(i, words[i], want[i], block, seed, ceiling) for i in range(len(words))]
    rows = [(r["source"], i, words[i], want[i]) for i, r in enumerate(totals)]
    dim = spark.createDataFrame(rows, "src string, source_no int, source_size long, target double")
    if len(rows) <= 100_000:  # a few MB at most
        dim = F.broadcast(dim)
    sizes = found.join(dim, found["source"].eqNullSafe(dim["src"])).drop("src")

    # Where each document starts among its source's words: buckets, then inside a bucket.
    buckets = max(256, sum(r["n"] for r in totals) // BUCKET_ROWS)
    placed = sizes.filter("size > 0").select(*ROW, "source_no", "size", F.pmod(F.xxhash64(*ROW, F.lit(seed)), F.lit(buckets)).alias("bucket"))
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n")
    base = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", before.alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy(*ROW)) - F.col("size")
    placed = placed.withColumn("inside", inside).join(base, ["source_no", "bucket"])
    start, b = F.col("start"), F.lit(block)
    placed = placed.select(*ROW, "source_no", "size", (F.col("base") + F.col("inside")).alias("start"))
    segments = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    first = F.greatest(start, F.col("block") * b)
    past = F.least(start + F.col("size"), (F.col("block") + 1) * b)
    segments = segments.select(*ROW, "source_no", "block", (first - start).alias("first"), (first - F.col("block") * b).alias("at"), (past - first).alias("n"))
    drawn = slots(spark, sources, block, shard_slots, seed)
    # drawn grows with the mix though its plan starts from a small range: never broadcast
    uses = segments.join(drawn.hint("merge"), ["source_no", "block"]).filter("take > at")
    uses = uses.select(*ROW, "epoch", "first", (F.col("first") + F.least("n", F.col("take") - F.col("at"))).alias("past"))
    return Mix(sizes, drawn, uses)


def _cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    out = []
    for text, runs in zip(texts, cuts, strict=True):
        spans = [m.span() for m in re.finditer(WORD, text)]
        merged: list[list[int]] = []
        for first, past in sorted((r["first"], r["past"]) for r in runs):
            if merged and first == merged[-1][1]:
                merged[-1][1] = past
            else:
                merged.append([first, past])
        out.append(text if merged == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in merged))
    return pd.Series(out)


def materialise(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix's documents, with the columns of docs: one row for each epoch that
    takes words of a document, its text cut to these words where it isn't whole."""
    cut = F.pandas_udf(_cut, "string")
    h, copy_no, size, taken_cuts, took, epoch, part, *row = unused(docs, "h", "copy_no", "size", "cuts", "took", "epoch", "part", *(f"u_{c}" for c in ROW))
    rows = _rows(docs, h, copy_no).withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    cuts = mix.uses.groupBy(*ROW, F.col("epoch").alias(epoch)).agg(F.collect_list(F.struct("first", "past")).alias(taken_cuts), F.sum(F.col("past") - F.col("first")).alias(took))
    cuts = cuts.withColumnsRenamed(dict(zip(ROW, row, strict=True)))
    both = rows.join(cuts, [rows[a].eqNullSafe(cuts[b]) for a, b in zip(("doc_id", h, copy_no), row, strict=True)])
    both = both.withColumn(part, F.when(F.col(took) == F.col(size), F.col("text")).otherwise(cut("text", taken_cuts)))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(part)}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length(part).cast(docs.schema["n_chars"].dataType)
    return both.select(*(c.alias(name) for name, c in columns.items()))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).taken().select("doc_id", "size", "source_size", "target", "taken", "source", "source_no")
