"""Document fingerprints: one-permutation MinHash in packed low-order bits.

Each five-word shingle (texts padded with boundary words, see shingles()) is hashed
once; its high bits name one of BINS bins, and a bin keeps its least hash. An empty
bin takes the value of the first non-empty bin in its own fixed pseudorandom order
of all bins (optimal densification: a choice that doesn't depend on neighbours).
The BITS low-order bits of each bin are stored, in hexadecimal; likeness corrects
the share of equal bins for the 2^-BITS that agree by chance.

Defined results: null is the empty text; a text without words has the fingerprint
of zeros, is alike (1) to another such text and unlike (0) any other; rows that
repeat a doc_id are documents of their own, next to each other by a hash of their text; null
doc_ids stand first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, workers
from textveil.llm import shingles as sh

BINS = 256
BITS = 4
BUCKET_BYTES = 32_000_000
RANGES = 1 << 15
PER_RANGE = 32

_ORDER = np.argsort(np.random.default_rng(11).random((BINS, BINS)), axis=1)
_RANK = np.argsort(_ORDER, axis=1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BINS) low-order bits, and whether a text has any shingle."""
    values, ends = sh.shingles(*sh.words(texts), pad=True)
    counts = np.diff(ends, prepend=0)
    least = np.full(len(texts) * BINS, _EMPTY)
    cell = np.repeat(np.arange(len(texts)) * BINS, counts) + (values >> np.uint64(56)).astype(np.int64) % BINS
    np.minimum.at(least, cell, values << np.uint64(8) >> np.uint64(8))
    least = least.reshape(len(texts), BINS)
    empty = least == _EMPTY
    for i in np.flatnonzero(empty.any(axis=1) & (counts > 0)):
        full, gaps = np.flatnonzero(~empty[i]), np.flatnonzero(empty[i])
        least[i, gaps] = least[i, full[_RANK[np.ix_(gaps, full)].argmin(axis=1)]]
    low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[counts == 0] = 0
    return low, counts > 0


def packed(low: np.ndarray) -> list[str]:
    """Rows of bins as hexadecimal: two bins of four bits in a byte."""
    return [row.tobytes().hex() for row in (low[:, ::2] << 4) | low[:, 1::2]]


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([raw >> 4, raw & 15], axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated resemblance of rows, between 0 and 1."""
    chance = 2.0**-BITS
    found = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(found, 0, 1), (some_a == some_b).astype(float))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[str] = []
            for part in sh.chunks((t or "").encode() for t in pdf["text"]):
                got += packed(signatures(part)[0])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": got})

    return docs.select(ids.filled(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(workers.lean(run), "doc_id long, fingerprint string").withColumn("doc_id", ids.emptied("doc_id"))


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(rows: list[tuple], following: str) -> pd.DataFrame:
    """rows: consecutive (doc_id, text); following: the text after the last."""
    texts = [t for _, t in rows]
    nexts = [*texts[1:], following]
    edited = [edited_text(t, x).encode() for t, x in zip(texts, nexts, strict=True)]
    low, some = signatures([t.encode() for t in [*texts, following]])
    elow, esome = signatures(edited)
    return pd.DataFrame({
        "doc_id": [i for i, _ in rows],
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": packed(low[:-1]),
        "edited_fingerprint": packed(elow),
        "near_edited": likeness(low[:-1], elow, some[:-1], esome),
        "near_next": likeness(low[:-1], low[1:], some[:-1], some[1:]),
    })


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by (bucket, handed, doc_id, text): a handed row ends its bucket."""
    rows: list[tuple] = []
    held, bucket, done = 0, None, False
    for pdf in batches:
        for i, text, b, handed in zip(pdf["doc_id"], pdf["text"], pdf["bucket"], pdf["handed"], strict=True):
            if b != bucket:
                rows, held, bucket, done = [], 0, b, False
            if rows and not done and (handed or held + len(text) > sh.CHUNK_BYTES):
                yield _compare(rows, text)
                rows, held = [], 0
            done = done or handed
            if not handed:
                rows.append((i, text))
                held += len(text)


def _cuts(rows: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (doc_id, h) of n ranges of about equally many rows, from a sample of PER_RANGE * n."""
    unit = F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    # rows that repeat id and text count as often as they stand, yet come back once
    seen = rows.filter(unit < PER_RANGE * n / max(total, 1)).groupBy("doc_id", "h").count().collect()
    seen.sort()
    up_to = np.cumsum([r["count"] for r in seen]) if seen else np.zeros(0)
    picks = sorted({int(np.searchsorted(up_to, i * up_to[-1] / n)) for i in range(1, n)}) if seen else []
    return np.array([seen[i]["doc_id"] for i in picks], np.int64), np.array([seen[i]["h"] for i in picks], np.int64)


def range_of(doc: np.ndarray, h: np.ndarray, cut_doc: np.ndarray, cut_h: np.ndarray) -> np.ndarray:
    """The range of each (doc, h): how many bounds are less."""
    low, high = np.searchsorted(cut_doc, doc, side="left"), np.searchsorted(cut_doc, doc, side="right")
    out = low.copy()
    among = np.flatnonzero(low < high)  # an id that is a bound: its texts may lie in several ranges
    for edge in np.unique(low[among]):
        rows = among[low[among] == edge]
        out[rows] = edge + np.searchsorted(cut_h[edge : high[rows[0]]], h[rows], side="left")
    return out.astype(np.int32)


def fingerprint_edits(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, with likenesses.

    Documents are dealt by ranges of (doc_id, hash of text), so a document and its next
    stand in one partition; the first document of each range is handed to the range before
    as well. The driver holds the bounds of the ranges, one per bucket_bytes and RANGES at
    most (beyond, ranges grow: a task streams its range in order, it never holds it), and
    finds them from a sample of PER_RANGE rows a range.
    """
    spark = docs.sparkSession
    rows = docs.select(ids.filled("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    n = max(1, min(max(24, (total["b"] or 0) // bucket_bytes), total["n"] // 2, RANGES))
    cut_doc, cut_h = _cuts(rows, n, total["n"])

    @F.pandas_udf("int")
    def bucket_of(doc: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(doc.to_numpy(), h.to_numpy(), cut_doc, cut_h))

    place = F.struct("doc_id", "h")
    firsts = rows.withColumn("bucket", bucket_of("doc_id", "h")).groupBy("bucket").agg(F.min(place).alias("first")).collect()
    firsts = sorted((r["bucket"], r["first"]["doc_id"], r["first"]["h"]) for r in firsts)
    hand = [(doc, h, firsts[k - 1][0]) for k, (_, doc, h) in enumerate(firsts)]
    dim = F.broadcast(spark.createDataFrame(hand, "first long, first_h long, bucket int"))  # one row for each range, RANGES at most
    own = rows.select("doc_id", "h", "text", bucket_of("doc_id", "h").alias("bucket"), F.lit(False).alias("handed"))
    handed = rows.join(dim, (rows["doc_id"] == dim["first"]) & (rows["h"] == dim["first_h"])).select("doc_id", "h", "text", "bucket", F.lit(True).alias("handed"))
    dealt = own.unionByName(handed.dropDuplicates(["bucket"])).repartitionById(max(1, n), "bucket")
    return dealt.sortWithinPartitions("bucket", "handed", "doc_id", "h").mapInPandas(workers.lean(_stream), NEIGHBOURS).withColumn("doc_id", ids.emptied("doc_id"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
