"""Removal of repeated 100-byte strings, by bucket-pointer refinement.

A byte goes when a LENGTH-byte string that covers it also starts earlier in the
corpus (smaller doc_id, or earlier in the same document). Texts are UTF-8 bytes and
matches never cross documents. Strings are sorted into ever finer buckets; a string
alone in its bucket drops out, equal strings share one to the end.

1. Every LENGTH-byte string holds one anchor: its GRAM-byte piece of least hash, the
   leftmost of equals. It depends on the string alone, so equal strings share their
   anchor's bucket, and the strings of successive starts with one anchor are a run: one
   row (bucket, hash of the run's bytes, place). Of equal runs all but the first repeat
   whole; a bucket with one sort of run has nothing else. These rows come straight from
   the scan. Repeats inside a partition are joined to spans before the shuffle.
2. Runs that differ in one bucket are refined by what stands SIDE bytes further: a string
   whose anchor is SIDE bytes or more from its start holds the SIDE bytes before it, any
   other the SIDE bytes after it. Bucket, side and these bytes give the finer bucket of
   either part of a run; equal parts repeat, parts alone in a bucket drop out.
3. Parts that still differ are compared byte by byte. All suffixes of their bytes are
   sorted to depth LENGTH: buckets of equal 5-grams are refined by the bucket identifiers
   of the suffix 5 later, the finer identifiers are used again 10 later, and so on. In
   each final bucket all but the earliest start repeat.
4. A bucket of step 2 with more bytes than one task sorts at once (CHUNK) is refined to
   full depth over all tasks: each string's final bucket is the bucket and 128 bits of
   hash, and one aggregation finds the earliest start of each.

No pair is ever formed: work follows the bytes, whatever the number of copies. The
result is that of comparing all strings (hashes of 64 bits or more aside).

Defined results: null and empty texts have 0 bytes and lose none, as texts under LENGTH
bytes; rows that repeat a doc_id and its text are one document; rows that repeat a doc_id
with different texts are documents of their own, ordered by 24 bits of a hash of the text
(texts that share these as well as their doc_id would be taken for one); a null doc_id is
the least id; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, scratch, workers
from textveil.llm import shingles as sh

LENGTH = 100
GRAM = 24
SIDE = (LENGTH - GRAM) // 2
SLICE = 1 << 22  # bytes that are searched for anchors at once
HELD = 600_000  # runs whose repeats are joined at once
CHUNK = 2_000_000  # bytes that are sorted at once
BATCH = 50_000  # rows that are sent at once
FIRST = 5  # letters of the first buckets: with a place, 61 bits
_INDEX = np.uint64((1 << 24) - 1)
_TIE, _LO = 38, 7  # bits below: a place is (tie of 24 bits, first start of 31, starts of 7)


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (anchor, run hash, text number, first start in it, number of starts) of texts.

    The lowest seven bits of the run hash are the anchor's distance from the first start.
    """
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return (empty,) * 5
    total, back = _sums(raw, sh._P)
    hashes = sh.mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    least = (hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    anchor = (least & _INDEX).astype(np.int64)  # of the string at each start
    change = np.zeros(n + 1, np.int32)
    long = ends - starts >= LENGTH
    change[starts[long]] += 1
    change[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(change)[: len(anchor)] > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return (empty,) * 5
    own = anchor[at]
    first = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    lo = at[first]
    count = np.diff(np.r_[np.flatnonzero(first), len(at)])
    mark = own[first]
    text = np.searchsorted(ends, lo, side="right")
    run = (total[lo + count - 1 + LENGTH] - total[lo]) * back[lo]
    run = sh.mix(run + count.astype(np.uint64) * np.uint64(0xA5A3564E27F88693))
    run = (run & ~np.uint64(127)) | (mark - lo).astype(np.uint64)
    return hashes[mark].view(np.int64), run.view(np.int64), text, lo - starts[text], count


def _sums(raw: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums for a polynomial hash: that of bytes i to j is (sums[j] - sums[i]) * back[i]."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * sh.powers(base, len(raw)), out=total[1:])
    return total, sh.powers(sh._INVERSE if base == sh._P else pow(base, -1, 1 << 64), len(raw))


RUNS = "a long, c long, doc long, at long"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs (a, c, doc, at) of documents (doc, tie, text).

    Of equal runs in a partition the earliest goes to its anchor; the others are known to
    repeat and go anywhere, successive ones as one row (its place has no starts, c has
    their number), so a passage of a third of all texts fills no one's task.
    """
    held, many = [], 0
    for pdf in batches:
        at, ids_, ties = 0, pdf["doc"].to_numpy(), pdf["tie"].to_numpy(np.int64)
        for part in sh.chunks((t.encode() for t in pdf["text"]), SLICE // 8):
            docs, tie = ids_[at : at + len(part)], ties[at : at + len(part)]
            at += len(part)
            joined = b"".join(part)
            sizes = np.array([len(t) for t in part])
            # a text longer than a slice is cut into overlapping ones; runs end at the cuts
            for first in range(0, max(1, len(joined)), SLICE):
                raw = np.frombuffer(joined[first : first + SLICE + LENGTH - 1], np.uint8)
                ends = np.clip(np.cumsum(sizes) - first, 0, len(raw))
                starts = np.clip(np.cumsum(sizes) - sizes - first, 0, len(raw))
                a, c, text, lo, n = anchors(raw, starts, ends)
                skipped = np.maximum(first - (np.cumsum(sizes) - sizes), 0)
                if len(a):
                    held.append((a, c, docs[text], (tie[text] << _TIE) | ((lo + skipped[text]) << _LO) | n))
                    many += len(a)
            if many >= HELD:
                yield from _joined(held)
                held, many = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
    a, c, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
    key = sh.mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    several = order[np.r_[False, same] | np.r_[same, False]]
    several = several[np.lexsort((at[several], doc[several], key[several]))]
    new = np.r_[True, key[several][1:] != key[several][:-1]] if len(several) else np.zeros(0, bool)
    first = several[new][np.cumsum(new) - 1]
    again = several[~new & ((doc[several] != doc[first]) | (at[several] != at[first]))]
    keep = np.ones(len(a), bool)
    keep[several[~new]] = False
    spans = _spans(doc[again], at[again] >> _TIE, at[again] >> _LO & 0x7FFFFFFF, at[again] & 127)
    place = (spans["tie"].to_numpy() << _TIE) | (spans["lo"].to_numpy(np.int64) << _LO)
    a = np.concatenate([a[keep], sh.mix(spans["doc"].to_numpy().view(np.uint64) * np.uint64(31) + place.view(np.uint64)).view(np.int64)])
    c, doc, at = np.concatenate([c[keep], spans["n"]]), np.concatenate([doc[keep], spans["doc"]]), np.concatenate([at[keep], place])
    for k in range(0, len(a), BATCH):
        yield pd.DataFrame({"a": a[k : k + BATCH], "c": c[k : k + BATCH], "doc": doc[k : k + BATCH], "at": at[k : k + BATCH]})


def _spans(doc: np.ndarray, tie: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Runs of n starts from lo, successive ones joined, as (doc, tie, lo, n)."""
    order = np.lexsort((lo, tie, doc))
    doc, tie, lo, n = doc[order], tie[order], lo[order], n[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (lo[1:] != lo[:-1] + n[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return pd.DataFrame({"doc": doc[first], "tie": tie[first], "lo": lo[first], "n": np.add.reduceat(n, first) if len(first) else n})


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Of rows by (a, c, doc, at): repeats of equal runs, and the first of each of the
    different runs of a bucket a. Rows of one place are one."""
    held: pd.DataFrame | None = None  # the first row of the open (a, c)
    told = False  # whether it went out as different
    for pdf in batches:
        if not len(pdf):
            continue
        k = 0
        if held is not None:
            pdf, k = pd.concat([held, pdf], ignore_index=True), 1
        a, c, doc, at = (pdf[x].to_numpy() for x in ("a", "c", "doc", "at"))
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_c = new_a | np.r_[True, c[1:] != c[:-1]]
        firsts = np.flatnonzero(new_c)
        first = firsts[np.cumsum(new_c) - 1]
        # a first run is open if another run of its bucket stands beside it
        beside = np.zeros(len(firsts), bool)
        same = a[firsts][1:] == a[firsts][:-1]
        beside[1:] |= same
        beside[:-1] |= same
        differ = firsts[beside]
        if k and told:
            differ = differ[differ != 0]
        yield pdf[~new_c & ((doc != doc[first]) | (at != at[first]))], pdf.iloc[differ]
        last = firsts[-1]
        told = bool(beside[-1]) or (last == 0 and k == 1 and told)
        held = pdf.iloc[last : last + 1]


MARKS = "doc long, tie int, lo int, n int, a long, d int"


def _marks(rows: pd.DataFrame, d: np.ndarray | int) -> pd.DataFrame:
    at = rows["at"].to_numpy()
    return pd.DataFrame({"doc": rows["doc"].to_numpy(), "tie": at >> _TIE, "lo": at >> _LO & 0x7FFFFFFF, "n": at & 127, "a": rows["a"].to_numpy(), "d": d})


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated runs (d is -1), and those to refine, with their anchor's distance d."""

    def unknown() -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = (pdf["at"].to_numpy() & 127) == 0
            if known.any():
                sure.append(pdf[known])
            yield pdf[~known]

    sure: list[pd.DataFrame] = []
    for repeats, differ in _settled(unknown()):
        yield from (_marks(x, -1).assign(n=x["c"].to_numpy()) for x in sure)
        sure.clear()
        yield _marks(repeats, -1)
        yield _marks(differ, differ["c"].to_numpy() & 127)
    yield from (_marks(x, -1).assign(n=x["c"].to_numpy()) for x in sure)


PARTS = "a long, c long, doc long, at long, bytes binary"


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Either part of each run to refine (a, lo, n, d: arrays by document), in its finer bucket."""
    out, size = [], 0
    for pdf in batches:
        for doc, tie, text, a, lo, n, d in zip(*(pdf[x] for x in ("doc", "tie", "text", "a", "lo", "n", "d")), strict=True):
            encoded = text.encode()
            raw = np.frombuffer(encoded, np.uint8)
            total, back = _sums(raw, sh._P)
            a, lo, n, d = (np.asarray(x, np.int64) for x in (a, lo, n, d))
            mark, past = lo + d, lo + n
            middle = np.clip(mark - SIDE + 1, lo, past)  # the first start whose anchor is nearer than SIDE
            for side, low, high, at in ((1, lo, middle, mark - SIDE), (2, middle, past, mark)):
                some = low < high
                low, high, at = low[some], high[some], at[some]
                finer = sh.mix((total[at + GRAM + SIDE] - total[at]) * back[at] + a[some].view(np.uint64) + np.uint64(side))
                content = sh.mix((total[high - 1 + LENGTH] - total[low]) * back[low] + (high - low).astype(np.uint64) * np.uint64(0xA5A3564E27F88693) + (mark[some] - low).astype(np.uint64))
                pieces = [encoded[x : y - 1 + LENGTH] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                out.append((finer.view(np.int64), content.view(np.int64), np.full(len(low), doc, np.int64), (int(tie) << _TIE) | (low << _LO) | (high - low), pieces))
                size += sum(map(len, pieces))
            if size >= CHUNK:
                yield _table(out)
                out, size = [], 0
    if out:
        yield _table(out)


def _table(out: list[tuple]) -> pd.DataFrame:
    a, c, doc, at = (np.concatenate([x[i] for x in out]) for i in range(4))
    return pd.DataFrame({"a": a, "c": c, "doc": doc, "at": at, "bytes": [b for x in out for b in x[4]]})


def refine(raw: np.ndarray) -> np.ndarray:
    """Bucket of the LENGTH-byte string at each place; -1 where no other has it."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gram = np.zeros(len(raw) - FIRST + 1, np.int64)
    for i in range(FIRST):
        gram = (gram << 8) | raw[i : len(raw) - FIRST + 1 + i]
    bucket, depth = _buckets(gram), FIRST
    while depth < LENGTH:
        # the suffix `step` later is bucketed to the same depth
        step = min(depth, LENGTH - depth)
        m = len(bucket) - step
        one, two = bucket[:m], bucket[step:]
        live = np.flatnonzero((one >= 0) & (two >= 0))
        finer = np.full(m, -1, np.int64)
        if len(live):
            finer[live] = _buckets(one[live] * (int(bucket.max()) + 1) + two[live])
        bucket, depth = finer, depth + step
    return bucket[:n]


def _buckets(keys: np.ndarray) -> np.ndarray:
    """A number for each value that occurs more than once, -1 for others.

    A key and its place share one number where they fit: sorting that is faster.
    """
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 64:
        both = np.sort((keys << bits) | np.arange(len(keys)))
        order, sorted_ = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(keys)
        sorted_ = keys[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    alone = new & np.r_[new[1:], True]
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(alone, -1, np.cumsum(~alone & new) - 1)
    return out


REPEATS = "doc long, tie int, lo int, n int, a long, k1 long, k2 long"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts by (a, c, doc, at): repeated starts (keys null), and the strings, with their
    keys, of buckets that hold more than a task may sort."""
    held: pd.DataFrame | None = None
    large: int | None = None  # the bucket that gives its strings away
    for repeats, differ in _settled(batches):
        if len(repeats):
            yield _repeated(_marks(repeats, 0).drop(columns=["a", "d"]))
        if large is not None:
            own = differ["a"].to_numpy() == large
            if own.any():
                yield from _keyed(differ[own])
                differ = differ[~own]
            if len(differ):
                large = None
        held = differ if held is None else pd.concat([held, differ], ignore_index=True)
        while len(held):
            a = held["a"].to_numpy()
            size = np.cumsum(held["bytes"].map(len).to_numpy())
            if size[-1] <= CHUNK:
                break
            edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            fits = edges[np.r_[0, size][edges] <= CHUNK][-1]
            if fits:  # whole buckets
                yield _sorted(held.iloc[:fits])
            else:
                fits = edges[1] if len(edges) > 1 else len(held)
                large = int(a[0]) if len(edges) == 1 else None
                yield from _keyed(held.iloc[:fits])
            held = held.iloc[fits:]
    if held is not None and len(held):
        yield _sorted(held)


def _keyed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Every string of rows of one bucket, with 128 bits of hash."""
    for at in range(0, len(rows), 16_384):
        part = rows.iloc[at : at + 16_384]
        raw, place, row, start = _places(part)
        keys = []
        for base in (sh._P, 0xC2B2AE3D27D4EB4F):
            total, back = _sums(raw, base)
            keys.append(sh.mix((total[place + LENGTH] - total[place]) * back[place]).view(np.int64))
        yield pd.DataFrame({
            "doc": part["doc"].to_numpy()[row], "tie": (part["at"].to_numpy() >> _TIE)[row], "lo": start, "n": 1,
            "a": part["a"].to_numpy()[row], "k1": keys[0], "k2": keys[1],
        })


def _repeated(spans: pd.DataFrame) -> pd.DataFrame:
    none = pd.array([None] * len(spans), dtype="Int64")
    return spans.assign(a=none, k1=none, k2=none)


def _places(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all rows, and the place, row and start of each string."""
    sizes = rows["bytes"].map(len).to_numpy()
    at = rows["at"].to_numpy()
    n = at & 127
    raw = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    row = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return raw, (np.cumsum(sizes) - sizes)[row] + inside, row, (at >> _LO & 0x7FFFFFFF)[row] + inside


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    raw, place, row, start = _places(rows)
    bucket = refine(raw)[place]
    live = np.flatnonzero(bucket >= 0)
    doc, tie = rows["doc"].to_numpy()[row[live]], (rows["at"].to_numpy() >> _TIE)[row[live]]
    start = start[live]
    order = np.lexsort((start, tie, doc, bucket[live]))
    b = bucket[live][order]
    later = order[np.r_[False, b[1:] == b[:-1]]] if len(b) else order
    return _repeated(_spans(doc[later], tie[later], start[later], np.ones(len(later), np.int64)))


def covered(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which bytes the strings at starts lo..lo+n-1 cover."""
    change = np.bincount(lo, minlength=size + 1)[: size + 1] - np.bincount(lo + n - 1 + LENGTH, minlength=size + 1)[: size + 1]
    return np.cumsum(change)[:size] > 0


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each document, with an array of each column, in one order."""
    grouped = rows.groupBy("doc", "tie").agg(F.collect_list(F.struct(*columns)).alias("all"))
    return grouped.select("doc", "tie", *(F.col(f"all.{c}").alias(c) for c in columns))


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): docs as (doc, tie, text), and (doc, tie, lo, n): arrays of repeated starts."""
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(ids.filled("doc_id").alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("tie"), text.alias("text"))
    runs = rows.mapInPandas(workers.lean(_runs), RUNS)
    marks = runs.repartition(parallel, "a").sortWithinPartitions("a", "c", "doc", "at").mapInPandas(workers.lean(_settle), MARKS)
    marks = scratch.table(marks, "marks")

    wanted = _lists(marks.filter("d >= 0"), "a", "lo", "n", "d")
    parts = rows.join(wanted, ["doc", "tie"]).mapInPandas(workers.lean(_parts), PARTS)
    found = parts.repartition(parallel, "a").sortWithinPartitions("a", "c", "doc", "at").mapInPandas(workers.lean(_compare), REPEATS)
    found = scratch.table(found, "repeats")
    keyed, key = found.filter("k1 IS NOT NULL"), ["a", "k1", "k2"]
    earliest = keyed.groupBy(*key).agg(F.min(F.struct("doc", "tie", "lo")).alias("e"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    split = keyed.join(earliest, key).filter("struct(doc, tie, lo) <> e")
    spans = marks.filter("d < 0").unionByName(found.filter("k1 IS NULL"), allowMissingColumns=True).unionByName(split, allowMissingColumns=True)
    return rows, _lists(spans.select("doc", "tie", "lo", "n"), "lo", "n")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, lo, n in zip(pdf["doc"], pdf["text"], pdf["lo"], pdf["n"], strict=True):
            raw = text.encode()
            if lo is None:
                out.append((doc, len(raw), 0, 0, raw))
                continue
            gone = covered(len(raw), np.asarray(lo, np.int64), np.asarray(n, np.int64))
            edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc, len(raw), int(gone.sum()), edges, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept has the remaining bytes."""
    rows, spans = repeated(docs)
    return rows.join(spans, ["doc", "tie"], "left").mapInPandas(workers.lean(_kept), RESULT).withColumn("doc_id", ids.emptied("doc_id"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


OP5_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 99))) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM r)),
gone AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, span),
cut AS (SELECT doc_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), 1000000000) AS hi FROM gone
  UNION ALL SELECT doc_id, 0, min(lo) FROM gone GROUP BY doc_id),
kept AS (SELECT cut.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM cut JOIN t ON t.doc_id = cut.doc_id GROUP BY cut.doc_id),
n AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
