"""Accuracy of detectors: matching by overlap, precision, recall, F1, tallies."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IOU = 0.5
FEW = 64  # pairs of a run up to which plain loops are faster than arrays


def iou(a: Column, b: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(union > 0, inter / union).otherwise(0.0)


def match(pred: DataFrame, truth: DataFrame, key: str, least: float = IOU) -> DataFrame:
    """(key, tp, fp, fn): predictions in order take the unmatched truth of their type
    of largest IoU (of equals the first), if it is at least `least`.

    Only spans that overlap, or hang together by others that do, can bear on each other:
    a document's spans of a type are sorted by place, cut where all spans before have
    ended, and each such run is matched by itself, so no more than a run is held at once.
    Rows of equal `ord` are separate spans, first by place. Spans without a type, a
    length or a place are counted and match nothing. A null key is one document.
    """
    live = F.col("type").isNotNull() & (F.col("start") < F.col("end"))

    def side(spans: DataFrame, true: bool) -> DataFrame:
        places = (F.when(live, F.col(c).cast("long")).alias(f"__{c}") for c in ("start", "end"))
        return spans.select(key, F.when(live, F.col("type").cast("string")).alias("__type"), *places, F.col("ord").cast("long").alias("__ord"), F.lit(true).alias("__true"))

    before = Window.partitionBy(key, "__type").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    rows = side(pred, False).unionByName(side(truth, True)).withColumn("__new", F.coalesce(F.col("__start") >= F.max("__end").over(before), F.lit(True)))
    zero = (F.coalesce(c, F.lit(0)).alias(c) for c in ("__start", "__end", "__ord"))
    rows = rows.select(key, "__new", "__true", *zero)  # in the window's order
    counts = T.StructType([T.StructField(key, rows.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches):
            yield from _matched(whole, key, least)

    return rows.mapInArrow(run, counts).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only where a run begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch["__new"].to_numpy(zero_copy_only=False))
        if len(begins):
            held.append(batch.slice(0, begins[-1]))
            yield pa.Table.from_batches(held)
            batch, held = batch.slice(begins[-1]), []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _matched(rows: pa.Table, key: str, least: float) -> Iterator[pa.RecordBatch]:
    """(key, tp, fp, fn) of each run in rows."""
    new, true, start, end, nth = (rows[c].to_numpy() for c in ("__new", "__true", "__start", "__end", "__ord"))
    if not len(new):
        return
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(new)))
    t = np.add.reduceat(true.astype(np.int64), at)
    p = n - t
    tp = np.zeros(len(at), np.int64)
    pair = (p == 1) & (t == 1)
    a, b = at[pair], at[pair] + 1
    share = (np.minimum(end[a], end[b]) - np.maximum(start[a], start[b])) / (np.maximum(end[a], end[b]) - np.minimum(start[a], start[b]))
    tp[pair] = (share >= least) & (share > 0)
    for i in np.flatnonzero((p > 0) & (t > 0) & ~pair):
        run = slice(at[i], at[i] + n[i])
        spans, mine = np.stack([nth[run], start[run], end[run]], axis=1), true[run]
        tp[i] = (_few if p[i] * t[i] <= FEW else _many)(spans[~mine], spans[mine], least)
    yield from pa.table({key: rows[key].take(at), "tp": tp, "fp": p - tp, "fn": t - tp}).to_batches()


def _few(pred: np.ndarray, truth: np.ndarray, least: float) -> int:
    """How many predictions (ord, start, end) match, by trying all pairs."""
    free, tp = sorted(truth.tolist()), 0
    for _, a, b in sorted(pred.tolist()):
        most, best = 0.0, None
        for i, (_, c, d) in enumerate(free):
            share = (min(b, d) - max(a, c)) / (max(b, d) - min(a, c))
            if share > most:
                most, best = share, i
        if best is not None and most >= least:
            del free[best]
            tp += 1
    return tp


def _many(pred: np.ndarray, truth: np.ndarray, least: float) -> int:
    """_few for long runs: truths of one place are a queue, and only places near enough
    for the least IoU are tried."""
    truth = truth[np.lexsort((truth[:, 0], truth[:, 2], truth[:, 1]))]
    first = np.flatnonzero(np.append(True, (truth[1:, 1:] != truth[:-1, 1:]).any(axis=1)))
    start, end, head = truth[first, 1], truth[first, 2], truth[first, 0]
    starts = start.tolist()
    next_, stop = first.copy(), np.append(first[1:], len(truth))
    free, tp = np.ones(len(first), bool), 0
    for _, a, b in pred[np.lexsort((pred[:, 2], pred[:, 1], pred[:, 0]))].tolist():
        lo, hi = 0, bisect_left(starts, b)
        if least > 0:  # an IoU is at most (b - a) / (b - start), and (b - start) / (b - a)
            lo, hi = bisect_left(starts, b - (b - a) / least - 1), bisect_left(starts, min(b, b - (b - a) * least + 1))
        near = lo + np.flatnonzero(free[lo:hi])
        if not len(near):
            continue
        s, e = start[near], end[near]
        share = (np.minimum(e, b) - np.maximum(s, a)) / (np.maximum(e, b) - np.minimum(s, a))
        most = share.max()
        if most < least or most <= 0:
            continue
        equal = near[share == most]
        best = equal[np.argmin(head[equal])]
        tp += 1
        next_[best] += 1
        if next_[best] < stop[best]:
            head[best] = truth[next_[best], 0]
        else:
            free[best] = False
    return tp


def scores(counts: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 by key and over all (key null); NaN where nothing counts."""
    total = counts.rollup(key).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    total = total.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return total.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(float("nan"))))


def name_tally(sentences: DataFrame, pred: DataFrame) -> DataFrame:
    """What business names (id, biz_start, biz_end) were taken for, by the first prediction
    (id, ord, start, end, type) that overlaps: company, confused, not_detected; and other
    predictions."""
    s = sentences.select("id", "biz_start", "biz_end")
    hit = (F.col("start") < F.col("biz_end")) & (F.col("biz_start") < F.col("end"))
    joined = s.join(pred, "id", "left")
    one = joined.groupBy("id").agg(F.min_by(F.when(hit, F.col("type")), F.when(hit, F.col("ord"))).alias("type"), F.count_if(F.coalesce(~hit, F.lit(False))).alias("other"))
    kind = F.when(F.col("type").isNull(), "not_detected").when(F.col("type") == "COMPANY", "company").otherwise("confused")
    return one.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("other_noise"))


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of all places of a literal in a text, from left to right, not overlapping."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gaps = F.transform(F.split(text, quoted, -1), F.length)
    first = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<int>").alias("out"))

    def step(acc: Column, gap: Column) -> Column:
        start = acc["at"] + gap
        return F.struct((start + F.length(needle)).alias("at"), F.array_append(acc["out"], start).alias("out"))

    starts = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), first, step, lambda acc: acc["out"])
    return F.when(F.contains(text, needle) & (needle != ""), starts).otherwise(F.expr("array()").cast("array<int>"))


def latency_stats(timings: DataFrame, by: list[str], order: str, ms: str = "ms", warm_up: int = 1) -> DataFrame:
    """n, least, mean, median and most of timings, without the first `warm_up` of each group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = timings.withColumn("__n", nth).filter(F.col("__n") > warm_up)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("least"), F.avg(ms).alias("mean"), F.median(ms).alias("median"), F.max(ms).alias("most"))


def entity_types(labels: DataFrame, label: str = "label") -> DataFrame:
    """The distinct entity types behind BIO labels (B-X, I-X, O or a plain type)."""
    kind = F.regexp_replace(label, r"(?s)\A[^-]*-", "")
    return labels.filter(F.col(label) != "O").select(kind.alias("type")).distinct()
