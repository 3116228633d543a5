"""Quality by a factorisation machine.

Features of a text: its distinct words, hashed into WORDS weights and scaled to
unit length; STATS structure statistics (shares of capitals, digits, symbols, bars,
repeated words, lengths of words and lines, ...), each standardised and clipped;
metadata columns that the caller names (numbers, log-scaled, standardised). The
score is sigmoid(w0 + sum w_i x_i + pairwise), the pairwise low-rank interactions
of all features being half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2:
linear in the features. Fitted by AdaGrad on a bounded sample of labelled rows.

Defined results: null is the empty text, which has a score too; null metadata is
0; without labelled rows every score is the prior's, 0.5; rows that repeat are
scored alike; other columns aren't read. The driver holds the sample's features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, samples, workers
from textveil.llm import shingles as sh

WORDS = 1 << 14
RANK = 6
SAMPLE = 8_000  # labelled rows of each class, about
EPOCHS = 12
RATE = 0.08
SEED = 5

_CLASS = np.zeros(256, np.int8)  # 0 letters and bytes over 127
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?!|"]] = 8
CLASSES = 9
STATS = CLASSES + 7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words (row, cell, value) and the statistics (texts x STATS)."""
    n = len(texts)
    hashes, ends = sh.words(texts)
    n_words = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(n), n_words)
    cells = np.unique(doc * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64))
    row, cell = cells // WORDS, cells % WORDS
    per = np.bincount(row, minlength=n)
    value = 1 / np.sqrt(np.maximum(per, 1))[row]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    kinds = np.bincount(np.repeat(np.arange(n), lengths) * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    same = np.zeros(len(hashes), bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[same], minlength=n)
    some = np.maximum(n_words, 1)
    stats = np.column_stack([
        kinds / np.maximum(lengths, 1)[:, None],
        np.log1p(n_words),
        np.log1p(kinds[:, 4]),
        lengths / some / 10,
        per / some,
        again / some,
        np.log1p(lengths / (kinds[:, 4] + 1)),
        kinds[:, 8] / some,
    ])
    return row, cell, value, stats


class Machine:
    """Weights over WORDS hashed words, STATS statistics and the metadata."""

    def __init__(self, extra: int):
        rng = np.random.default_rng(SEED)
        self.size = WORDS + STATS + extra
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = rng.normal(0, 0.02, (self.size, RANK))
        self.mean, self.scale = np.zeros(STATS + extra), np.ones(STATS + extra)

    def _dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def _sums(self, n: int, row: np.ndarray, cell: np.ndarray, value: np.ndarray, dense: np.ndarray):
        wd, vd = self.w[WORDS:], self.v[WORDS:]
        first = np.bincount(row, self.w[cell] * value, n) + dense @ wd
        parts = self.v[cell] * value[:, None]
        inner = np.column_stack([np.bincount(row, parts[:, f], n) for f in range(RANK)]) + dense @ vd
        square = np.bincount(row, (parts**2).sum(axis=1), n) + dense**2 @ (vd**2).sum(axis=1)
        return self.w0 + first + 0.5 * ((inner**2).sum(axis=1) - square), inner

    def score(self, n: int, row: np.ndarray, cell: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z, _ = self._sums(n, row, cell, value, self._dense(stats))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, labels: np.ndarray) -> None:
        """rows: (cells, values) of each text."""
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        dense, rng = self._dense(stats), np.random.default_rng(SEED)
        gw, gv, g0 = np.full(self.size, 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                m = len(part)
                row = np.repeat(np.arange(m), [len(rows[i][0]) for i in part])
                cell = np.concatenate([rows[i][0] for i in part]).astype(np.int64)
                value = np.concatenate([rows[i][1] for i in part])
                x = dense[part]
                z, inner = self._sums(m, row, cell, value, x)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / m
                used, back = np.unique(cell, return_inverse=True)
                gain = err[row] * value
                dw = np.bincount(back, gain, len(used)) + 1e-6 * self.w[used]
                dv = np.column_stack([np.bincount(back, gain * (inner[row, f] - self.v[cell, f] * value), len(used)) for f in range(RANK)])
                dv += 1e-5 * self.v[used]
                dwd = err @ x + 1e-6 * self.w[WORDS:]
                dvd = x.T @ (err[:, None] * inner) - self.v[WORDS:] * (err @ x**2)[:, None] + 1e-5 * self.v[WORDS:]
                idx = np.concatenate([used, np.arange(WORDS, self.size)])
                dw, dv = np.concatenate([dw, dwd]), np.concatenate([dv, dvd])
                gw[idx] += dw**2
                gv[idx] += dv**2
                g0 += err.sum() ** 2
                self.w[idx] -= RATE * dw / np.sqrt(gw[idx])
                self.v[idx] -= RATE * dv / np.sqrt(gv[idx])
                self.w0 -= RATE * err.sum() / np.sqrt(g0)


def _chunked(pdf: pd.DataFrame, metadata: tuple[str, ...]):
    at = 0
    extra = [np.log1p(np.abs(pdf[f"m{k}"].astype(float).fillna(0).to_numpy())) for k in range(len(metadata))]
    for part in sh.chunks((t or "").encode() for t in pdf["text"]):
        row, cell, value, stats = features(part)
        stats = np.column_stack([stats, *(e[at : at + len(part)] for e in extra)])
        yield at, len(part), row, cell, value, stats
        at += len(part)


def _meta(metadata: tuple[str, ...]) -> list:
    return [F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]


def fit(labelled: DataFrame, metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> Machine:
    """Learn from labelled (text, label 0 or 1 and the metadata columns), all of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, n, row, cell, value, stats in _chunked(pdf, metadata):
                ends = np.searchsorted(row, np.arange(n + 1))
                yield pd.DataFrame({
                    "label": pdf["label"].iloc[at : at + n].to_numpy(),
                    "cells": [cell[a:b].astype("<u2").tobytes() for a, b in zip(ends, ends[1:], strict=False)],
                    "stats": [s.astype("<f8").tobytes() for s in stats],
                })

    rows = labelled.select("label", "text", *_meta(metadata))
    got = rows.mapInPandas(workers.lean(run), "label int, cells binary, stats binary").collect()
    got.sort(key=lambda r: (r["label"], r["stats"], r["cells"]))
    model = Machine(len(metadata))
    if got:
        sparse = []
        for r in got:
            c = np.frombuffer(r["cells"], "<u2")
            sparse.append((c, np.full(len(c), 1 / np.sqrt(max(len(c), 1)))))
        model.train(sparse, np.stack([np.frombuffer(r["stats"], "<f8") for r in got]), np.array([r["label"] for r in got], float))
    return model


def score(docs: DataFrame, model: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.score(n, row, cell, value, stats) for _, n, row, cell, value, stats in _chunked(pdf, metadata)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.concatenate(got) if got else []})

    return docs.select(ids.filled("doc_id"), "text", *_meta(metadata)).mapInPandas(workers.lean(run), "doc_id long, score double").withColumn("doc_id", ids.emptied("doc_id"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int, folds: int = 5, held: int = 0) -> DataFrame:
    """docs with label, of a bounded sample of the labelled rows outside the held-out fold.

    The sample's ids (a few ten thousand: `sample` of each label, as labels repeat few ids)
    are broadcast to the documents; of these 2 * sample a label at most are learned from.
    """
    rows = labels.filter(F.col(column).isin(0, 1) & (samples.crc_mod("doc_id", folds) != held)).select("doc_id", F.col(column).cast("int").alias("label"))
    picked = samples.bounded(rows, "label", ["doc_id"], sample).dropDuplicates(["doc_id", "label"])
    # a doc_id may stand for any number of documents: the rows themselves are bounded too
    return samples.bounded(docs.join(F.broadcast(picked), "doc_id"), "label", ["doc_id", "text"], 2 * sample)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(labelled_sample(docs, labels, "quality", SAMPLE), ("n_chars",))
    found = score(docs, model, ("n_chars",))
    return found.select("doc_id", samples.held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
