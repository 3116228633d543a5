"""Language identification by nearest centroids of TF-IDF character n-grams.

Letters of a text, lower-cased, give n-grams of one to three with word edges,
hashed into DIMS counts; log(1 + count) times IDF, normalised. Each language has
several centroids (spherical k-means over a bounded sample of its labelled rows);
a text gets the language of the centroid nearest by cosine. A text whose cosine
is below a share of the least cosine that the language's own sample shows is
rejected: too far from all that was learned. Texts under SURE letters, whose cosine
tells little, aren't rejected and set no floor, unless the sample has no others. All
of a text counts, at scoring.

Defined results: null, empty and letterless texts are `und`, score 0, rejected;
if no labelled row has a letter, every text is; rows that repeat count each; null
doc_ids are never learned from; other columns aren't read. The driver holds the
sample's counts (rows of DIMS numbers: SAMPLE for a language, TOTAL in all, at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import samples, workers
from textveil.llm.columns import unused

DIMS = 4096
CENTROIDS = 3
SAMPLE = 800  # labelled rows a language, about
TOTAL = 64_000  # labelled rows of all languages, about
REJECT = 0.6  # of the 0.5 % quantile of the cosines in the language's sample
SURE = 100  # letters
CHUNK_CHARS = 1 << 18
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(texts: list[str]) -> np.ndarray:
    """(texts x DIMS) n-gram counts."""
    joined = "\0\0".join(t.lower() for t in texts) + "\0\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # each text ends with two zeros; lower() may change lengths, so ends are found there
    letters = np.where(_is_letter()[points], points, 0).astype(np.uint64)
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)) * DIMS, lengths)
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    core = letters > 0
    one = letters * b
    two = before * a + one + np.uint64(1)
    three = before * a + one + after * c + np.uint64(2)
    out = np.zeros(len(texts) * DIMS)
    for value in (one, two, three):
        cells = ((value[core] * a) >> np.uint64(52)).astype(np.int64)
        out += np.bincount(doc[core] + cells, minlength=len(out))
    return out.reshape(len(texts), DIMS)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # IDF-weighted, unit rows
    idf: np.ndarray
    floors: np.ndarray  # of each centroid's language: cosines below are rejected

    def vectors(self, found: np.ndarray) -> np.ndarray:
        v = np.log1p(found) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = []
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or (held + len(texts[end] or "") <= CHUNK_CHARS and end - at < 256)):
                held += len(texts[end] or "")
                end += 1
            found = counts([t or "" for t in texts[at:end]])
            some = found.any(axis=1) & (len(self.languages) > 0)
            if some.any():
                cosine = self.vectors(found) @ self.centroids.T
                best = cosine.argmax(axis=1)
                sure = found.sum(axis=1) >= 3 * SURE  # three n-grams a letter
            for i in range(end - at):
                if some[i]:
                    score = float(min(1.0, max(0.0, cosine[i, best[i]])))
                    out.append((self.languages[best[i]], score, bool(sure[i] and score < self.floors[best[i]])))
                else:
                    out.append((UNKNOWN, 0.0, True))
            at = end
        return out


def _k_means(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows: unit centroids and each row's."""
    chosen = [int((v @ v.sum(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    centres = v[chosen]
    for _ in range(12):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (v @ centres.T).argmax(axis=1)


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from labelled (doc_id, text, lang); null langs are left out."""
    rows = labelled.filter("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", "lang")
    picked = samples.bounded(rows, "lang", ["doc_id", "text"], sample, TOTAL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                got = counts([text or ""])[0]
                cells = np.flatnonzero(got)
                if len(cells):
                    yield pd.DataFrame({"lang": [lang], "cells": [cells.astype("<u2").tobytes()], "n": [got[cells].astype("<f4").tobytes()]})

    got = picked.mapInPandas(workers.lean(run), "lang string, cells binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], r["cells"], r["n"]))
    found = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        found[i, np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["n"], "<f4")
    idf = np.log((1 + len(got)) / (1 + (found > 0).sum(axis=0))) + 1
    model = Model([], np.zeros((0, DIMS)), idf.astype(np.float32), np.zeros(0))
    vectors, langs = model.vectors(found), np.array([r["lang"] for r in got])
    parts, floors = [], []
    for lang in sorted(set(langs)):
        v = vectors[langs == lang]
        centres, _ = _k_means(v, centroids)
        long = found[langs == lang].sum(axis=1) >= 3 * SURE
        inside = ((v[long] if long.any() else v) @ centres.T).max(axis=1)
        floors += [REJECT * float(np.quantile(inside, 0.005))] * len(centres)
        model.languages += [lang] * len(centres)
        parts.append(centres)
    if parts:
        model.centroids, model.floors = np.concatenate(parts).astype(np.float32), np.array(floors)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with their language, score and whether it is rejected, under these names;
    the other columns are kept as they are."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        workers.give_back()
        try:
            for texts in batches:
                yield pd.DataFrame(model.predict([None if t is None else t for t in texts]), columns=["lang", "score", "rejected"])
        finally:
            workers.give_back()

    (found,) = unused(docs, "found")
    rows = docs.withColumn(found, of(text))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"{found}.{a}").alias(b) for a, b in zip(("lang", "score", "rejected"), names, strict=True)))


def known_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those that are rejected."""
    names = unused(docs, "lang_pred", "score", "rejected")
    return identify(docs, model, text, tuple(names)).filter(~F.col(names[2])).drop(*names)


def learn_from(docs: DataFrame) -> DataFrame:
    """Rows that op4 and the pipeline may learn from."""
    return docs.filter(samples.crc_mod("doc_id", 4) != 2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(learn_from(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", samples.held_out("doc_id", 4, 2), "lang_pred", "score", "rejected")
