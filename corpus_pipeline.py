"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Every stage works on all rows that its predecessor kept, read again from Parquet.
Documents whose language is rejected go; lines that many documents share stay in
one of them; one document of each group of near duplicates stays; sources are
mixed to their target weights (a document taken in several epochs has as many
rows); the last stage returns the packed pieces. Other columns pass through.

A stage's working tables go when the next stage begins, if its documents have been
written and read again; run() does that, and deletes what it has read itself.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textveil.llm import jaccard_join, language, line_dedup, mixing, packing, scratch
from textveil.ship import ship

_working: list[str] = []  # tables of the stage before

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        scratch.release(spark, _working, but=docs)
        place = scratch.mark()
        out = work(spark, docs, sf_dir)
        _working[:] = scratch.since(place)
        return out

    return run_stage


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; the others (rejected) go."""
    model = language.fit(language.learn_from(docs))
    return language.known_languages(docs, model)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a larger doc_id keeps."""
    return line_dedup.dedup_lines(docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each epoch that takes words of a document, with these words."""
    return mixing.materialise(docs, mixing.mix_sources(docs))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in their sequences."""
    return packing.pack(docs, packing.tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # packing needs a tokenizer; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        before, rows = rows, stage(spark, rows, sf_dir)
        if number < len(STAGES):
            rows = scratch.table(rows, "stage")
            scratch.drop(before)  # the caller's own tables aren't among what drop() knows
    return rows
