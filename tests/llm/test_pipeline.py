"""The pipeline: stages against brute force on the smallest given tables, and the rows that go wrong first."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import LINE, LONG, brute_lines, brute_sets
from textveil.llm import language, mixing, packing, scratch

SF = "/root/testdata/sf0.001"


def texts(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = set(docs.columns), docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(kept) if number < 4 else None
        after = stage(spark, kept, SF)
        after.write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert set(after.columns) == columns, name
        if name == "language ID":
            model = language.fit(language.learn_from(docs))
            assert texts(after) == [(i, t) for i, t in before if not model.predict([t])[0][2]]
        elif name == "line dedup":
            assert texts(after) == sorted(brute_lines(before)[0], key=repr)
        elif name == "n-gram Jaccard join":
            groups = brute_sets([t for _, t in before])
            least = {}
            for k, (_, root) in groups.items():
                least[root] = min(least.get(root, before[k][0]), before[k][0])
            assert texts(after) == [p for k, p in enumerate(before) if p[0] == least[groups[k][1]]]
        elif name == "mixing to target weights":
            words = lambda t: len(re.findall(mixing.WORD, t))
            total, of = sum(words(t) for _, t in before), dict(before)
            assert abs(sum(words(t) for _, t in texts(after)) - total) <= 20
            assert all(set(t.split()) <= set(of[i].split()) for i, t in texts(after))
        else:
            want = packing.tokenized(kept, packing.tokenizer_path()).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
            got = after.groupBy("doc_id").agg(F.sum("length").alias("n"))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        kept = after


@pytest.mark.parametrize("many", [0, 30])
def test_odd_rows_and_empty_tables(spark, tmp_path, many):
    rows = [(i, f"{LINE} and more words {i % 4}\n{LONG[: 40 * i]}", None, None if i % 2 else "s", 5, "x", "y") for i in range(many)]
    rows += [(None, "null id", "en", "s", 1, "x", "y"), (3, "again", "en", None, 1, None, "y"), (4, None, None, None, None, None, None), (5, "", "en", "s", 0, "x", "y")] if many else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __gone string, doc string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not got if not many else all(0 < r["length"] <= 4096 for r in got)


def test_working_tables_go(spark, tmp_path):
    place = scratch.mark()
    corpus_pipeline.run(spark, SF).write.parquet(str(tmp_path / "out"))
    left = len(scratch.since(place))
    scratch.release(spark)
    assert left < 12 and not scratch.since(0)
