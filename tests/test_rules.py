"""Detectors, arbitration, risk, masking and restoring: made-up values of every category."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textveil.functions import risk, text
from textveil.operators import detect, evaluate, mapping, masking, texts
from textveil.operators import spans as sp
from textveil.sources import synth

CASES = [
    "", None, "nothing here", "ID A123456789.", "A123456788", "xA123456789", "A123456789B", "ids A123456789,B223456781 F131104093",
    "tax 04595257 x 12345679 / 04595258", "card 4111-1111-1111-1111 and 4111 1111 1111 1112", "123456789012", "tel 0912345678 0912-345-678 10912345678",
    "(02)2345-6789 02-23456789 0423456789 09-2345678", "m a.b+c@d-e.co.uk, x@y.z, q@w.com", "token = abcdef1 PASSWORD='x/y.z-9' password=abc",
    "sk-abcdefghijklmnopqrstuvwx API_KEY=sk-abcdefghijklmnopqrstuvwx", "xoxb-1234567890-ab eyJa.eyJb.c_d-", "Ａ１２３４５６７８９ ０９１２３４５６７８",
    "line one\nu@ex.com\n4111111111111111", "a0912345678@mail.com", "é04595257 ü A123456789",
]

PY = {  # the same rules in this language's own patterns
    "TW_ID": (r"(?<![A-Za-z0-9])[A-Za-z]\d{9}(?![A-Za-z0-9])", None),
    "EMAIL": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])", None),
    "TW_PHONE_M": (r"(?<!\d)09\d{2}-?\d{3}-?\d{3}(?!\d)", None),
    "TW_NHI": (r"(?<![A-Za-z0-9])\d{12}(?![A-Za-z0-9])", None),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    return {r.id: r for r in detect.detect_all(df, today="2026-01-01").collect()}


def test_spans_are_sound(found):
    for i, t in enumerate(CASES):
        spans = found[i].spans
        assert all((t or "")[s.start : s.end] == s.text for s in spans)
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
        for kind in {s.type for s in spans}:
            own = [s.replacement for s in spans if s.type == kind]
            assert own == [f"[{kind}_{k + 1}]" for k in range(len(own))]


def test_known_values(found):
    kinds = [[s.type for s in found[i].spans] for i in range(len(CASES))]
    assert kinds[3] == ["TW_ID"] and kinds[4] == kinds[5] == kinds[6] == []
    assert kinds[8] == ["TW_TAX"] or kinds[8][0] == "TW_TAX"
    assert kinds[9] == ["CREDIT_CARD"] and kinds[10] == ["TW_NHI"] and kinds[11] == ["TW_PHONE_M"] * 2
    assert kinds[14] == ["API_KEY", "API_KEY"] and kinds[15] == ["API_KEY"] * 2 and kinds[17] == ["TW_ID", "TW_PHONE_M"]
    assert kinds[19] == ["EMAIL"]


@pytest.mark.parametrize("kind", PY)
def test_detectors_against_python(spark, kind):
    d = next(d for d in detect.DETECTORS if d.kind == kind)
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(CASES)], "id int, text string")
    plain = text.normalize_fullwidth(F.col("text"))
    got = {r.id: [(m.start, m.text) for m in r.m] for r in df.select("id", detect.matches(plain, d.pattern, F.lit(True)).alias("m")).collect()}
    wide = str.maketrans({chr(c + 0xFEE0): chr(c) for c in range(48, 123)})
    for i, t in enumerate(CASES):
        assert got[i] == [(m.start(), m.group()) for m in re.finditer(PY[kind][0], (t or "").translate(wide))]


def test_greedy_arbitration(spark):
    rows = [(0, 5, "A", 0.9, "rule"), (3, 9, "B", 0.5, "model"), (9, 12, "C", 0.9, "rule"), (9, 12, "D", 0.9, "model"), (1, 2, "E", 0.1, "rule")]
    df = spark.createDataFrame([(0, rows)], "id int, s array<struct<start:int,end:int,type:string,confidence:double,source:string>>")
    spans = F.transform("s", lambda s: sp.span(s["start"], s["end"], s["type"], F.lit(""), s["confidence"], s["source"], F.lit(None)))
    got = df.select(sp.resolve_overlaps(spans).alias("r")).first().r
    assert [(s.start, s.type) for s in got] == [(1, "E"), (3, "B"), (9, "C")]


def test_strict_validation_raises(spark):
    bad = F.array(sp.span(F.lit(3), F.lit(3), F.lit("A"), F.lit(""), F.lit(0.5), F.lit("rule"), F.lit(None)))
    with pytest.raises(Exception, match="without length"):
        spark.range(1).select(F.size(sp.validate(bad))).collect()
    assert spark.range(1).select(F.size(sp.validate(bad, strict=False)).alias("n")).first().n == 0


@pytest.mark.parametrize("line,kinds,score,level", [("x", [], 0.0, "低"), ("35歲", [], 0.0, "低"), ("35歲 女士", [], 0.5, "中"), ("民國 78 年次 男性", ["ADDRESS"], 0.8, "高"), ("1989年生", ["COMPANY", "COMPANY", "EMAIL"], 0.5, "中"), ("35歲 女士", ["ADDRESS", "POSITION", "COMPANY", "SCENE"], 1.0, "高")])
def test_risk(spark, line, kinds, score, level):
    spans = F.array(*(sp.span(F.lit(0), F.lit(1), F.lit(k), F.lit(""), F.lit(0.9), F.lit("model"), F.lit(None)) for k in kinds)) if kinds else sp.none()
    got = spark.range(1).select(risk.combination_risk(F.lit(line), spans, "2026-01-01").alias("r")).first().r
    assert (got.score, got.risk_level) == (score, level) and (got.suggestions != []) == (score > 0)


@pytest.mark.parametrize("line,age", [("32 歲", 32), ("十五歲", 15), ("二十歲", 20), ("九歲", 9), ("民國90年", 25), ("2000年生", 26), ("35歲數", None), ("x", None)])
def test_age(spark, line, age):
    assert spark.range(1).select(risk.age(F.lit(line), "2026-06-01").alias("a")).first().a == age


def test_mask_and_restore_are_inverse(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "id int, text string").withColumn("scope", F.lit("s"))
    spotted = detect.detect_all(df, today="2026-01-01")
    masked, table = masking.mask(spotted, ["id"], ["id"], ["scope"])
    back = {r.id: r for r in masking.restore(masked.select("id", "scope", "masked"), table, ["id"], ["scope"], text="masked").collect()}
    assert all(back[i].restored_text == t and back[i].unknown == 0 for i, t in enumerate(CASES) if t is not None)
    values = [(r.type, r.value) for r in table.collect()]
    assert len(values) == len(set(values))


def test_extending_a_mapping_keeps_its_numbers(spark):
    sights = spark.createDataFrame([("a", i, "name", f"v{i % 7}") for i in range(30)], "scope string, turn int, type string, value string")
    one = mapping.build(sights, ["turn"], ["scope"])
    two = mapping.extend(mapping.build(sights.filter("turn < 4"), ["turn"], ["scope"]), sights, ["turn"], ["scope"])
    key = lambda t: sorted((r.value, r.token) for r in t.collect())
    assert key(one) == key(two)


def test_restored_json_is_escaped(spark):
    values = F.create_map(F.lit("[NAME_1]"), F.lit('a"b\\\n'))
    got = spark.range(1).select(masking.restored(F.lit("x [NAME_1] [NAME_2]"), values, for_json=True).alias("r")).first().r
    assert got.text == 'x a\\"b\\\\\\n [NAME_2]' and (got.restored, got.unknown) == (1, 1)


def test_model_chunks_and_filters(spark):
    long = "x" * 390 + "陳大明住信義區" + "y" * 500 + "陳大明"
    df = spark.createDataFrame([(1, long), (2, None), (3, "none")], "id int, text string")
    model = texts.gazetteer({"陳大明": "name", "信義區": "address", "yyy": "email"})
    got = {r.id: r.spans for r in texts.detect_model(df, ["id"], "text", model).collect()}
    assert [(s.start, s.type, s.text) for s in got[1]] == [(390, "NAME", "陳大明"), (394, "ADDRESS", "信義區"), (897, "NAME", "陳大明")] and set(got) == {1}


def test_match_is_greedy(spark):
    truth = spark.createDataFrame([(1, 0, 0, 10, "A"), (1, 1, 8, 18, "A"), (2, 0, 0, 4, "B")], "id int, ord int, start int, end int, type string")
    pred = spark.createDataFrame([(1, 0, 1, 11, "A"), (1, 1, 0, 10, "A"), (3, 0, 0, 4, "B")], "id int, ord int, start int, end int, type string")
    got = {r.id: (r.tp, r.fp, r.fn) for r in evaluate.match(pred, truth, "id").collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 1), 3: (0, 1, 0)}


def brute_match(pred, truth, least):
    """(tp, fp, fn) by trying every truth for every prediction, of (ord, start, end, type)."""
    whole = lambda s: None not in s[1:] and s[1] < s[2]
    free, tp = sorted(filter(whole, truth)), 0
    for _, a, b, kind in sorted(filter(whole, pred)):
        shares = [(max(0, min(b, t[2]) - max(a, t[1])) / (max(b, t[2]) - min(a, t[1])) if t[3] == kind else 0.0) for t in free]
        most = max(shares, default=0.0)
        if most > 0 and most >= least:
            del free[shares.index(most)]
            tp += 1
    return tp, len(pred) - tp, len(truth) - tp


@pytest.mark.parametrize("least", [0.5, 0.0, 0.9])
def test_match_tries_all_pairs(spark, least):
    rnd = random.Random(7)

    def spans(n, width):
        """Close and far ones, some at one place, repeated ords, empty, reversed, without place or type."""
        starts = [rnd.randrange(width) for _ in range(n)]
        return [(rnd.choice([i, i // 3]), None if rnd.random() < 0.02 else a, a + rnd.choice([3, 4, 5, 9, 20, 0, -2]), rnd.choice(["A", "A", "B", None])) for i, a in enumerate(starts)]

    sizes = {1: (150, 40), 2: (150, 2000), 3: (90, 300), 4: (3, 5), 5: (1, 3), None: (40, 60)}
    sides = [{k: spans(rnd.randrange(n // 2, n + 1), w) for k, (n, w) in sizes.items()} for _ in range(2)]
    sides[0][6], sides[1][6] = [], [(0, 0, 4, "A")]
    shape = "id int, ord int, start int, end int, type string"
    pred, truth = (spark.createDataFrame([(k, *s) for k, v in side.items() for s in v], shape) for side in sides)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "7")  # runs reach over batches
    try:
        got = {r.id: (r.tp, r.fp, r.fn) for r in evaluate.match(pred, truth, "id", least).collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {k: brute_match(sides[0][k], sides[1][k], least) for k in sides[0]}


def test_match_of_a_long_document(spark):
    """Trying all pairs of 4,000 spans takes many minutes."""
    spans = spark.range(4000).select(F.lit(1).alias("id"), F.col("id").alias("ord"), F.when(F.col("id") < 2000, 7).otherwise(10 * F.col("id")).alias("start"), F.lit("A").alias("type"))
    truth = spans.withColumn("end", F.col("start") + 10)
    pred = truth.withColumn("start", F.col("start") + 1).filter("ord % 2 = 0").withColumn("end", F.col("start") + 10)
    began = time.time()
    assert [tuple(r) for r in evaluate.match(pred, truth, "id").collect()] == [(1, 2000, 0, 2000)]
    assert time.time() - began < 60


def test_synthetic_records(spark):
    people = synth.records(spark, 60)
    assert people.filter(~text.valid_tw_id(F.col("taiwan_id"))).count() == 0
    slices = spark.createDataFrame([("f", 0, 2, "INSERT %d %s %s %s %s;")], "file string, lo int, hi int, template string")
    got = synth.export_files(people, slices).first()
    assert got.text.count("\n") == 1 and got.text.startswith("INSERT 0 ")
