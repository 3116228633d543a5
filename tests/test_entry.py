"""Registered queries: names, and a few against the other engine."""

import json
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textveil.functions import text
from textveil.functions.register import register
from textveil.operators import detect

SF = "/root/testdata/sf0.001"


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 50


def test_flagship(spark):
    got = {r.type: r.n for r in entry.entry(spark).collect()}
    assert got["EMAIL"] > 0 and got["CREDIT_CARD"] > 0


@pytest.mark.parametrize("name", ["det_tw_tax", "document_emails_cards", "json_inner", "stream_events", "mapping_idle", "reply_events", "resolve_overlaps", "risk_score", "mapping_first_seen", "iou_match", "stream_restore"])
def test_against_the_other_engine(spark, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "events", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["prf1_rollup", "iou_match"])
def test_matching_of_long_files(spark, tmp_path, name):
    """90,000 spans in 20 files, which took many minutes when all pairs were tried."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT c.* REPLACE (c_custkey + 15000 * i AS c_custkey) FROM '/root/testdata/sf0.1/customer.parquet' AS c, range(6) AS r(i)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    began = time.time()
    got = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert time.time() - began < 60
    want = con.sql(entry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want)) and len(want) >= 20


def test_sql_functions(spark):
    names = register(spark)
    assert len(names) == 5
    got = spark.sql("SELECT is_valid_credit_card('4111 1111 1111 1111') AS a, is_valid_email('x') AS b, is_valid_tw_phone_m('0912-345678') AS c, is_valid_tw_nhi(NULL) AS d").first()
    assert tuple(got) == (True, False, True, False)


def test_json_of_whole_pages(spark):
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.inner_json for r in entry.queries()["json_inner"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: json.dumps(v, ensure_ascii=False)[1:-1] for k, v in html.items()} == got and max(map(len, html.values())) > 400
    odd = ["x" * 500 + "".join(map(chr, range(128))), "é\u2028" * 300 + '\\"\n', "</script>" * 99, "\x00", ""]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, v string").select("id", text.json_inner(F.col("v")).alias("j")).collect()
    assert all(json.loads(f'"{r.j}"') == odd[r.id] for r in rows)  # strict: no raw control characters


def brute_spans(source):
    """All detectors' spans of a text by this language's own patterns, arbitrated and numbered."""
    source = source or ""
    plain = source.translate({ord(c) + 0xFEE0: c for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"})
    digits = lambda s: [int(c) for c in s if c.isdecimal()]

    def tw_id(s):
        code = "10 11 12 13 14 15 16 17 34 18 19 20 21 22 35 23 24 25 26 27 28 29 32 30 31 33".split()[ord(s[0].upper()) - 65]
        return sum(a * b for a, b in zip(digits(code + s[1:]), (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1), strict=True)) % 10 == 0

    def tax(s):
        sums = [sum(divmod(a * b, 10)) for a, b in zip(digits(s), (1, 2, 1, 2, 1, 2, 4, 1), strict=True)]
        rest = sum(sums) - sums[6]
        return (rest % 5 == 0 or (rest + 1) % 5 == 0) if digits(s)[6] == 7 else sum(sums) % 5 == 0

    def luhn(s):
        return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits(s)[::-1])) % 10 == 0

    alnum, digit = ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"), (r"(?<!\d)", r"(?!\d)")
    rules = [
        ("TW_ID", rf"{alnum[0]}[A-Za-z]\d{{9}}{alnum[1]}", 0.99, tw_id), ("TW_TAX", rf"{alnum[0]}\d{{8}}{alnum[1]}", 0.95, tax), ("TW_NHI", rf"{alnum[0]}\d{{12}}{alnum[1]}", 0.6, None),
        ("TW_PHONE_M", rf"{digit[0]}09\d{{2}}-?\d{{3}}-?\d{{3}}{digit[1]}", 0.9, None),
        ("TW_PHONE_L", rf"{digit[0]}\(?0[2-8]\d{{0,2}}\)?(?:-|\s)?\d{{3,4}}-?\d{{3,4}}{digit[1]}", 0.85, lambda s: 8 <= len(digits(s)) <= 10),
        ("EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])", 0.95, None), ("CREDIT_CARD", rf"{alnum[0]}\d(?:[ -]?\d){{12,18}}{alnum[1]}", 0.95, luhn),
    ]
    found = [(m.start(), m.end(), kind, conf) for kind, pattern, conf, check in rules for m in re.finditer(pattern, plain) if not check or check(m[0])]
    shapes = r"sk-ant-[\w-]{20,}|sk-proj-[\w-]{20,}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,40}|AKIA[0-9A-Z]{16}|AIza[\w-]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]+"
    keys = [m.span() for m in re.finditer(rf"(?a)(?<![\w-])(?:{shapes})(?![\w-])", plain)]
    keys += [m.span(1) for m in re.finditer(r"(?i)\b(?:API[_-]?KEY|TOKEN|PASSWORD)\s*=\s*['\"]?([A-Za-z0-9_\-./+]{6,})['\"]?", plain)]
    end = -1
    for a, b in sorted(keys, key=lambda k: (k[0], -k[1])):
        if a >= end:
            found.append((a, b, "API_KEY", 0.9))
            end = b
    kept = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], -s[3])):  # stable
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    seen, out = Counter(), []
    for a, b, kind, _ in sorted(kept):
        seen[kind] += 1
        out.append((a, b, kind, source[a:b], f"[{kind}_{seen[kind]}]"))
    return out


def test_documents_spans_of_all_detectors(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: brute_spans(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted((r.doc_id, r.start_at, r.end_at, r.kind, r.text, r.replacement) for r in entry.queries()["document_spans"](spark, sf).collect())
    assert got == sorted((i, *s) for i, spans in want.items() for s in spans)
    kinds = Counter(s[2] for spans in want.values() for s in spans)
    assert kinds["API_KEY"] and {r.kind: r.n for r in entry.queries()["type_summary"](spark, sf).collect()} == kinds
    assert {r.doc_id: r.n for r in entry.queries()["memoised_detect"](spark, sf).collect()} == {i: len(s) for i, s in want.items() if s}


def test_all_detectors_overlapping(spark):
    cases = ["token=4111111111111111 x", "PASSWORD = 'a0912345678@mail.com'", "A123456789 04595257 (02)2345-6789 123456789012 api_key=u@ex.com/abc", "sk-abcdefghijklmnopqrstuvwx TOKEN=sk-abcdefghijklmnopqrstuvwx", "card 4111 1111 1111 1111 0912-345-678 Ａ１２３４５６７８９", "", None]
    rows = detect.detect_all(spark.createDataFrame(list(enumerate(cases)), "id int, text string"), today="2026-01-01").collect()
    assert all([(s.start, s.end, s.type, s.text, s.replacement) for s in r.spans] == brute_spans(cases[r.id]) for r in rows)
