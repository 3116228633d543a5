"""Queries by name, each an operator over whole tables or probes, with SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import risk as r
from textveil.functions import text as t
from textveil.operators import detect, evaluate, mapping, masking, texts
from textveil.operators import spans as sp
from textveil.plans import probes as p
from textveil.sources import payloads, protocol, sse, synth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TODAY = "2026-01-01"


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _probe(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql, customer=_table(spark, sf, "customer"))


def _duck(sql: str) -> str:
    return sql.format(customer="customer")


# --- validators and detectors -------------------------------------------------

VALIDATORS = {
    "TW_ID": t.valid_tw_id, "TW_TAX": t.valid_tw_tax, "TW_NHI": t.valid_tw_nhi, "TW_PHONE_M": t.valid_tw_phone_m,
    "TW_PHONE_L": t.valid_tw_phone_l, "EMAIL": t.valid_email, "CREDIT_CARD": t.valid_credit_card, "API_KEY": t.valid_api_key,
}


def _validator(kind: str, check: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: _probe(spark, sf, p.one(kind)).select("id", "v", check(F.col("v")).alias("ok"))


def _detector(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = next((d for d in detect.DETECTORS if d.kind == kind), None)
        text = t.normalize_fullwidth(F.col("text"))
        found = detect.detect(text, d) if d else detect.detect_api_key(text)
        rows = sp.exploded(_probe(spark, sf, p.two(kind)).withColumn("s", found), "s", "id")
        return rows.select("id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "text", "replacement")

    return run


for _kind, _check in VALIDATORS.items():
    _add(f"valid_{_kind.lower()}", f"SELECT id, v, {p.valid(_kind, 'v')} AS ok FROM ({_duck(p.one(_kind))})")(_validator(_kind, _check))
    _add(
        f"det_{_kind.lower()}",
        f"""SELECT id, start_at, start_at + length(text) AS end_at, text,
        '[{_kind}_' || row_number() OVER (PARTITION BY id ORDER BY start_at) || ']' AS replacement FROM (
          SELECT id, CAST(3 AS BIGINT) AS start_at, v AS text FROM ({_duck(p.two(_kind))}) UNION ALL
          SELECT id, CAST(6 + length(v) AS BIGINT), w FROM ({_duck(p.two(_kind))})) WHERE {p.valid(_kind, "text")}""",
    )(_detector(_kind))

_ASSIGN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'api-key = ' WHEN c_custkey % 3 = 1 THEN 'Token=' ELSE 'my password  =  ' END AS head, lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 5 = 0 THEN 5 ELSE 9 END, 'z') AS v FROM {customer}"


@_add("det_assignment", f"SELECT id, length(head) + 2 AS start_at, v AS text FROM ({_duck(_ASSIGN)}) WHERE length(v) >= 6")
def _assignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _ASSIGN).select("id", F.concat(F.lit("- "), F.col("head"), F.col("v"), F.lit(" end")).alias("line"))
    rows = sp.exploded(rows.withColumn("s", detect.detect_api_key(F.col("line"))), "s", "id")
    return rows.select("id", F.col("start").cast("long").alias("start_at"), "text")


# --- scalar functions ---------------------------------------------------------

_WIDE = "translate({0}, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '" + "".join(chr(ord(c) + 0xFEE0) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + "')"


@_add("norm_fullwidth", "SELECT c_custkey AS id, c_name || ' é#1' AS plain, CAST(length(c_name) + 4 AS BIGINT) AS n FROM customer")
def _fullwidth(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, f"SELECT c_custkey AS id, {_WIDE.format('c_name')} || ' é#１' AS wide FROM {{customer}}")
    return rows.select("id", t.normalize_fullwidth(F.col("wide")).alias("plain"), F.length("wide").cast("long").alias("n"))


_TYPES = "SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'name' WHEN 1 THEN 'Address2' WHEN 2 THEN ' e-mail ' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '__a__B9' ELSE c_mktsegment END AS v FROM {customer}"
_NORM = "coalesce(nullif(trim(regexp_replace(upper(coalesce(v, '')), '[^A-Z]+', '_', 'g'), '_'), ''), 'PII')"


@_add("type_norm", f"SELECT id, {_NORM} AS kind FROM ({_duck(_TYPES)})")
def _type_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf, _TYPES).select("id", t.normalize_type(F.col("v")).alias("kind"))


@_add("fingerprint", "SELECT doc_id, sha256('1' || chr(9) || coalesce(text, '')) AS fp FROM documents")
def _fp(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", t.fingerprint(F.coalesce("text", F.lit("")), "1").alias("fp"))


@_add("json_inner", "SELECT page_id, substr(j, 2, length(j) - 2) AS inner_json FROM (SELECT page_id, CAST(to_json(html) AS VARCHAR) AS j FROM pages)")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", t.json_inner(F.col("html")).alias("inner_json"))


@_add("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def _html(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", t.escape_html(F.col("html")).alias("safe"))


@_add("conversation_key", r"SELECT page_id, 'ph:' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS key FROM pages")
def _key(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", t.conversation_key(F.col("url")).alias("key"))


_KINDS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'TW_ID' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'NAME' WHEN 3 THEN 'COMPANY' ELSE 'OTHER' END AS kind FROM {customer}"


@_add("severity_dim", f"SELECT kind, CASE kind WHEN 'TW_ID' THEN 'high' WHEN 'EMAIL' THEN 'low' WHEN 'COMPANY' THEN 'low' ELSE 'medium' END AS severity, kind <> 'OTHER' AS known, count(*) AS n FROM ({_duck(_KINDS)}) GROUP BY ALL")
def _severity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _KINDS).select("kind", t.severity(F.col("kind")).alias("severity"), t.is_known_type(F.col("kind")).alias("known"))
    return rows.groupBy("kind", "severity", "known").agg(F.count(F.lit(1)).alias("n"))


_AGES = "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey % 89 + 10 AS STRING) || ' 歲' WHEN 1 THEN '民國 ' || CAST(c_custkey % 90 + 1 AS STRING) || ' 年次' WHEN 2 THEN CAST(1920 + c_custkey % 100 AS STRING) || '年生' WHEN 3 THEN '三十五歲' WHEN 4 THEN '十歲數' ELSE '35歲數' END AS text FROM {customer}"


@_add("age", f"SELECT id, CASE id % 6 WHEN 0 THEN id % 89 + 10 WHEN 1 THEN 2026 - (id % 90 + 1912) WHEN 2 THEN 2026 - (1920 + id % 100) WHEN 3 THEN 35 WHEN 4 THEN 10 END AS years FROM ({_duck(_AGES)})")
def _age(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf, _AGES).select("id", r.age(F.col("text"), TODAY).cast("long").alias("years"))


# --- composition, arbitration, filters ------------------------------------------

_MIX = f"SELECT id, 'ID ' || v || ' tel 0912-' || lpad(CAST(id AS STRING), 6, '5') || ' mail u' || CAST(id AS STRING) || '@ex.com' AS text, v FROM ({p.one('TW_ID')}) AS q"
_MIX_SPANS = f"""SELECT id, start_at, kind, text, '[' || kind || '_1]' AS replacement FROM (
  SELECT id, 3 AS start_at, 'TW_ID' AS kind, v AS text FROM ({_duck(_MIX)}) WHERE {p.valid("TW_ID", "v")} UNION ALL
  SELECT id, 18, 'TW_PHONE_M', substr(text, 19, 11) FROM ({_duck(_MIX)}) UNION ALL
  SELECT id, 35, 'EMAIL', 'u' || id || '@ex.com' FROM ({_duck(_MIX)}))"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return detect.detect_all(_probe(spark, sf, _MIX), today=TODAY)


@_add("detect_all_spans", f"SELECT id, CAST(start_at AS BIGINT) AS start_at, kind, text, replacement FROM ({_MIX_SPANS})")
def _all(spark: SparkSession, sf: str) -> DataFrame:
    rows = sp.exploded(_mixed(spark, sf).select("id", "spans"), "spans", "id")
    return rows.select("id", F.col("start").cast("long").alias("start_at"), F.col("type").alias("kind"), "text", "replacement")


# Boundaries doubled, as the checking engine's patterns can't look around.
_DOC_SPANS = r"""
WITH m AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([^A-Za-z0-9._%+-])', '\1\1', 'g'), '(^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@@[A-Za-z0-9.-]+\.[A-Za-z]{2,})([^A-Za-z0-9._%+-]|$)', 2) AS e FROM documents),
c AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '([^A-Za-z0-9])', '\1\1', 'g'), '(^|[^A-Za-z0-9])(\d(?:(?:  |--)?\d){12,18})([^A-Za-z0-9]|$)', 2) AS e FROM documents),
v AS (SELECT doc_id, 'EMAIL' AS kind, replace(unnest(e), '@@', '@') AS text FROM m UNION ALL
      SELECT doc_id, 'CREDIT_CARD', replace(replace(unnest(e), '  ', ' '), '--', '-') FROM c)
SELECT doc_id, kind, text FROM v WHERE kind = 'EMAIL' OR """ + p.valid("CREDIT_CARD", "replace(replace(text, ' ', ''), '-', '')")


@_add("document_emails_cards", _DOC_SPANS)
def _emails_cards(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    kinds = tuple(d for d in detect.DETECTORS if d.kind in ("EMAIL", "CREDIT_CARD"))
    plain = t.normalize_fullwidth(F.coalesce("text", F.lit("")))
    found = F.concat(*(detect.detect(plain, d) for d in kinds))
    rows = sp.exploded(docs.select("doc_id", found.alias("s")).filter(F.size("s") > 0).withColumn("s", sp.renumber(sp.resolve_overlaps(F.col("s")))), "s", "doc_id")
    return rows.select("doc_id", F.col("type").alias("kind"), "text")


# All detectors, arbitrated: the checking engine's patterns can't look around.


@_add("document_spans")
def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = detect.detect_all(_table(spark, sf, "documents").select("doc_id", "text"), today=TODAY)
    rows = sp.exploded(docs.select("doc_id", "spans"), "spans", "doc_id")
    return rows.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("type").alias("kind"), "text", "replacement")


@_add("type_summary")
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return document_spans(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Three spans a row, by arithmetic of the key.
_THREE = """SELECT c_custkey AS id, CAST(c_custkey % 7 AS INT) AS s1, CAST(c_custkey % 7 + 3 + c_custkey % 4 AS INT) AS e1,
  CAST(2 + c_custkey % 5 AS INT) AS s2, CAST(6 + c_custkey % 5 AS INT) AS e2,
  CAST(8 + c_custkey % 3 AS INT) AS s3, CAST(10 + c_custkey % 3 + c_custkey % 2 AS INT) AS e3 FROM {customer}"""
_RANKED = f"""SELECT id, n, s, e, conf, row_number() OVER (PARTITION BY id ORDER BY s - e, -conf, src, n) AS rk FROM (
  SELECT id, 1 AS n, s1 AS s, e1 AS e, 0.9 AS conf, 0 AS src FROM ({_duck(_THREE)}) UNION ALL
  SELECT id, 2, s2, e2, 0.9, 1 FROM ({_duck(_THREE)}) UNION ALL SELECT id, 3, s3, e3, 0.5, 0 FROM ({_duck(_THREE)}))"""


def _three(spark: SparkSession, sf: str) -> DataFrame:
    def one(n: int, kind: str, conf: float, source: str) -> Column:
        return sp.span(F.col(f"s{n}"), F.col(f"e{n}"), F.lit(kind), F.lit(str(n)), F.lit(conf), F.lit(source), F.lit(None))

    rows = _probe(spark, sf, _THREE)
    return rows.withColumn("spans", F.array(one(1, "A", 0.9, "rule"), one(2, "B", 0.9, "model"), one(3, "A", 0.5, "rule")))


@_add(
    "resolve_overlaps",
    f"""WITH r AS ({_RANKED}), w AS (SELECT a.*, b.s AS bs, b.e AS be, c.s AS cs, c.e AS ce, c.n AS cn FROM r a JOIN r b ON a.id = b.id AND b.rk = 2 JOIN r c ON a.id = c.id AND c.rk = 3 WHERE a.rk = 1),
    k AS (SELECT *, NOT (s < be AND bs < e) AS b_ok FROM w)
    SELECT id, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at FROM k UNION ALL SELECT id, bs, be FROM k WHERE b_ok
    UNION ALL SELECT id, cs, ce FROM k WHERE NOT (s < ce AND cs < e) AND NOT (b_ok AND bs < ce AND cs < be)""",
)
def _resolve(spark: SparkSession, sf: str) -> DataFrame:
    rows = sp.exploded(_three(spark, sf).withColumn("spans", sp.resolve_overlaps(F.col("spans"))), "spans", "id")
    return rows.select("id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


@_add(
    "ner_dedupe",
    f"""WITH r AS (SELECT id, n, s, e, CASE n WHEN 2 THEN 'B' ELSE 'A' END AS kind FROM ({_RANKED}))
    SELECT id, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, kind FROM r a WHERE NOT EXISTS (
      SELECT 1 FROM r b WHERE b.id = a.id AND b.kind = a.kind AND b.n <> a.n AND b.s <= a.s AND a.e <= b.e AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.n < a.n)))""",
)
def _dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = sp.exploded(_three(spark, sf).withColumn("spans", sp.drop_contained(F.col("spans"))), "spans", "id")
    return rows.select("id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), F.col("type").alias("kind"))


@_add("allow_list", f"SELECT id, n AS span_no FROM ({_RANKED}) WHERE n <> 2")
def _allow(spark: SparkSession, sf: str) -> DataFrame:
    rows = sp.exploded(_three(spark, sf).withColumn("spans", sp.keep_allowed(F.col("spans"), ("A",))), "spans", "id")
    return rows.select("id", F.col("text").cast("int").alias("span_no"))


@_add("skip_list", f"SELECT id, sum(CASE WHEN n = 2 THEN 0 ELSE 1 END)::BIGINT AS masked, sum(CASE WHEN n = 2 THEN 1 ELSE 0 END)::BIGINT AS left_over FROM ({_RANKED}) GROUP BY id")
def _skip(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("spans")
    return _three(spark, sf).select("id", F.size(sp.to_mask(s, ("B",))).cast("long").alias("masked"), F.size(sp.residual(s, ("B",))).cast("long").alias("left_over"))


@_add("validate_extra", f"SELECT id, CAST(count(*) FILTER (WHERE e - s > 2) AS BIGINT) AS sound FROM ({_RANKED}) GROUP BY id")
def _validate(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.transform("spans", lambda s: F.when(s["end"] - s["start"] > 2, s).otherwise(s.withField("confidence", F.lit(float("nan")))))
    return _three(spark, sf).select("id", F.size(sp.validate(bad, strict=False)).cast("long").alias("sound"))


@_add("extra_span_merge", f"SELECT id, CAST(0 AS BIGINT) AS start_at, 'NAME' AS kind, '[NAME_1]' AS replacement FROM ({_duck(_MIX)}) WHERE NOT {p.valid('TW_ID', 'v')} UNION ALL SELECT id, CAST(start_at AS BIGINT), kind, replacement FROM ({_MIX_SPANS})")
def _extra(spark: SparkSession, sf: str) -> DataFrame:
    # a model span over the ID: it stays where the ID isn't valid, loses against its own length otherwise
    one = sp.span(F.lit(0), F.lit(10), F.lit("name"), F.substr("text", F.lit(1), F.lit(10)), F.lit(0.8), F.lit("model"), F.lit(None))
    noise = sp.span(F.lit(0), F.lit(40), F.lit("game"), F.lit("?"), F.lit(0.99), F.lit("model"), F.lit(None))
    rows = _probe(spark, sf, _MIX).withColumn("extra", F.array(one.withField("type", F.upper(F.lit("name"))), noise))
    rows = sp.exploded(detect.detect_all(rows, extra="extra", today=TODAY, allowed=("NAME", "ADDRESS")).select("id", "spans"), "spans", "id")
    return rows.select("id", F.col("start").cast("long").alias("start_at"), F.col("type").alias("kind"), "replacement")


_ENTITIES = "SELECT c_custkey AS id, CAST(350 * (c_custkey % 3) AS INT) AS chunk_start, CASE c_custkey % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'email' WHEN 2 THEN 'name' ELSE 'mobile' END AS entity_group, CAST((c_custkey % 10) / 10.0 AS DOUBLE) AS score, CAST(c_custkey % 50 AS INT) AS start, CAST(c_custkey % 50 + 4 AS INT) AS {end}, CASE WHEN c_custkey % 8 = 0 THEN '信義區x' ELSE 'abcd' END AS text FROM {customer}"


@_add("entity_filters", "SELECT id, upper(entity_group) AS kind, CAST(start + chunk_start AS BIGINT) AS start_at FROM (" + _ENTITIES.format(customer="customer", end='"end"') + ") WHERE score >= 0.5 AND (entity_group = 'name' OR (entity_group = 'address' AND text LIKE '%區%'))")
def _entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _ENTITIES.replace("{end}", "`end`"))
    return texts.format_entities(rows).select("id", F.col("type").alias("kind"), F.col("start").cast("long").alias("start_at"))


@_add("chunk_windows", "SELECT doc_id, CAST(350 * i AS BIGINT) AS start_at, substr(text, CAST(350 * i + 1 AS BIGINT), 400) AS chunk FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, CAST(greatest(1, 1 + ceil((length(coalesce(text, '')) - 400) / 350.0)) AS BIGINT))) AS i FROM documents)")
def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", F.explode(texts.chunks(F.coalesce("text", F.lit("")))).alias("c"))
    return docs.select("doc_id", F.col("c.start").cast("long").alias("start_at"), "c.chunk")


# --- risk --------------------------------------------------------------------------

_RISKS = """SELECT c_custkey AS id, c_custkey % 13 AS payload, CASE WHEN c_custkey % 2 = 0 THEN '35歲 ' ELSE 'x ' END || CASE WHEN c_custkey % 3 = 0 THEN '女士' ELSE 'y' END AS text,
  CASE WHEN c_custkey % 5 = 0 THEN 'ADDRESS' ELSE 'EMAIL' END AS k1, CASE WHEN c_custkey % 7 = 0 THEN 'COMPANY' ELSE 'POSITION' END AS k2 FROM {customer}"""
_RISK_SQL = f"""SELECT id, payload, kinds, CASE WHEN len(kinds) >= 2 THEN least(total, 100) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (
  SELECT id, payload, list_sort(list_filter([CASE WHEN id % 2 = 0 THEN 'AGE' END, CASE WHEN id % 3 = 0 THEN 'GENDER' END, CASE WHEN id % 5 = 0 THEN 'ADDRESS' END, k2], lambda x: x IS NOT NULL)) AS kinds,
  CASE WHEN id % 2 = 0 THEN 35 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 15 ELSE 20 END AS total FROM ({_duck(_RISKS)}))"""


def _risky(spark: SparkSession, sf: str) -> DataFrame:
    spans = F.array(*(sp.span(F.lit(0), F.lit(1), F.col(k), F.lit("v"), F.lit(0.9), F.lit("model"), F.lit(None)) for k in ("k1", "k2")))
    return _probe(spark, sf, _RISKS).withColumn("risk", r.combination_risk(F.col("text"), spans, TODAY))


@_add("risk_score", f"SELECT id, score, array_to_string(kinds, ',') AS kinds, CASE WHEN score >= 0.6 THEN '高' WHEN score >= 0.3 THEN '中' ELSE '低' END AS level, score >= 0.6 AS warn FROM ({_RISK_SQL})")
def _risk(spark: SparkSession, sf: str) -> DataFrame:
    return _risky(spark, sf).select("id", "risk.score", F.array_join("risk.contributing_types", ",").alias("kinds"), F.col("risk.risk_level").alias("level"), r.is_warning_worthy(F.col("risk.score")).alias("warn"))


@_add("risk_suggestions", f"SELECT id, CASE WHEN id % 6 < 3 OR id % 6 IN (3, 4) THEN '「' || years || '歲」建議泛化為「' || CAST(floor(years / 5) * 5 AS INT) || '-' || CAST(floor(years / 5) * 5 + 4 AS INT) || '歲」' ELSE '{r.AGE_GENERAL}' END AS hint FROM ({ORACLES['age']})")
def _hints(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf, _AGES).select("id", r.age_suggestion(F.col("text"), TODAY).alias("hint"))


@_add("residual_risk_argmax", f"SELECT payload, id, score FROM (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY score DESC, id) AS rk FROM ({_RISK_SQL})) WHERE rk = 1")
def _argmax(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max(F.struct(F.col("risk.score").alias("score"), (-F.col("id")).alias("first"))).alias("b")
    return _risky(spark, sf).groupBy("payload").agg(best).select("payload", (-F.col("b.first")).alias("id"), "b.score")


# --- mapping, masking, restoring ------------------------------------------------------

_SIGHTS = "SELECT c_custkey % 10 AS scope, c_custkey AS turn, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE 'E-mail' END AS type, 'v' || CAST(c_custkey * 7 % 113 AS STRING) AS value FROM {customer}"
_NUMBERED = f"""SELECT scope, type, value, row_number() OVER (PARTITION BY scope, type ORDER BY first) AS n FROM (
  SELECT scope, CASE type WHEN 'name' THEN 'NAME' ELSE 'E_MAIL' END AS type, value, min(turn) AS first FROM ({_duck(_SIGHTS)}) GROUP BY ALL)"""


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.build(_probe(spark, sf, _SIGHTS), ["turn"], ["scope"])


@_add("mapping_first_seen", f"SELECT scope, type AS kind, value, n, '[' || type || '_' || n || ']' AS token FROM ({_NUMBERED})")
def _first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("scope", F.col("type").alias("kind"), "value", "n", "token")


@_add("mapping_extend", f"SELECT scope, type AS kind, value, n FROM ({_NUMBERED})")
def _extend(spark: SparkSession, sf: str) -> DataFrame:
    # all sightings up to a turn, then the later ones: the numbers are those of one pass
    rows = _probe(spark, sf, _SIGHTS)
    early = mapping.build(rows.filter("turn <= 500"), ["turn"], ["scope"])
    return mapping.extend(early, rows.filter("turn > 500"), ["turn"], ["scope"]).select("scope", F.col("type").alias("kind"), "value", "n")


@_add("issued_counts", f"SELECT scope, type AS kind, max(n) AS issued FROM ({_NUMBERED}) GROUP BY ALL")
def _issued(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.issued_counts(_numbered(spark, sf), ["scope"]).select("scope", F.col("type").alias("kind"), "issued")


_HALVES = f"""SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.type, b.type) AS type, coalesce(b.n, 0) AS b, a.n AS a FROM
  (SELECT scope, type, count(DISTINCT value) AS n FROM ({_duck(_SIGHTS)}) GROUP BY ALL) a LEFT JOIN
  (SELECT scope, type, count(DISTINCT value) AS n FROM ({_duck(_SIGHTS)}) WHERE turn <= 700 GROUP BY ALL) b ON a.scope = b.scope AND a.type = b.type"""


@_add("new_values", f"SELECT scope, CASE type WHEN 'name' THEN 'NAME' ELSE 'E_MAIL' END AS kind, a - b AS added FROM ({_HALVES}) WHERE a > b")
def _new(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _SIGHTS)
    count = lambda x: mapping.issued_counts(mapping.build(x, ["turn"], ["scope"]), ["scope"])
    return mapping.new_value_counts(count(rows.filter("turn <= 700")), count(rows), ["scope", "type"]).select("scope", F.col("type").alias("kind"), "added")


@_add("mapping_sessions_idle", "SELECT event_id, CAST(sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def _idle(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "events").select("event_id", "user_id", "ts")
    return mapping.idle_sessions(rows, "user_id", "ts", "event_id").select("event_id", "session")


_MASKED = f"SELECT id, CASE WHEN {p.valid('TW_ID', 'v')} THEN 'ID [TW_ID_1]' ELSE 'ID ' || v END || ' tel [TW_PHONE_M_1] mail [EMAIL_1]' AS masked, CASE WHEN {p.valid('TW_ID', 'v')} THEN 3 ELSE 2 END AS n, text FROM ({_duck(_MIX)})"


def _masked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _mixed(spark, sf).select("id", "text", "spans")
    return masking.mask(rows, ["id"], [], ["id"])


@_add("mask_text", f"SELECT id, masked, CAST(n AS BIGINT) AS n_masked FROM ({_MASKED})")
def _mask(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(spark, sf)[0].select("id", "masked", "n_masked")


@_add("roundtrip", f"SELECT id, text AS restored_text, CAST(n AS BIGINT) AS restored, CAST(0 AS BIGINT) AS unknown FROM ({_MASKED})")
def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    masked, table = _masked(spark, sf)
    back = masking.restore(masked.select("id", "masked"), table, ["id"], ["id"], text="masked")
    return back.select("id", "restored_text", "restored", "unknown")


_REPLIES = "SELECT c_custkey AS id, c_custkey % 10 AS scope, 'see [NAME_' || CAST(c_custkey % 9 AS STRING) || '], [E_MAIL_' || CAST(c_custkey % 40 AS STRING) || '] and [x_1] [NAME_1' AS text FROM {customer}"


@_add("restore_text", f"""WITH m AS (SELECT scope, '[' || type || '_' || n || ']' AS token, value FROM ({_NUMBERED}))
  SELECT r.id, 'see ' || coalesce(a.value, '[NAME_' || r.id % 9 || ']') || ', ' || coalesce(b.value, '[E_MAIL_' || r.id % 40 || ']') || ' and [x_1] [NAME_1' AS restored_text,
  CAST((a.value IS NOT NULL)::INT + (b.value IS NOT NULL)::INT AS BIGINT) AS restored, CAST((a.value IS NULL)::INT + (b.value IS NULL)::INT AS BIGINT) AS unknown
  FROM ({_duck(_REPLIES)}) r LEFT JOIN m a ON a.scope = r.scope AND a.token = '[NAME_' || r.id % 9 || ']' LEFT JOIN m b ON b.scope = r.scope AND b.token = '[E_MAIL_' || r.id % 40 || ']'""")
def _restore(spark: SparkSession, sf: str) -> DataFrame:
    back = masking.restore(_probe(spark, sf, _REPLIES), _numbered(spark, sf), ["id"], ["scope"])
    return back.select("id", "restored_text", "restored", "unknown")


# --- memoisation and telemetry --------------------------------------------------------

@_add("cache_hits", "SELECT count(*) - count(DISTINCT text) AS hits, count(DISTINCT text) AS misses, (count(*) - count(DISTINCT text)) / count(*)::DOUBLE AS hit_rate FROM (SELECT text FROM conversations UNION ALL SELECT text FROM conversations WHERE turn = 0)")
def _cache(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations")
    return texts.cache_stats(c.select("text").unionByName(c.filter("turn = 0").select("text")), [])


@_add("memoised_detect")
def _memo(spark: SparkSession, sf: str) -> DataFrame:
    def count(df: DataFrame, text: str) -> DataFrame:
        return detect.detect_all(df, text, today=TODAY).withColumn("n", F.size("spans").cast("long")).drop("spans", "combination_risk")

    return texts.memoised(_table(spark, sf, "documents").select("doc_id", "text"), "text", count).filter("n > 0").select("doc_id", "n")


@_add("traffic_snapshot", "SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, CAST(epoch(TIMESTAMP '2026-01-01') - epoch(max(ts)) AS DOUBLE) AS idle FROM events GROUP BY event_type")
def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts.traffic(_table(spark, sf, "events"), F.lit("2026-01-01 00:00:00").cast("timestamp"), by=["event_type"])
    return rows.select("event_type", F.col("count").alias("n"), "first_at", "last_at", F.col("seconds_since_last").alias("idle"))


@_add("event_ring", "SELECT event_id AS id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100) WHERE event_id > (SELECT max(event_id) - 60 FROM events)")
def _ring(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").select(F.col("event_id").alias("id"))
    top = events.agg(F.max("id").alias("m"))  # one row
    return texts.recent(events, 100).join(F.broadcast(top), F.col("id") > F.col("m") - 60).select("id")


@_add("first_arrival", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM events")
def _arrival(spark: SparkSession, sf: str) -> DataFrame:
    return texts.first_arrival(_table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("event_id", "is_first")


# --- evaluation ------------------------------------------------------------------------

_PAIRS = "SELECT c_custkey % 20 AS file, c_custkey AS ord, CAST(100 * c_custkey AS INT) AS s, CAST(100 * c_custkey + 10 AS INT) AS e, CAST(100 * c_custkey + c_custkey % 9 AS INT) AS ps, CASE WHEN c_custkey % 3 = 0 THEN 'ADDRESS' ELSE 'NAME' END AS kind FROM {customer}"
_MATCH = f"SELECT file, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp, count(*) FILTER (WHERE NOT hit) AS fn FROM (SELECT file, kind = 'NAME' AND (10 - (ps - s)) / (10.0 + (ps - s)) >= 0.5 AS hit FROM ({_duck(_PAIRS)})) GROUP BY file"


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _PAIRS)
    truth = rows.select("file", "ord", F.col("s").alias("start"), F.col("e").alias("end"), F.col("kind").alias("type"))
    pred = rows.select("file", "ord", F.col("ps").alias("start"), (F.col("ps") + 10).alias("end"), F.lit("NAME").alias("type"))
    return evaluate.match(pred, truth, "file")


@_add("iou_match", f"SELECT file, tp, fp, fn FROM ({_MATCH})")
def _iou(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("file", "tp", F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"))


@_add("prf1_rollup", f"SELECT file, tp / (tp + fp)::DOUBLE AS prec, tp / (tp + fn)::DOUBLE AS recall, 2.0 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM (SELECT file, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({_MATCH}) GROUP BY ROLLUP (file))")
def _prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.scores(_matched(spark, sf), "file").select("file", F.col("precision").alias("prec"), "recall", "f1")


_BIZ = "SELECT c_custkey AS id, CAST(5 AS INT) AS biz_start, CAST(9 AS INT) AS biz_end, CAST(c_custkey % 12 AS INT) AS s, CASE WHEN c_custkey % 5 = 0 THEN 'ADDRESS' ELSE 'COMPANY' END AS kind FROM {customer}"


@_add("business_fp", f"SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'not_detected' THEN 1 ELSE 0 END) AS BIGINT) AS other_noise FROM (SELECT CASE WHEN NOT (s < 9 AND 5 < s + 3) THEN 'not_detected' WHEN kind = 'COMPANY' THEN 'company' ELSE 'confused' END AS outcome FROM ({_duck(_BIZ)})) GROUP BY outcome")
def _biz(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _BIZ)
    pred = rows.select("id", F.lit(0).alias("ord"), F.col("s").alias("start"), (F.col("s") + 3).alias("end"), F.col("kind").alias("type"))
    return evaluate.name_tally(rows, pred)


@_add("name_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS n, CAST(strpos(text, 'the ') - 1 AS BIGINT) AS first_at FROM documents WHERE text LIKE '%the %'")
def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    found = _table(spark, sf, "documents").select("doc_id", evaluate.occurrences(F.col("text"), F.lit("the ")).alias("o")).filter(F.size("o") > 0)
    return found.select("doc_id", F.size("o").cast("long").alias("n"), F.get("o", F.lit(0)).cast("long").alias("first_at"))


# --- payloads, protocol, event streams ----------------------------------------------------

_BODIES = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN '/v1/models' ELSE '/v1/chat/completions' END AS path,
  CASE WHEN c_custkey % 7 = 0 THEN 'not json' ELSE '{"system": "s' || CAST(c_custkey AS STRING) || '", "messages": [{"role": "user", "content": "u' || CAST(c_custkey AS STRING) || '@ex.com"}, 5, {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "tool_use", "id": "i", "name": "f", "input": {"a": ["x", {"b": "y"}]}}]}]}' END AS body FROM CUSTOMER"""
_BODY_SQL = _BODIES.replace("CUSTOMER", "customer")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return _probe(spark, sf, _BODIES.replace("{", "{{").replace("}", "}}").replace("CUSTOMER", "{customer}"))


@_add("payload_flatten", f"SELECT request_id, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS ord, unnest(['u' || request_id || '@ex.com', 't', 'x', 'y', 's' || request_id]) AS text FROM ({_BODY_SQL}) WHERE request_id % 7 <> 0 AND request_id % 5 <> 0")
def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.scan(_requests(spark, sf)).select("request_id", F.col("ord").cast("long").alias("ord"), "text")


@_add("payload_mask", f"SELECT request_id, CASE WHEN request_id % 7 = 0 OR request_id % 5 = 0 THEN CAST(NULL AS VARCHAR) ELSE '[EMAIL_1]' END AS user_text, CASE WHEN request_id % 7 = 0 OR request_id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_masked FROM ({_BODY_SQL})")
def _payload_mask(spark: SparkSession, sf: str) -> DataFrame:
    masked, _ = payloads.mask_payloads(_requests(spark, sf), ["request_id"], today=TODAY)
    text = F.when(F.col("n_masked") > 0, F.get_json_object("masked_body", "$.messages[0].content"))
    return masked.select("request_id", text.alias("user_text"), F.col("n_masked").cast("long").alias("n_masked"))


@_add("protocol_translate", f"SELECT request_id, 's' || request_id AS system_text, 'u' || request_id || '@ex.com' AS user_text, '{{\"a\": [\"x\", {{\"b\": \"y\"}}]}}' AS arguments FROM ({_BODY_SQL}) WHERE request_id % 7 <> 0")
def _protocol(spark: SparkSession, sf: str) -> DataFrame:
    rows = _requests(spark, sf).withColumn("chat", protocol.to_chat(F.col("body"), "m")).filter("chat IS NOT NULL")
    get = lambda path: F.get_json_object("chat", path)
    return rows.select("request_id", get("$.messages[0].content").alias("system_text"), get("$.messages[1].content").alias("user_text"), get("$.messages[2].tool_calls[0].function.arguments").alias("arguments"))


def _stream(spark: SparkSession, sf: str, size: int = 7) -> DataFrame:
    """Chunks of a few bytes each: a token of every reply is split over two events."""
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("stream_id"))
    part = lambda text: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), text, F.lit('"}}]}\n\n'))
    n = (F.col("stream_id") % 9).cast("string")
    body = F.concat(part(F.lit("見 [NA")), part(F.concat(F.lit("ME_"), n)), part(F.lit("] ok")), F.lit("data: [DONE]\n\n"))
    data = rows.select("stream_id", (F.col("stream_id") % 10).alias("scope"), F.encode(body, "UTF-8").alias("b"))
    starts = F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(size))
    return data.select("stream_id", "scope", F.posexplode(starts).alias("seq", "at"), "b").select("stream_id", "scope", "seq", F.substr("b", F.col("at") + 1, F.lit(size)).alias("chunk"))


@_add("sse_parse", "SELECT c_custkey AS stream_id, 'content' AS channel, '見 [NAME_' || c_custkey % 9 || '] ok' AS text FROM customer")
def _sse(spark: SparkSession, sf: str) -> DataFrame:
    return sse.texts(sse.deltas(sse.events(sse.whole(_stream(spark, sf)))))


@_add("stream_restore", f"""SELECT c_custkey AS stream_id, '見 ' || coalesce(m.value, '[NAME_' || c_custkey % 9 || ']') || ' ok' AS restored_text FROM customer
  LEFT JOIN (SELECT scope, '[' || type || '_' || n || ']' AS token, value FROM ({_NUMBERED})) m ON m.scope = c_custkey % 10 AND m.token = '[NAME_' || c_custkey % 9 || ']'""")
def _stream_restore(spark: SparkSession, sf: str) -> DataFrame:
    found = sse.texts(sse.deltas(sse.events(sse.whole(_stream(spark, sf))))).withColumn("scope", F.col("stream_id") % 10)
    return masking.restore(found, _numbered(spark, sf), ["stream_id"], ["scope"]).select("stream_id", "restored_text")


@_add("reply_events", """SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 3 = 0 THEN 9 ELSE 6 END AS BIGINT) AS events, 'hi ' || c_custkey AS text,
  CASE WHEN c_custkey % 3 = 0 THEN 'tool_use' ELSE 'end_turn' END AS stop_reason, CASE WHEN c_custkey % 3 = 0 THEN '{}' ELSE '' END AS arguments FROM customer""")
def _reply(spark: SparkSession, sf: str) -> DataFrame:
    # the finish reason of a whole reply doesn't count, its calls do; a call without arguments has {}
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    calls = F.when(F.col("id") % 3 == 0, F.lit(', "tool_calls": [{"id": "c", "function": {"name": "f"}}]')).otherwise("")
    reason = F.when(F.col("id") % 2 == 0, "stop").otherwise("length")
    reply = F.concat(F.lit('{"choices":[{"finish_reason":"'), reason, F.lit('","message":{"content":"hi '), F.col("id").cast("string"), F.lit('"'), calls, F.lit("}}]}"))
    body = protocol.to_events(reply, "m", F.concat(F.lit("msg_"), F.col("id").cast("string")))
    out = rows.select("id", body.alias("body"))
    get = lambda pattern: F.regexp_extract("body", pattern, 1)
    return out.select("id", F.regexp_count("body", F.lit("event: ")).cast("long").alias("events"), get('"text_delta", "text": "([^"]*)"').alias("text"), get('"stop_reason": "([^"]+)"').alias("stop_reason"), get('"partial_json": "([^"]*)"').alias("arguments"))


_EVENTS = """SELECT c_custkey AS stream_id, unnest(CASE WHEN c_custkey % 2 = 0 THEN [{'e': 'message_start', 'i': NULL, 'p': NULL}, {'e': 'content_block_start', 'i': 0, 'p': 'text'}, {'e': 'content_block_delta', 'i': 0, 'p': 'he'},
  {'e': 'content_block_delta', 'i': 0, 'p': 'y'}, {'e': 'content_block_stop', 'i': 0, 'p': NULL}, {'e': 'content_block_start', 'i': 1, 'p': 'c7'}, {'e': 'content_block_delta', 'i': 1, 'p': '{'},
  {'e': 'content_block_delta', 'i': 1, 'p': '}'}, {'e': 'content_block_start', 'i': 2, 'p': 'text'}, {'e': 'content_block_delta', 'i': 2, 'p': 'x'}, {'e': 'content_block_stop', 'i': 2, 'p': NULL},
  {'e': 'content_block_start', 'i': 3, 'p': 'toolu_msg_' || c_custkey || '_1'}, {'e': 'content_block_stop', 'i': 1, 'p': NULL}, {'e': 'content_block_stop', 'i': 3, 'p': NULL}, {'e': 'message_delta', 'i': NULL, 'p': 'max_tokens'}, {'e': 'message_stop', 'i': NULL, 'p': NULL}]
  ELSE [{'e': 'message_start', 'i': NULL, 'p': NULL}, {'e': 'message_delta', 'i': NULL, 'p': 'end_turn'}, {'e': 'message_stop', 'i': NULL, 'p': NULL}] END) AS x,
  generate_subscripts(CASE WHEN c_custkey % 2 = 0 THEN range(16) ELSE range(3) END, 1) AS n FROM customer"""


@_add("stream_events", f"SELECT stream_id, CAST(n - 1 AS BIGINT) AS n, x.e AS event, CAST(x.i AS BIGINT) AS block, x.p AS part FROM ({_EVENTS})")
def _stream_events(spark: SparkSession, sf: str) -> DataFrame:
    event = lambda delta, rest="": f'data: {{"choices":[{{"delta":{{{delta}}}{rest}}}]}}\n\n'
    call = lambda i, more: f'"tool_calls":[{{"index":{i}{more}}}]'
    full = "".join([
        ": note\n\n", event('"content":"he"'), event('"content":"y"'), "data: not json\n\n", event(call(0, ',"id":"c7","function":{"name":"f","arguments":"{"}')), event(call(0, ',"function":{"arguments":"}"}')),
        event('"content":"x"'), event(call(1, ""), ',"finish_reason":"length"'), "data: [DONE]\n\n",
    ])
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("stream_id"))
    rows = rows.withColumn("body", F.when(F.col("stream_id") % 2 == 0, full).otherwise("data: [DONE]\n\n"))
    found = protocol.stream_events(rows, "m", F.concat(F.lit("msg_"), F.col("stream_id").cast("string")))
    get = lambda path: F.get_json_object("data", path)
    part = F.coalesce(get("$.delta.text"), get("$.delta.partial_json"), get("$.delta.stop_reason"), get("$.content_block.id"), get("$.content_block.type"))
    return found.select("stream_id", "n", "event", get("$.index").cast("long").alias("block"), part.alias("part"))


@_add("stream_deltas", "SELECT c_custkey AS stream_id, unnest(['a ', '[X_' || c_custkey || '] b ', '[y c ', '[NAM']) AS text, unnest([false, false, false, true]) AS is_rest FROM customer")
def _stream_deltas(spark: SparkSession, sf: str) -> DataFrame:
    # a token over three events; "[y" waits until it can't be one; "[NAM" is left at the end
    part = lambda text: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), text, F.lit('"}}]}\n\n'))
    k = F.col("stream_id").cast("string")
    body = F.concat(part(F.lit("a [X")), part(F.concat(F.lit("_"), k)), part(F.lit("] b [y")), part(F.lit(" c [NAM")), F.lit("data: [DONE]\n\n"))
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("stream_id")).withColumn("body", body)
    return sse.safe_deltas(sse.deltas(sse.events(rows))).select("stream_id", "text", F.col("last").alias("is_rest"))


_CONTENTS = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '{"system":[{"type":"image"}],"messages":[{"content":"x"}]}' WHEN 1 THEN '{"messages":[{"content":[{"type":"text"},{"type":"document"}]}]}'
  WHEN 2 THEN '{"messages":[{"content":[{"type":"tool_result","content":[{"type":"image"}]}]}]}' ELSE '{"messages":[5,{"content":[{"type":"tool_result","content":"t"}]}]}' END AS body FROM CUSTOMER"""


@_add("unsupported_content", "SELECT c_custkey AS id, c_custkey % 4 IN (1, 2) AS bad FROM customer")
def _unsupported(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _CONTENTS.replace("{", "{{").replace("}", "}}").replace("CUSTOMER", "{customer}"))
    return rows.select("id", protocol.has_unsupported(F.col("body")).alias("bad"))


@_add("header_projection", "SELECT c_custkey AS id, 'X-A,authorization' AS sent, 'Bearer k' || c_custkey AS credentials, 'X-A' AS answered FROM customer")
def _headers(spark: SparkSession, sf: str) -> DataFrame:
    names = ("X-A", "Host", "Authorization", "x-api-key", "Transfer-Encoding", "content-length", "TE")
    headers = F.create_map(*(F.lit(x) for n in names for x in (n, "v")))
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), headers.alias("h"))
    sent = payloads.upstream_headers(F.col("h"), F.concat(F.lit("k"), F.col("id").cast("string")))
    answer = F.create_map(*(F.lit(x) for n in ("X-A", "Content-Encoding", "Connection", "Trailer") for x in (n, "v")))
    listed = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return rows.select("id", listed(sent).alias("sent"), F.element_at(sent, "authorization").alias("credentials"), listed(payloads.agent_headers(answer)).alias("answered"))


_RESPONSES = """SELECT c_custkey AS request_id, '/v1/responses' AS path, '{"instructions":"i","input":[{"content":[{"text":"c' || CAST(c_custkey AS STRING) || '"},{"x":1}]},{"arguments":"g","output":"o"},7,"s"]}' AS body FROM CUSTOMER"""


@_add("responses_flatten", "SELECT c_custkey AS request_id, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS ord, unnest(['i', 'c' || c_custkey, 'g', 'o', 's']) AS text FROM customer")
def _responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = _probe(spark, sf, _RESPONSES.replace("{", "{{").replace("}", "}}").replace("CUSTOMER", "{customer}"))
    return payloads.scan(rows).select("request_id", F.col("ord").cast("long").alias("ord"), "text")


_RISKY = """SELECT c_custkey AS request_id, '/v1/chat/completions' AS path, '{"messages":[{"content":"u' || CAST(c_custkey AS STRING) || '@ex.com' || CASE WHEN c_custkey % 2 = 0 THEN ' 35歲' ELSE '' END || '"},{"content":"女士 ' || CASE WHEN c_custkey % 3 = 0 THEN '40歲' ELSE '' END || '"}]}' AS body FROM CUSTOMER"""


@_add("payload_residual_risk", "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN 0.5::DOUBLE END AS score, CASE WHEN c_custkey % 3 = 0 THEN 'AGE,GENDER' END AS kinds FROM customer")
def _payload_risk(spark: SparkSession, sf: str) -> DataFrame:
    # the worst field counts: an age in one field and a gender in another are no combination
    rows = _probe(spark, sf, _RISKY.replace("{", "{{").replace("}", "}}").replace("CUSTOMER", "{customer}"))
    masked, _ = payloads.mask_payloads(rows, ["request_id"], today=TODAY)
    return masked.select("request_id", "residual_risk.score", F.array_join("residual_risk.contributing_types", ",").alias("kinds"))


@_add("restore_body", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'FF5B4E414D455F315D' ELSE hex(encode('{\"t\": \"見 a\\\"b [NAME_2]\"}')) END AS body FROM customer")
def _restore_body(spark: SparkSession, sf: str) -> DataFrame:
    # values are escaped for JSON; bytes that aren't UTF-8 pass as they are
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    values = F.create_map(F.lit("[NAME_1]"), F.lit('a"b'))
    body = F.when(F.col("id") % 3 == 0, F.unhex(F.lit("FF5B4E414D455F315D"))).otherwise(F.encode(F.lit('{"t": "見 [NAME_1] [NAME_2]"}'), "UTF-8"))
    return rows.select("id", F.hex(masking.restore_body(body, values)).alias("body"))


# --- lists, limits, reports -----------------------------------------------------------------


@_add("type_list", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'POSITION,E_MAIL' ELSE '' END AS kinds FROM customer")
def _type_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return rows.select("id", F.array_join(t.parse_types(F.when(F.col("id") % 2 == 0, " position, ,e-mail").otherwise(" , ")), ",").alias("kinds"))


@_add("span_choice", f"SELECT id, CAST(count(*) FILTER (WHERE id % 3 = 0 OR n = 1 + id % 3) AS BIGINT) AS n FROM ({_RANKED}) GROUP BY id")
def _choice(spark: SparkSession, sf: str) -> DataFrame:
    picks = F.when(F.col("id") % 3 > 0, F.array((F.col("id") % 3).cast("int")))
    return _three(spark, sf).select("id", F.size(sp.chosen(F.col("spans"), picks)).cast("long").alias("n"))


@_add("history_limit", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 50")
def _history(spark: SparkSession, sf: str) -> DataFrame:
    return texts.last_of(_table(spark, sf, "events"), ["user_id"], "event_id", 50).select("event_id", "user_id")


@_add("states_alive", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-10') - epoch(ts) <= 43200")
def _alive(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.live(_table(spark, sf, "events"), F.lit("2024-01-10 00:00:00").cast("timestamp"), "ts").select("event_id")


_SESSIONS = """SELECT user_id, event_id, ts, event_type, CAST(floor(value) AS INT) % 7 AS v, CAST(sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session
  FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)"""


@_add("mapping_idle", f"""SELECT user_id, session, kind, value, row_number() OVER (PARTITION BY user_id, session, kind ORDER BY f) AS n FROM (
  SELECT user_id, session, CASE WHEN event_type = 'click' THEN 'NAME' ELSE 'EMAIL' END AS kind, 'v' || v AS value, min((ts, event_id)) AS f FROM ({_SESSIONS}) WHERE v IS NOT NULL GROUP BY ALL)""")
def _mapping_idle(spark: SparkSession, sf: str) -> DataFrame:
    # any masking call of a scope keeps all of its types alive; after a pause numbers start anew
    rows = _table(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "click", "NAME").otherwise("EMAIL").alias("type"), F.concat(F.lit("v"), (F.floor("value").cast("int") % 7).cast("string")).alias("value"))
    calls = mapping.idle_sessions(rows, "user_id", "ts", "event_id")
    table = mapping.build(calls.filter("value IS NOT NULL"), ["ts", "event_id"], ["user_id", "session"])
    return table.select("user_id", "session", F.col("type").alias("kind"), "value", "n")


@_add("warnings", f"""SELECT scope, '偵測到 ' || CAST(sum(n) AS BIGINT) || ' 筆敏感資訊（' || string_agg(type || ' x' || n, '、' ORDER BY type) || '）' AS found,
  '本輪新增 ' || CAST(sum(n) AS BIGINT) || ' 筆個資（' || string_agg(type || ' x' || n, '、' ORDER BY type) || '）' AS added FROM (SELECT scope, type, max(n) AS n FROM ({_NUMBERED}) GROUP BY ALL) GROUP BY scope""")
def _warnings(spark: SparkSession, sf: str) -> DataFrame:
    counts = mapping.issued_counts(_numbered(spark, sf), ["scope"])
    rows = counts.groupBy("scope").agg(F.collect_list(F.struct("type", F.col("issued").alias("n"))).alias("c"))
    return rows.select("scope", r.counts_warning(F.col("c")).alias("found"), r.counts_warning(F.col("c"), r.ADDED).alias("added"))


@_add("risk_warning", f"""SELECT id, '組合風險 ' || printf('%.2f', score) || '（' || CASE WHEN score >= 0.6 THEN '高' WHEN score >= 0.3 THEN '中' ELSE '低' END || '）：' || array_to_string(kinds, '、') || ' 同時出現，即使明碼個資已遮蔽，仍可能指認到特定個人' AS head,
  CAST(CASE WHEN score > 0 THEN len(kinds) ELSE 0 END AS BIGINT) AS hints FROM ({_RISK_SQL})""")
def _risk_warning(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split(r.risk_warning(F.col("risk")), "\n")
    return _risky(spark, sf).select("id", F.get(lines, F.lit(0)).alias("head"), (F.size(lines) - 1).cast("long").alias("hints"))


@_add("latency_stats", "SELECT event_type, count(*) AS n, min(value) AS least, round(avg(value), 6) AS mean, median(value) AS mid, max(value) AS most FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) WHERE nth > 1 GROUP BY event_type")
def _latency(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.latency_stats(_table(spark, sf, "events"), ["event_type"], "event_id", "value")
    return found.select("event_type", "n", "least", F.round("mean", 6).alias("mean"), F.col("median").alias("mid"), "most")


@_add("label_inventory", "SELECT DISTINCT c_mktsegment AS kind FROM customer UNION SELECT 'B-SIDE' UNION SELECT 'PLAIN'")
def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "customer")
    head = F.when(F.col("c_custkey") % 2 == 0, "B-").otherwise("I-")
    labels = rows.select(F.concat(head, "c_mktsegment").alias("label")).unionByName(spark.sql("SELECT explode(array('O', 'I-B-SIDE', 'PLAIN')) AS label"))
    return evaluate.entity_types(labels).select(F.col("type").alias("kind"))


@_add("synth_ids", "SELECT CAST(i AS BIGINT) AS id, length(v) AS n, " + p.valid("TW_ID", "v") + " AS ok FROM (SELECT i, 'A123456789' AS v FROM range(500) t(i))")
def _synth(spark: SparkSession, sf: str) -> DataFrame:
    rows = synth.records(spark, 500)
    return rows.select("id", F.length("taiwan_id").cast("long").alias("n"), t.valid_tw_id(F.col("taiwan_id")).alias("ok"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type of what the documents hold: all detectors, arbitrated."""
    rows = detect.detect_all(_table(spark, sf, "documents").select("doc_id", "text"), today=TODAY)
    return sp.exploded(rows.select("doc_id", "spans"), "spans", "doc_id").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
