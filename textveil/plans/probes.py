"""Probe rows that SQL of either engine builds alike, and checks of their values in SQL.

The given tables hold few identifiers, so probes are made from customer keys: the same
text is one engine's DataFrame and the other's subquery. {customer} is the table.
"""

from __future__ import annotations

_K = "CAST(c_custkey AS STRING)"

# kind -> a candidate value of the key k (an SQL expression of both engines)
VALUES = {
    "TW_ID": "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({k} % 26 AS INT) + 1, 1) || CAST(1 + {k} % 2 AS STRING) || lpad(CAST({k} AS STRING), 8, '0')",
    "TW_TAX": "lpad(CAST({k} * 7919 % 100000000 AS STRING), CASE WHEN {k} % 9 = 0 THEN 7 ELSE 8 END, '0')",
    "TW_NHI": "lpad(CAST({k} * 104729 AS STRING), CASE WHEN {k} % 4 = 0 THEN 11 ELSE 12 END, '1')",
    "TW_PHONE_M": "CASE WHEN {k} % 5 = 0 THEN '08' ELSE '09' END || lpad(CAST({k} % 100 AS STRING), 2, '0') || CASE WHEN {k} % 2 = 0 THEN '-' ELSE '' END || lpad(CAST({k} AS STRING), 6, '3')",
    "TW_PHONE_L": "CASE WHEN {k} % 3 = 0 THEN '(0' || CAST({k} % 10 AS STRING) || ')' ELSE '0' || CAST({k} % 10 AS STRING) || '-' END || lpad(CAST({k} AS STRING), 7, '2')",
    "EMAIL": "'u' || CAST({k} AS STRING) || '@ex' || CAST({k} % 7 AS STRING) || CASE WHEN {k} % 4 = 0 THEN '' ELSE '.com' END",
    "CREDIT_CARD": "lpad(CAST({k} * 104729 AS STRING), CASE WHEN {k} % 8 = 0 THEN 12 ELSE 16 END, '4')",
    "API_KEY": "CASE WHEN {k} % 2 = 0 THEN 'ghp_' ELSE 'AKIA' END || lpad(CAST({k} AS STRING), CASE WHEN {k} % 3 = 0 THEN 31 ELSE 16 END, '7')",
}


def value(kind: str, k: str = "c_custkey") -> str:
    return VALUES[kind].format(k=f"({k})")


def one(kind: str) -> str:
    """(id, v)"""
    return f"SELECT c_custkey AS id, {value(kind)} AS v FROM {{customer}}"


def two(kind: str) -> str:
    """(id, v, w, text): two candidates in a text, at 3 and after v."""
    return f"SELECT id, v, w, 'x: ' || v || ' / ' || w || ' .' AS text FROM (SELECT c_custkey AS id, {value(kind)} AS v, {value(kind, 'c_custkey + 1')} AS w FROM {{customer}}) AS q"


def _digit(c: str, i: str) -> str:
    return f"CAST(substr({c}, {i}, 1) AS INT)"


def valid(kind: str, c: str) -> str:
    """SQL of the checking engine for whether a probe's value is valid."""
    if kind == "TW_ID":
        code = f"CAST(substr('1011121314151617341819202122352324252627282932303133', 2 * (ascii({c}) - 65) + 1, 2) AS INT)"
        rest = " + ".join(f"{10 - i} * {_digit(c, str(i))}" for i in range(2, 10))
        return f"(length({c}) = 10 AND ({code} // 10 + 9 * ({code} % 10) + {rest} + {_digit(c, '10')}) % 10 = 0)"
    if kind == "TW_TAX":
        parts = [f"(({_digit(c, str(i + 1))} * {w}) // 10 + ({_digit(c, str(i + 1))} * {w}) % 10)" for i, w in enumerate((1, 2, 1, 2, 1, 2, 4, 1))]
        rest = " + ".join(p for i, p in enumerate(parts) if i != 6)
        return f"(length({c}) = 8 AND CASE WHEN length({c}) <> 8 THEN false WHEN substr({c}, 7, 1) = '7' THEN ({rest}) % 5 IN (0, 4) ELSE ({rest} + {parts[6]}) % 5 = 0 END)"
    if kind == "TW_NHI":
        return f"(length({c}) = 12)"
    if kind == "TW_PHONE_M":
        return f"(substr({c}, 1, 2) = '09' AND length(replace({c}, '-', '')) = 10)"
    if kind == "TW_PHONE_L":
        return rf"regexp_full_match(regexp_replace({c}, '[()-]', '', 'g'), '0[2-8]\d{{6,8}}')"
    if kind == "EMAIL":
        return f"({c} LIKE '%.com')"
    if kind == "CREDIT_CARD":
        total = f"list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(substr(reverse({c}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({c}), i, 1) AS INT)) % 10 ELSE CAST(substr(reverse({c}), i, 1) AS INT) END))"
        return f"(length({c}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"
    return f"CASE WHEN {c} LIKE 'ghp_%' THEN length({c}) BETWEEN 34 AND 44 ELSE length({c}) = 20 END"
