"""Validators and detectors as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Rules that plain SQL can state; the patterns are the column functions' own.
_SQL = {
    "is_valid_tw_nhi": r"coalesce(rlike(v, r'\A\p{Nd}{12}\z'), false)",
    "is_valid_tw_phone_m": r"coalesce(rlike(replace(v, '-', ''), r'\A09\p{Nd}{8}\z'), false)",
    "is_valid_tw_phone_l": r"coalesce(rlike(regexp_replace(v, r'[()\-\s]', ''), r'\A0[2-8]\p{Nd}{6,8}\z'), false)",
    "is_valid_email": r"coalesce(rlike(trim(v), r'\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z'), false)",
    "is_valid_credit_card": r"coalesce(rlike(regexp_replace(v, '[ -]', ''), r'\A[0-9]{13,19}\z') AND luhn_check(regexp_replace(v, '[ -]', '')), false)",
}


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions name(v STRING) RETURNS BOOLEAN; returns their names."""
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BOOLEAN RETURN {body}")
    return list(_SQL)
