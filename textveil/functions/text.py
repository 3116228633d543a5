"""Normalisation and validators as column expressions (no Python per row).

Validators give false, never null, for null input. White space is Python's, digits
are any decimal digits; those beyond ASCII become ASCII ones for checksums only.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"

# 62 full-width letters and digits and what they stand for, by their distance from ASCII.
_HALF = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
_FULL = "".join(chr(ord(c) + 0xFEE0) for c in _HALF)

_OTHER_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_THEIR_VALUES = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)

# Two-digit codes of the letters A to Z, and the weights of the ID's digits.
ID_CODES = (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)
ID_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
# Weights of the tax number's digits.
TAX_WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)


def normalize_fullwidth(text: Column) -> Column:
    """Full-width ASCII letters and digits as ordinary ones; the length stays.

    Texts without any (nearly all) are only searched, not translated letter by letter.
    """
    return F.when(text.rlike(f"[{_FULL[0]}-{_FULL[-1]}]"), F.translate(text, _FULL, _HALF)).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "".join(_OTHER_DIGITS), _THEIR_VALUES)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value written once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digit(text: Column, place: int) -> Column:
    """The digit at a place (from 1); null where there is none."""
    return F.substring(text, place, 1).try_cast("int")


def valid_tw_id(value: Column) -> Column:
    return _is(bind(ascii_digits(F.upper(strip(value))), _tw_id))


def _tw_id(s: Column) -> Column:
    code = F.lit("".join(map(str, ID_CODES)))
    at = F.ascii(s) - 65
    tens = F.substr(code, 2 * at + 1, F.lit(1)).try_cast("int")
    ones = F.substr(code, 2 * at + 2, F.lit(1)).try_cast("int")
    values = [tens, ones, *(_digit(s, i) for i in range(2, 11))]
    total = reduce(add, (v * w for v, w in zip(values, ID_WEIGHTS, strict=True)))
    return F.when(s.rlike(r"\A[A-Z][0-9]{9}\z"), total % 10 == 0)


def valid_tw_tax(value: Column) -> Column:
    return _is(bind(ascii_digits(strip(value)), _tw_tax))


def _tw_tax(s: Column) -> Column:
    products = [_digit(s, i + 1) * w for i, w in enumerate(TAX_WEIGHTS)]
    sums = [F.floor(p / 10).cast("int") + p % 10 for p in products]
    rest = reduce(add, (x for i, x in enumerate(sums) if i != 6))
    ok = F.when(_digit(s, 7) == 7, (rest % 5 == 0) | ((rest + 1) % 5 == 0)).otherwise((rest + sums[6]) % 5 == 0)
    return F.when(s.rlike(r"\A[0-9]{8}\z"), ok)


def valid_tw_nhi(value: Column) -> Column:
    return _is(strip(value).rlike(r"\A\p{Nd}{12}\z"))


def valid_tw_phone_m(value: Column) -> Column:
    return _is(F.replace(strip(value), F.lit("-"), F.lit("")).rlike(r"\A09\p{Nd}{8}\z"))


def valid_tw_phone_l(value: Column) -> Column:
    return _is(F.regexp_replace(value, rf"[()\-]|{SPACE}", "").rlike(r"\A0[2-8]\p{Nd}{6,8}\z"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def valid_email(value: Column) -> Column:
    return _is(strip(value).rlike(rf"\A{EMAIL}\z"))


def valid_credit_card(value: Column) -> Column:
    digits = ascii_digits(F.regexp_replace(strip(value), "[ -]", ""))
    return _is(bind(digits, lambda s: F.when(s.rlike(r"\A[0-9]{13,19}\z"), F.call_function("luhn_check", s))))


# Shapes of well-known vendors' tokens.
KEY_SHAPES = (
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"sk-proj-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"ghp_[A-Za-z0-9]{30,40}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9_-]{20,}",
    r"xox[a-z]-[A-Za-z0-9-]{10,}",
    r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
)
KEY = "(?:" + "|".join(KEY_SHAPES) + ")"


def valid_api_key(value: Column) -> Column:
    return _is(strip(value).rlike(rf"\A{KEY}\z"))


def normalize_type(value: Column) -> Column:
    """Upper case, runs of other characters than A-Z as one underline, none at the ends; PII if empty."""
    clean = F.btrim(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("PII"))


def parse_types(value: Column) -> Column:
    """A comma-separated list as normalised types; blank entries are left out."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.transform(parts, normalize_type)


def fingerprint(text: Column, extra: Column | str = "") -> Column:
    extra = F.lit(extra) if isinstance(extra, str) else extra
    return F.sha2(F.concat(extra, F.lit("\t"), text), 256)


def json_inner(value: Column) -> Column:
    """The text as inside a JSON string, without the quotes; non-ASCII stays."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substr(quoted, F.lit(7), F.length(quoted) - 8))


# Severity and label of the known types; others are medium, labelled by their code.
TYPES = {
    "TW_ID": ("high", "身分證字號"),
    "TW_TAX": ("high", "統一編號"),
    "CREDIT_CARD": ("high", "信用卡號"),
    "API_KEY": ("high", "API 金鑰 / Token"),
    "TW_NHI": ("medium", "健保卡號"),
    "TW_PHONE_M": ("medium", "手機號碼"),
    "TW_PHONE_L": ("medium", "市內電話"),
    "EMAIL": ("low", "電子郵件"),
    "NAME": ("medium", "人名"),
    "ADDRESS": ("medium", "地址 / 地點"),
    "POSITION": ("low", "職稱"),
    "COMPANY": ("low", "公司名稱"),
}


def _lookup(kind: Column, values: dict[str, str], other: Column) -> Column:
    found = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(found, kind), other)


def severity(kind: Column) -> Column:
    return _lookup(kind, {k: v[0] for k, v in TYPES.items()}, F.lit("medium"))


def type_label(kind: Column) -> Column:
    return _lookup(kind, {k: v[1] for k, v in TYPES.items()}, kind)


def is_known_type(kind: Column) -> Column:
    return _is(kind.isin(*TYPES))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def conversation_key(url: Column) -> Column:
    """ph: with the host (and port) and path of a URL."""
    host = F.regexp_extract(url, r"\A[a-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(url, r"\A[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("ph:"), F.lower(host), F.when(path == "", "/").otherwise(path))
