"""Combination risk: quasi-identifiers that together point at one person."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.text import SPACE, bind

# Weights in hundredths.
WEIGHTS = {"AGE": 35, "ADDRESS": 30, "POSITION": 20, "GENDER": 15, "COMPANY": 15, "ORGANIZATION": 15, "GOVERNMENT": 15, "SCENE": 10}
# Words of gender, digits of numerals, patterns of ages and years of birth.
GENDER = ("男性", "女性", "先生", "小姐", "太太", "女士")
NUMERALS = {"零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
AGE_DIGITS = rf"(?<![0-9])([1-9][0-9]?){SPACE}*歲(?!數)"
AGE_ROC = rf"民國{SPACE}*([0-9]{{1,3}}){SPACE}*年(?:次|生)?"
AGE_WESTERN = rf"((?:19|20)[0-9]{{2}}){SPACE}*年生"
AGE_NUMERAL = "([一二兩三四五六七八九]?十[一二三四五六七八九]?|[一二三四五六七八九])歲"
# Suggestions by type.
SUGGESTIONS = {
    "ADDRESS": "地址建議泛化到市/縣級（例如「信義區光復路259巷」→「台北市」）",
    "POSITION": "職稱可保留，但建議避免同時透露服務公司名稱",
    "GENDER": "若非必要，建議省略性別資訊",
    "COMPANY": "公司名稱可模糊化為產業別（例如「某科技公司」）",
    "ORGANIZATION": "機構名稱可模糊化為機構類型",
    "GOVERNMENT": "政府機關名稱可模糊化為機關層級（例如「某地方政府機關」）",
    "SCENE": "常去地點建議降低描述精確度",
}
AGE_GENERAL = "文字中的年齡資訊建議泛化為 5 歲一個區間（例如「32歲」→「30-35歲」）"
WARNING = 0.6


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def numeral(value: Column) -> Column:
    """A Chinese numeral from 0 to 99 as a number, or null."""
    digit = lambda c, other: F.coalesce(F.try_element_at(_map(NUMERALS), c), F.lit(other))
    left, right = F.split_part(value, F.lit("十"), F.lit(1)), F.split_part(value, F.lit("十"), F.lit(2))
    tens = F.when(left == "", 1).otherwise(digit(left, 1))
    ones = F.when(right == "", 0).otherwise(digit(right, 0))
    return F.when(F.contains(value, F.lit("十")), tens * 10 + ones).otherwise(F.try_element_at(_map(NUMERALS), value))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def age(text: Column, today: str | None = None) -> Column:
    """The age that a text tells, by the first notation found, or null."""
    year = F.year(F.lit(today).cast("date") if today else F.current_date())
    return F.coalesce(
        _first(text, AGE_DIGITS).cast("int"),
        year - (_first(text, AGE_ROC).cast("int") + 1911),
        year - _first(text, AGE_WESTERN).cast("int"),
        numeral(_first(text, AGE_NUMERAL)),
    )


def has_age(text: Column) -> Column:
    return reduce(or_, (text.rlike(p) for p in (AGE_DIGITS, AGE_ROC, AGE_WESTERN, AGE_NUMERAL)))


def has_gender(text: Column) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in GENDER))


def risk_level(score: Column) -> Column:
    return F.when(score >= WARNING, "高").when(score >= 0.3, "中").otherwise("低")


def age_suggestion(text: Column, today: str | None = None) -> Column:

    def hint(found: Column) -> Column:
        low = (F.floor(found / 5) * 5).cast("int")
        return F.when(found.isNull(), AGE_GENERAL).otherwise(F.format_string("「%d歲」建議泛化為「%d-%d歲」", found, low, low + 4))

    return bind(age(text, today), hint)


def combination_risk(text: Column, spans: Column, today: str | None = None) -> Column:
    """(score, contributing_types, risk_level, suggestions) of a text and its spans.

    Both must be of one view: the original with all spans, or the masked with those left.
    """
    none = F.expr("array()").cast("array<string>")
    kinds = F.coalesce(F.transform(spans, lambda s: s["type"]), none) if spans is not None else none
    own = F.concat(F.when(has_age(text), F.array(F.lit("AGE"))).otherwise(none), F.when(has_gender(text), F.array(F.lit("GENDER"))).otherwise(none))
    found = F.array_sort(F.array_distinct(F.concat(F.filter(kinds, lambda k: k.isin(*WEIGHTS)), own)))

    def scored(types: Column) -> Column:
        total = F.aggregate(types, F.lit(0), lambda acc, k: acc + F.element_at(_map(WEIGHTS), k))
        score = F.when(F.size(types) >= 2, F.least(total, F.lit(100)) / 100.0).otherwise(F.lit(0.0))
        hints = F.transform(types, lambda k: F.when(k == "AGE", age_suggestion(text, today)).otherwise(F.try_element_at(_map(SUGGESTIONS), k)))
        return F.struct(score.alias("score"), types.alias("contributing_types"), risk_level(score).alias("risk_level"), F.when(score > 0, hints).otherwise(none).alias("suggestions"))

    return bind(found, scored)


def is_warning_worthy(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) >= WARNING


# Words of the warnings.
FOUND = "偵測到 %d 筆敏感資訊（%s）"
ADDED = "本輪新增 %d 筆個資（%s）"
TOGETHER = "組合風險 %.2f（%s）：%s 同時出現，即使明碼個資已遮蔽，仍可能指認到特定個人"


def counts_warning(counts: Column, words: str = FOUND) -> Column:
    """One line for an array of (type, n): the total, and each type in order; empty for none."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    detail = F.array_join(F.transform(F.array_sort(counts), lambda c: F.format_string("%s x%d", c["type"], c["n"])), "、")
    return F.when(F.size(counts) > 0, F.format_string(words, total, detail)).otherwise("")


def risk_warning(risk: Column) -> Column:
    """The score, level and types of a combination risk, and a line for each suggestion."""
    head = F.format_string(TOGETHER, risk["score"], risk["risk_level"], F.array_join(risk["contributing_types"], "、"))
    return F.array_join(F.concat(F.array(head), F.transform(risk["suggestions"], lambda s: F.concat(F.lit("    · "), s))), "\n")
