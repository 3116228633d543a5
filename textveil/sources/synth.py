"""Synthetic records: deterministic values from a row number, no randomness to seed."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions.text import ID_CODES, ID_WEIGHTS

# Parts of names and addresses.
SURNAMES = "陳林黃張李王吳劉蔡楊許鄭謝洪郭邱曾廖賴徐周葉蘇莊呂江何蕭羅高潘簡"
GIVEN = "志明淑芬俊傑雅婷家豪怡君建宏思穎宗翰佳冠廷詩涵柏宜蓁彥子晴"
PLACES = (
    "台北市信義區", "台北市大安區", "新北市板橋區", "新北市三重區", "台中市西屯區", "台中市北屯區",
    "台南市東區", "台南市安平區", "高雄市苓雅區", "高雄市左營區", "新竹市東區", "新竹市香山區",
)
ROADS = ("中正路", "自由路", "民生路", "光復路", "和平路", "建國路", "文心路", "復興路")


def _pick(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(at, F.lit(len(letters))).cast("int") + 1, F.lit(1))


def taiwan_id(letter: Column, gender: Column, serial: Column) -> Column:
    """The ID of a letter (0 to 25), gender digit and seven-digit serial, with its check digit."""
    digits = F.concat(gender.cast("string"), F.lpad(serial.cast("string"), 7, "0"))
    code = F.element_at(F.array(*map(F.lit, ID_CODES)), letter.cast("int") + 1)
    values = [F.floor(code / 10), code % 10, *(F.substr(digits, F.lit(i), F.lit(1)).cast("int") for i in range(1, 9))]
    total = reduce(add, (v * w for v, w in zip(values, ID_WEIGHTS, strict=False)))
    return F.concat(F.chr(letter + 65), digits, ((10 - total % 10) % 10).cast("string"))


def records(spark: SparkSession, count: int) -> DataFrame:
    """(id, name, taiwan_id, address, phone) of as many invented people."""
    k = F.col("id")
    place = F.element_at(F.array(*map(F.lit, PLACES)), (k % len(PLACES)).cast("int") + 1)
    road = F.element_at(F.array(*map(F.lit, ROADS)), (k % len(ROADS)).cast("int") + 1)
    return spark.range(count).select(
        "id",
        F.concat(_pick(SURNAMES, k), _pick(GIVEN, k * 7), F.when(k % 3 > 0, _pick(GIVEN, k * 11)).otherwise("")).alias("name"),
        taiwan_id(k % 26, 1 + k % 2, (k * 7919) % 10_000_000).alias("taiwan_id"),
        F.concat(place, road, (1 + k % 300).cast("string"), F.lit("巷"), (1 + k * 3 % 500).cast("string"), F.lit("號")).alias("address"),
        F.concat(F.lit("09"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((k * 104_729 % 1_000_000).cast("string"), 6, "0")).alias("phone"),
    )


def export_files(people: DataFrame, slices: DataFrame) -> DataFrame:
    """(file, text): the people of each slice [lo, hi) as a script, a log or a note, by template
    (a printf pattern of id, name, taiwan_id, address, phone) of the slices (file, lo, hi, template)."""
    rows = people.join(F.broadcast(slices), (people["id"] >= slices["lo"]) & (people["id"] < slices["hi"]))
    line = F.call_function("format_string", F.col("template"), "id", "name", "taiwan_id", "address", "phone")
    lines = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return rows.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def business_sentences(names: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, text, business_name, biz_start, biz_end) of names (id, business_name) in templates (n, template) with {biz}."""
    many = templates.count()
    rows = names.join(F.broadcast(templates), F.pmod(names["id"], F.lit(many)) == templates["n"])
    start = F.instr("template", "{biz}") - 1
    return rows.select("id", F.replace("template", F.lit("{biz}"), F.col("business_name")).alias("text"), "business_name", start.alias("biz_start"), (start + F.length("business_name")).alias("biz_end"))


def write(df: DataFrame, path: str) -> None:
    """CSV (with a header) and JSON copies of a table."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")
