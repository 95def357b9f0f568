"""Folding of names: compatibility forms, tag values, CJK numerals, heading numbers, names of majors."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What the last part of a region's name may be.
REGION_SUFFIXES = ["自治区", "特别行政区", "县级市", "省", "市", "区", "县", "州", "盟"]
#: Short names of provinces.
SHORT_FORMS = {
    "京": "北京", "沪": "上海", "津": "天津", "渝": "重庆", "粤": "广东", "浙": "浙江", "苏": "江苏", "闽": "福建", "鲁": "山东", "冀": "河北", "豫": "河南",
    "皖": "安徽", "赣": "江西", "湘": "湖南", "鄂": "湖北", "川": "四川", "黔": "贵州", "滇": "云南", "陕": "陕西", "甘": "甘肃", "青": "青海", "宁": "宁夏",
    "新": "新疆", "藏": "西藏", "桂": "广西", "蒙": "内蒙古", "辽": "辽宁", "吉": "吉林", "黑": "黑龙江", "琼": "海南", "港": "香港", "澳": "澳门", "台": "台湾",
}
#: CJK digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
NUMERAL = "[一二三四五六七八九十百千万零〇两0-9]+"
#: What names of majors may end in.
MAJOR_SUFFIXES = ["职业教育专业教学标准", "中等职业教育专业教学标准", "高等职业教育专科专业教学标准", "专业教学标准", "教学标准", "院校专业简介", "专业简介", "职业能力分析表", "能力分析表"]


#: Texts of an Arrow batch that are Python strings at a time.
TEXTS = 64


def _composed(text: pa.Array) -> pa.Array:
    if not pc.any(pc.invert(pc.string_is_ascii(text))).as_py():
        return text
    return pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], text.type)


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition (NFKC), in Arrow batches of which ``TEXTS`` texts at a time are Python strings: Spark has no function for it; null stays null."""
    return pa.concat_arrays([_composed(text.slice(i, TEXTS)) for i in range(0, len(text), TEXTS)] or [text])


def folded(text: Column) -> Column:
    """NFKC, without white space at the ends, in lower case; null is empty."""
    return F.lower(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", ""))


def lookup(table: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def tag_value(value: Column, suffixes: list[str] | None = None, depth: int = 4) -> Column:
    """The form of a tag that equality is tested on.

    NFKC; bracketed parts go, nested ones up to ``depth``; no white space; lower case; the longest of
    ``suffixes`` that leaves something goes; short names are spelt out.  Null is empty.
    """
    text = nfkc(F.coalesce(value.cast("string"), F.lit("")))
    for _ in range(depth):
        text = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    text = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    if suffixes:
        text = F.regexp_replace(text, "(?<=.)(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$", "")
    return F.coalesce(F.try_element_at(lookup(SHORT_FORMS), text), text)


def numeral(text: Column) -> Column:
    """A whole number in ASCII or CJK digits and units; null if it is none, or 0 in CJK."""
    digit, unit = lookup(DIGITS), lookup(UNITS)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("held"), F.lit(True).alias("good"))

    def step(a: Column, c: Column) -> Column:
        u, d = F.try_element_at(unit, c), F.try_element_at(digit, c)
        times = F.when((a["held"] == 0) & (u == 10), 1).otherwise(a["held"])
        return F.struct(
            F.when(u.isNotNull(), a["total"] + times * u).otherwise(a["total"]).alias("total"),
            F.when(u.isNotNull(), 0).otherwise(F.coalesce(d, F.lit(0))).alias("held"),
            (a["good"] & (u.isNotNull() | d.isNotNull())).alias("good"),
        )

    cjk = F.aggregate(F.split(text, ""), start, step, lambda a: F.when(a["good"] & (a["total"] + a["held"] > 0), a["total"] + a["held"]))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).when(F.length(text) > 0, cjk)


def heading_number(title: Column) -> Column:
    """struct<token, path>: "1.2.3", chapter, section, unit and Chapter N; nulls if there is none."""
    text = F.concat(F.ltrim(F.coalesce(title, F.lit(""))), F.lit(" "))
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    dotted = part(r"^([0-9]+(?:\.[0-9]+){0,3})[\s、.\-)]")
    chapter, section = part(rf"^第\s*({NUMERAL})\s*章"), part(rf"^第\s*({NUMERAL})\s*节")
    unit, english = part(rf"^(?:项目|模块|单元)\s*({NUMERAL})"), part(r"(?i)^Chapter\s+([0-9]+)\b")
    one = lambda n: F.array(n)
    made = lambda token, path: F.struct(token.alias("token"), path.alias("path"))
    return (
        F.when(dotted.isNotNull(), made(dotted, F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("int"))))
        .when(numeral(chapter).isNotNull(), made(F.concat(F.lit("第"), chapter, F.lit("章")), one(numeral(chapter))))
        .when(numeral(section).isNotNull(), made(F.concat(F.lit("第"), section, F.lit("节")), one(numeral(section))))
        .when(numeral(unit).isNotNull(), made(unit, one(numeral(unit))))
        .when(english.isNotNull(), made(F.concat(F.lit("Chapter "), english), one(english.try_cast("int"))))
        .otherwise(made(F.lit(None).cast("string"), F.lit(None).cast("array<int>")))
    )


def major_name(raw: Column) -> Column:
    """Without what kind of paper it heads, twice at most, and without a last 类 that isn't 大类; blank is null."""
    ending = "(?:" + "|".join(sorted(MAJOR_SUFFIXES, key=len, reverse=True)) + ")$"
    name = F.trim(raw)
    for _ in range(2):
        name = F.trim(F.regexp_replace(name, ending, ""))
    return F.nullif(F.trim(F.regexp_replace(name, "(?<!大)类$", "")), F.lit(""))


def merged_maps(old: Column, new: Column) -> Column:
    """Of two map<string, array<string>>: lists of both, without repeats, old first; a key of one side stays."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(F.coalesce(old, F.create_map().cast("map<string,array<string>>")), F.coalesce(new, F.create_map().cast("map<string,array<string>>")), lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))
