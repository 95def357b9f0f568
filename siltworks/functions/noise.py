"""Why a block holds nothing to be found again, and paragraphs that are headings of policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. \w is spelled [\p{L}\p{N}_] and \W_ as what is neither letter nor digit, as Java knows only the ASCII ones.
FOOTER = r"(?i)^\s*(第\s*\d+\s*页(\s*/\s*共\s*\d+\s*页)?|[\-—]\s*\d+\s*[\-—]|Page\s+\d+(\s+of\s+\d+)?|P[.\s]*\d+)\s*$"
DIGITS, SYMBOLS = r"^\s*\d{1,4}\s*$", r"^[^\p{L}\p{N}]+$"
PAGE_MARK = r"^[\-—–－]?\d{1,4}[\-—–－]?$"
SHORT_LABEL = r"(?i)^\s*([A-Z]{1,3}\d{0,2}|\d+[A-Z]{0,2}|[A-Z]\d[A-Z]?)\s*$"
LEAST_CHARS, SMALL_AREA = 4, 2500
QR_CODE = r"(?i)\b(QR\s*code|Quick Response code|matrix barcode)\b"
QR_ONLY = (
    r"(?is)(image\s+(displays|shows|is).*QR\s*code|"
    r"(Summary:\s*)?This is a branded QR\s*code|"
    r"branded QR\s*code.*(central logo|no additional labels|no technical content)|"
    r"QR\s*code.*(central|overlay|alignment|scannable|modules|barcode|no text)|"
    r"matrix barcode)"
)
PROMOTION = [
    r"(?i)^\s*ABOUT\s+US\b",
    r"(?i)^\s*[\p{L}\p{N}_\-]*报告团队出品\s*$",
    r"跨境生态平台.*专注于.*跨境卖家导航",
    r"拥有庞大.*粉丝群体",
    r"(?i)公众号.*粉丝数\s*\d",
]
METADATA = [
    r"^\s*(主\s*编|副\s*主\s*编|编\s*者|作者|责任编辑|责任校对|封面设计|装帧设计)\s*[:：]?\s*[\p{L}\p{N}_\x{4e00}-\x{9fff}、，,.\s·-]{1,80}$",
    r"^[\p{L}\p{N}_\x{4e00}-\x{9fff}\s·\x{2003}]{0,40}(主\s*编|副\s*主\s*编)[\p{L}\p{N}_\x{4e00}-\x{9fff}\s·\x{2003}]{0,80}(出版传媒集团|出版社)\s*$",
    r"^[\x{4e00}-\x{9fff}\s·\x{2003}]{1,30}(主\s*编|副\s*主\s*编)(中国教育出版传媒集团|[\x{4e00}-\x{9fff}]{2,30}出版社)\s*$",
    r"^本书由.{1,40}(担任)?主编.*(副主编|编写分工|项目一|项目二).{0,260}$",
    r"(?i)^\s*ISBN\s+[\d\-]+.*$",
    r"(?i)^\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩI]+[．.].*?(CIP|F\d|TP\d|教材).*$",
    r"(?i)^\s*中国版本图书馆\s*CIP\s*数据核字.*$",
    r"^\s*[A-Z][A-Z\s()\-]{20,}\s*$",
    r"(?i)^\s*(出版社|出版发行|印刷|经销|开本|印张|字数|版次|印次|定价|书号|ISBN)\s*[:：]?\s*.+$",
    r"^\s*版权所有.*(翻印必究|侵权必究)?\s*$",
    r"(?i)^\s*(图书在版编目|CIP数据|版权页|版权信息)\s*$",
    r"^\s*(附录|附\s*录|参考文献|后记|跋|索引|术语表|版权页|出版说明)\s*([A-ZＡ-Ｚ一二三四五六七八九十\d]*)?\s*$",
    r"(?i)^\s*(目\s*录|Contents?)\s*$",
]
TITLE_ECHO = r"(实践|基础|教程|教材|指南|手册|标准|概论)(（[^）]{1,12}）)?$"
CONTENTS = [
    r"(?i)^PART\s+\S.{1,40}$",
    r"^.{2,80}(\.{3,}|…{2,}|·{3,}|—{2,})\s*\d{1,4}\s*$",
    r"^\s*(项目|任务|单元|模块|章|第[一二三四五六七八九十\d]+[章节篇]|附录)[\s一二三四五六七八九十\dA-ZＡ-Ｚ、.．-]*.{0,80}\s+\d{1,4}\s*$",
]
CONTENTS_RUN = r"(项目[一二三四五六七八九十\d].{0,30}){4,}"
CONTENTS_ITEM = r"[（(][一二三四五六七八九十]+[）)]\s*[^（()\n]{2,40}\s+\d{1,3}"
PROJECT_PAGE = r"项目[一二三四五六七八九十\d].{1,30}\s+\d{1,3}"
METRIC_VALUE = r"(同比\s*(增长|下降|增速)?\s*\d|\d[\d,.]*\s*(万亿元|亿元|万家|家|%|％|倍|个|万人|亿美元|万亿|亿|万))"
POLICY_HEADING = r"^\s*([一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十\d]+[）)]|\d+\s*[.．、]|第[一二三四五六七八九十\d]+[章节篇])\s*[^。！？!?；;\n]{2,60}\s*[。.]?\s*$"

_any = lambda x, patterns: reduce(Column.__or__, [x.rlike(p) for p in patterns])
_bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def is_contents(text: Column) -> Column:
    """Lines of a table of contents or a menu; white space is collapsed."""
    pages = (F.regexp_count(text, F.lit(r"\b\d{1,3}\b")) >= 3) | text.rlike(PROJECT_PAGE)
    parts = (F.regexp_count(text, F.lit("PART ")) >= 2) & (F.length(text) <= 160)
    items = (F.regexp_count(text, F.lit(CONTENTS_ITEM)) >= 2) & (F.length(text) <= 220)
    return (text != "") & (_any(text, CONTENTS) | parts | (text.rlike(CONTENTS_RUN) & pages) | items)


def dropped(kind: Column, text: Column, caption: Column, page: Column, area: Column, decorative: Column) -> Column:
    """Why a block goes, the first of: decorative, qr_code, empty_media, empty, footer, digits, symbols, short, promotion, metadata, title_echo, contents; null for one that stays.

    Null texts and captions are empty, a null kind is that of a paragraph, a null area is a large one; tables are never empty media.
    """
    kind = F.coalesce(kind, F.lit("paragraph"))
    media = kind.isin("chart", "image", "table")

    def of(x: Column) -> Column:
        said, label, plain, solid = (x[c] for c in ("said", "label", "plain", "solid"))
        unlabelled = (said == "") | said.rlike(FOOTER) | said.rlike(DIGITS) | solid.rlike(PAGE_MARK) | said.rlike(SYMBOLS)
        small = label.rlike(SHORT_LABEL) & ((said == "") | said.rlike(SYMBOLS)) & (F.coalesce(area, F.lit(float("inf"))) <= SMALL_AREA)
        empty = (kind != "table") & F.when(label != "", small).otherwise(unlabelled)
        echo = (F.coalesce(page, F.lit(0)) <= 5) & F.length(solid).between(8, 40) & ~solid.rlike(r"\d") & solid.rlike(TITLE_ECHO)
        why = F.when(F.coalesce(decorative, F.lit(False)), "decorative").when((kind == "image") & said.rlike(QR_CODE) & said.rlike(QR_ONLY), "qr_code")
        why = why.when(media & empty, "empty_media").when(media, F.lit(None).cast("string"))
        why = why.when(said == "", "empty").when(said.rlike(FOOTER), "footer").when(said.rlike(DIGITS), "digits").when(said.rlike(SYMBOLS), "symbols").when(F.length(solid) < LEAST_CHARS, "short")
        return why.when(_any(said, PROMOTION), "promotion").when(_any(plain, METADATA), "metadata").when(echo, "title_echo").when(is_contents(plain), "contents")

    # Bound, so that the forms of a text are made once, not for each pattern.
    forms = lambda said: F.struct(said.alias("said"), _bare(caption).alias("label"), F.regexp_replace(said, r"\s+", " ").alias("plain"), F.regexp_replace(said, r"\s+", "").alias("solid"))
    return F.get(F.transform(F.transform(F.array(_bare(text)), forms), of), F.lit(0))


def is_policy_heading(text: Column) -> Column:
    """A short numbered paragraph without a figure."""
    said = _bare(text)
    solid = F.regexp_replace(said, r"\s+", "")
    return F.length(solid).between(4, 80) & ~solid.rlike(METRIC_VALUE) & said.rlike(POLICY_HEADING)


def policy_level(text: Column) -> Column:
    said = _bare(text)
    return F.when(said.rlike(r"^([一二三四五六七八九十]+[、.．]|第[一二三四五六七八九十\d]+[章节篇])"), 2).when(said.rlike(r"^[（(][一二三四五六七八九十]+[）)]"), 3).when(said.rlike(r"^([（(]\d+[）)]|\d+\s*[.．、])"), 4).otherwise(3)
