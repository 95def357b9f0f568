"""Tests of picture texts and blocks, and plain names of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of captions and screens, patterns of noise, and names of one entity.
SCREEN_CAPTION = r"(?i)(界面|页面|登录|注册|编辑资料|修改|保存|按钮|菜单|弹窗|对话框|设置|上传|选择照片|更换头像|截图|screen\s*shot|screenshot|interface|login|sign\s*in)"
KNOWLEDGE_CAPTION = r"(?i)(结构|流程|模型|模式|矩阵|导图|关系|架构|原理|示意|趋势|分布|对比|分类|步骤图|知识图|概念图|图谱|framework|model|matrix|process|diagram)"
SCREEN_WORD = r"(?i)(<label>|<text>|<back arrow>|请输入|验证码|密码|登录|注册|保存|取消|确定|点击|按钮|菜单|设置|更换|上传|选择|完善信息|用户协议|隐私政策|手机号|生日|性别|所在地|相册|查看大图|资料完成度)"
WATERMARKS = [r"报告搜一搜", r"长按识别关注公众号", r"扫码关注", r"扫一扫", r"\d{4,}\+?\s*份(行业)?研究报告", r"行业研究报告\s*下载", r"(?m)^\s*关注公众号\s*$"]
DECORATIONS = [
    r"(?m)^\s*>\s*The image is a QR code",
    r"(?mi)^\s*>\s*This (image|figure) is a (QR code|barcode|logo)\b",
    r"(?mi)^\s*>\s*A (QR code|barcode|logo)\b",
    r"(?mi)^\s*>.*?\bQR code \(Quick Response Code\)",
    r"(?mi)^\s*>\s*(Summary:\s*)?This is a branded QR code\b",
    r"(?mi)^\s*>.*?\bbranded QR code\b.*?\b(no additional labels|no text|no technical content|central logo)\b",
]
ENTITY_NAMES = {"我国": "中国", "国内": "中国", "中国国内": "中国", "中华人民共和国": "中国"}
WIDE, NARROW = "　：，（）％", " :,()%"


def is_screenshot(caption: Column, content: Column) -> Column:
    """Whether a picture shows controls of a screen, not knowledge; null caption or content is empty, both empty is false."""
    caption, text = F.trim(F.coalesce(caption, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    both = F.concat_ws("\n", caption, text)
    words, labels = F.regexp_count(both, F.lit(SCREEN_WORD)), F.regexp_count(both, F.lit("(?i)<label>"))
    lines = F.transform(F.split(both, r"\R"), lambda x: F.trim(x))
    controls = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*•]") & (F.length(x) <= 24)))
    named = caption.rlike(SCREEN_CAPTION)
    shown = (named & ((words >= 2) | (labels >= 1) | (controls >= 3))) | (labels >= 2) | (words >= 5)
    return ~caption.rlike(KNOWLEDGE_CAPTION) & shown


def noise_reason(kind: Column, text: Column) -> Column:
    """'watermark_text' for any block, 'decorative_image_vlm' for images and charts, else null, as for null or empty text."""
    found = lambda patterns: F.exists(F.array(*[text.rlike(p) for p in patterns]), lambda x: x)
    return F.when(found(WATERMARKS), "watermark_text").when(kind.isin("image", "chart") & found(DECORATIONS), "decorative_image_vlm")


def entity_name(name: Column) -> Column:
    """Wide marks made narrow, white space collapsed, numbered titles closed up, and one name for one entity; null stays null."""
    plain = F.trim(F.regexp_replace(F.translate(name, WIDE, NARROW), r"\s+", " "))
    plain = F.regexp_replace(plain, r"^(第[一二三四五六七八九十百\d]+[章节篇])\s+", "$1")
    plain = F.regexp_replace(plain, r"^(项目|任务|模块)\s*([一二三四五六七八九十\d]+)\s+", "$1$2")
    known = F.create_map(*[F.lit(x) for pair in ENTITY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)
