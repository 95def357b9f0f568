"""Pages against a parser that keeps its state, and the defined cases."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

from siltworks.operators import pages


def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


class Reader(HTMLParser):
    """Blocks by a state machine: (kind, level, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.kind, self.level, self.held, self.out = 0, "paragraph", None, [], []

    def edge(self, kind="paragraph", level=None):
        text = squeeze("".join(self.held))
        if text and not any(x in text for x in pages.NOISE):
            self.out.append((self.kind, self.level, text))
        self.kind, self.level, self.held = kind, level, []

    def handle_starttag(self, tag, attrs):
        if tag in pages.SKIPPED:
            self.skip += tag not in pages.VOID
        elif not self.skip and tag in pages.HEADINGS:
            self.edge("heading", int(tag[1]))
        elif not self.skip and tag in pages.PARAGRAPHS:
            self.edge()
        elif not self.skip and tag == "li":
            self.edge("list")
        elif not self.skip and tag == "br":
            self.held.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag not in pages.SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in pages.SKIPPED:
            self.skip = max(0, self.skip - (tag not in pages.VOID))
        elif not self.skip and tag in [*pages.HEADINGS, *pages.PARAGRAPHS, "li"]:
            self.edge()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(squeeze(data))


def read(html):
    r = Reader()
    r.feed(html)
    r.close()
    r.edge()
    return r.out


def random_page(rng):
    parts = []
    for _ in range(rng.randrange(30)):
        tag = rng.choice(["div", "p", "nav", "a", "li", "h2", "b", "section", "footer", "article", "form", "td"])
        parts.append(
            rng.choice(
                [
                    f"<{tag}>", f"</{tag}>", f'<{tag} class="a>b" id=\'x\'>', f"<{tag.upper()}>", "<br>", "<br/>", "<meta charset='u'>", "<!-- <p>no</p> -->", "<script>var a = '<p>';</script>", "<style>p{}</style>",
                    " \n\t", "a&amp;b", "c &lt; d", "&eacute; x ", "word ", "é𝒳 ", "上一篇", "&#65;", "- item",
                ]
            )
        )
    return "".join(parts)


def test_blocks_equal_a_parser(spark):
    rng = random.Random(4)
    html = [None, "", "  \n", "plain", "<p>never closed", "<p>a<p>b</div></div>c", "<nav><div>x</div></nav>y", "</nav>z<nav>w", *[random_page(rng) for _ in range(150)]]
    df = spark.createDataFrame([(i % 100, h, "x", 1) for i, h in enumerate(html)], "page_id long, html string, row string, block int").repartition(4)
    got = sorted((r.page_id, r.row, r.block, r.kind, r.level, r.text) for r in pages.blocks(df).collect())
    by_page = {}
    for page, row, _, *rest in got:
        by_page.setdefault((page, row), []).append(tuple(rest))
    want = sorted((i % 100, read(h)) for i, h in enumerate(html) if h and read(h))
    assert sorted((page, rows) for (page, _), rows in by_page.items()) == want


def test_tokens_are_the_page_again(spark):
    rng = random.Random(8)
    html = [random_page(rng) + rng.choice(["", "<", "<p", "<!-- open", "<script>x"]) for _ in range(60)]
    rows = pages.tokens(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).collect()
    for i, h in enumerate(html):
        mine = sorted((r for r in rows if r.page_id == i), key=lambda r: r.place)
        assert "".join(r.token for r in mine) == h
        assert all(h[r.start : r.end] == r.token for r in mine)


def test_main_content_and_places(spark):
    prose = "A sentence that says something. " * 8
    body = f"<article><h1>Title &amp; more</h1><p>{prose}<p>é𝒳 {prose}</article>"
    menu = "<div>" + "".join(f"<a href='/{k}'>link {k}</a>" for k in range(40)) + "</div>"
    html = [f"<html><head><title>t</title></head><body>{menu}{body}<div>aside</div></body></html>", "no tags at all", menu, f"<body><div>{prose}", None, "<body></body>"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    rows = pages.main_content(df)
    text = {r.page_id: (r.n_blocks, r.text) for r in pages.page_text(rows).collect()}
    assert set(text) == {0, 1, 3}  # a menu is no content
    assert text[0] == (3, f"# Title & more\n\n{prose.strip()}\n\né𝒳 {prose.strip()}")
    assert text[1] == (1, "no tags at all")
    for r in rows.collect():
        assert text[r.page_id][1][r.start : r.end] == r.line
    head = pages.sections(rows, ["page_id"]).orderBy("page_id").collect()
    assert [(r.page_id, r.section, r.heading, r.level, r.parent, r.first_seq, r.last_seq) for r in head] == [(0, 1, "Title & more", 1, None, 1, 3), (1, 1, "正文", 1, None, 1, 1), (3, 1, "正文", 1, None, 1, 1)]


def test_text_blocks_and_sections(spark):
    text = "intro\n\n# One\n \n- a\n- b\n\n\n### Deep\n\nfirst *bold* [link](http://x)\n\n**Strong**\n\n|a|b|\n|-|-|\n|1|2|\n\n```\ncode\n```\n\n一、序号\n\n1. item"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n\n "), (1, text)], "doc_id long, text string")
    rows = pages.text_blocks(df, "doc_id", "text")
    got = rows.collect()
    assert {r.doc_id for r in got} == {1} and len({r.row for r in got}) == 2
    one = sorted((r for r in got if r.row == got[0].row), key=lambda r: r.seq)
    kinds = ["paragraph", "heading", "list", "heading", "paragraph", "heading", "table", "code", "heading", "list"]
    assert [(r.kind, r.level) for r in one] == list(zip(kinds, [None, 1, None, 3, None, 2, None, None, 2, None], strict=True))
    assert [r.text for r in one][4] == "first bold link"
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    assert [text[r.start : r.end] for r in one] == parts
    made = pages.sections(rows.filter(rows.row == one[0].row), ["row", "doc_id"]).orderBy("section").collect()
    assert [(r.heading, r.level, r.parent, r.first_seq, r.last_seq) for r in made] == [("One", 1, None, 2, 3), ("Deep", 3, 1, 4, 5), ("Strong", 2, 1, 6, 8), ("一、序号", 2, 1, 9, 10)]
