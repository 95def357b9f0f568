"""Coercion, placeholders, keys and gates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that stand for nothing.
PLACEHOLDERS = ["……", "...", "—", "-", "无", "n/a", "na", "null", "none"]


def is_blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def is_placeholder(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(PLACEHOLDERS), F.lit(False))


def to_int(value: Column) -> Column:
    """Text of a number, cut to its whole part; null if it is none."""
    return F.trim(value).try_cast("double").cast("long")


def int_in(value: Column) -> Column:
    """The first whole number in a text."""
    return F.nullif(F.regexp_extract(value, r"-?[0-9]+", 0), F.lit("")).try_cast("long")


def year_in(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(?:19|20)[0-9]{2}", 0), F.lit("")).try_cast("int")


def date_in(value: Column) -> Column:
    """The first date as yyyy-mm-dd; null if there is none."""
    pattern = r"(20[0-9]{2})[年\-/.]([0-9]{1,2})[月\-/.]([0-9]{1,2})"
    part = lambda k: F.regexp_extract(value, pattern, k)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased parts, joined by bars; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]), 256)


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment; an empty path is /."""
    u = F.regexp_replace(url, r"#.*$", "")
    head, path = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)), F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(head, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_is_safe(url: Column, http: bool = False) -> Column:
    """https (or http if allowed), a named host that isn't localhost or a bare address."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    h = host(url)
    return scheme.isin(["https", "http"] if http else ["https"]) & (h != "") & (h != "localhost") & ~h.rlike(r"^[0-9.]+$") & ~h.startswith("[")


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts and styles go with what they hold, other tags become spaces, white space is folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def mask_secrets(text: Column, most: int = 2000) -> Column:
    """The first ``most`` characters, with keys and bearer tokens masked."""
    return F.regexp_replace(F.regexp_replace(F.substring(text, 1, most), r"sk-[A-Za-z0-9_-]+", "sk-***"), r"Bearer +[A-Za-z0-9._-]+", "Bearer ***")


def scrub_secrets(text: Column, most: int | None = None) -> Column:
    """The whole text with inline keys and bearer tokens redacted; ``most`` cuts audit strings first, as the reference does."""
    if most is not None:
        text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 14), F.lit("...[truncated]"))).otherwise(text)
    return F.regexp_replace(text, r"(?iU)(sk-[A-Za-z0-9_-]{20,}|ragflow-[A-Za-z0-9_-]{20,}|Bearer\s+[A-Za-z0-9._\-]{16,})", "***redacted***")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(F.length(text) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: text.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def title_relevance(query: Column, title: Column) -> Column:
    """1 if one holds the other, else 0.7 of the query's bigrams covered and 0.3 of the title's."""
    q, t = bigrams(query), bigrams(title)
    both = F.size(F.array_intersect(q, t))
    return F.when(title.contains(query) | query.contains(title), 1.0).when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(0.7 * both / F.size(q) + 0.3 * both / F.size(t))


def fake_embedding(text: Column, size: int) -> Column:
    """A vector of a text's digest, for tests of what needs vectors."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.round(F.conv(F.substr(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255, 6))
