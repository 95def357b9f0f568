"""Quality rules, line first, with Spark expressions only.

Each line of a text is held against punctuation, navigation and boilerplate
rules; lines that fail are removed; a document is rejected when it has lost too
much of its text, or fails the base rules on its whole text.  No shuffle.

Defined cases: null text counts as empty; an empty text has no words and fails
the base rule; blank lines are neither failures nor text; repeated rows are
judged alike; further columns are kept by ``clean``, whatever their names; one that is
called like a column which ``clean`` adds (``q_kept``, ...) is replaced by it; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import SPACE_CHARS, words

SYMBOLS = "#*$%&|<>"
#: A line of running text ends in one of these.
ENDINGS = ".!?:;\"')]…»”’"
#: Marks between the entries of a navigation bar.
SEPARATORS = "|»›>·•"
BOILERPLATE = [
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "accept cookies",
    "sign up for our newsletter",
    "click here to subscribe",
    "lorem ipsum",
]
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document keeps at least this share of the letters of its words.
MIN_KEPT_PERCENT = 60


def without(text: Column, chars: str) -> Column:
    """The text without these characters; a chain of replacements scans bytes, which translate() doesn't."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def repeat_words(found: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """(hashes of the windows, from the words), (words covered by windows found twice or more, from the hashes)."""
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    grams = F.flatten(
        F.transform(
            F.array(hashes),
            lambda h: F.when(
                F.size(h) >= window, F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
            ).otherwise(F.array().cast("array<bigint>")),
        )
    )
    return grams, hashes


def covered(grams: Column, window: int = WINDOW) -> Column:
    """Words under the windows whose hash occurs twice or more; only texts with such a window are sorted."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twice(s: Column) -> Column:
        near = lambda k: F.coalesce(F.get(s, k)["g"], F.lit(None))
        at = F.transform(s, lambda x, k: F.when((x["g"] == near(k - 1)) | (x["g"] == near(k + 1)), x["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    whole = F.element_at(F.transform(F.transform(F.array(pairs), twice), total), 1)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), whole).otherwise(F.lit(0)).cast("long")


def has_any(text: Column, marks: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(x) for x in marks])


def marks_of(text: Column) -> Column:
    """What a text holds at all: rules whose marks it lacks needn't look at its lines."""
    return F.struct(has_any(text, SYMBOLS).alias("symbols"), text.contains("!").alias("shouts"), has_any(text, SEPARATORS).alias("separators"), has_any(F.lower(text), BOILERPLATE).alias("boilerplate"))


def line_fails(line: Column, holds: Column) -> Column:
    """Whether a line with words fails the punctuation, navigation or boilerplate rules; ``holds``: of its text, by ``marks_of``."""
    n_words = count_chars(F.trim(line), " ") + 1
    no_end = ~F.lit(ENDINGS).contains(F.substring(F.rtrim(F.replace(line, F.lit("\r"), F.lit(""))), -1, 1))
    shouts = holds["shouts"] & (2 * count_chars(line, "!") > n_words)
    symbols = holds["symbols"] & (10 * count_chars(line, SYMBOLS) > F.length(line))
    navigation = holds["separators"] & (count_chars(line, SEPARATORS) >= 3) & (3 * count_chars(line, SEPARATORS) >= n_words)
    boilerplate = holds["boilerplate"] & has_any(F.lower(line), BOILERPLATE)
    return no_end | shouts | symbols | navigation | boilerplate


def clean(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """The rows with: the cleaned text, counts of lines and characters, the base counts and the verdict."""
    p = prefix
    own = max(docs.columns, key=len) + "__"  # no column of docs starts so
    out = docs.withColumn(f"{own}text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(f"{own}holds", marks_of(F.col(f"{own}text")))
    out = out.withColumn(f"{own}words", words(F.col(f"{own}text")))
    out = out.withColumn(f"{own}lines", F.filter(F.split(f"{own}text", "\n"), lambda x: without(x, SPACE_CHARS) != ""))
    out = out.withColumn(f"{own}distinct", F.array_distinct(f"{own}lines"))
    out = out.withColumn(f"{own}grams", repeat_words(F.col(f"{own}words"))[0])
    # A line equal to an earlier one is boilerplate too: the first of each stays.
    out = out.withColumn(f"{own}kept_lines", F.filter(f"{own}distinct", lambda x: ~line_fails(x, F.col(f"{own}holds"))))
    out = out.withColumn(f"{p}clean_text", F.array_join(f"{own}kept_lines", "\n"))
    return (
        out.withColumn(f"{p}n_words", F.size(f"{own}words").cast("long"))
        .withColumn(f"{p}word_chars", F.length(without(F.col(f"{own}text"), SPACE_CHARS)).cast("long"))
        .withColumn(f"{p}n_symbols", count_chars(F.col(f"{own}text"), SYMBOLS).cast("long"))
        .withColumn(f"{p}n_dup_lines", (F.size(f"{own}lines") - F.size(f"{own}distinct")).cast("long"))
        .withColumn(f"{p}n_repeat_words", covered(F.col(f"{own}grams")))
        .withColumn(f"{p}kept_chars", F.length(without(F.col(f"{p}clean_text"), SPACE_CHARS)).cast("long"))
        .withColumn(f"{p}base_failed", (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words")))
        .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (100 * F.col(f"{p}kept_chars") >= MIN_KEPT_PERCENT * F.col(f"{p}word_chars")))
        .drop(f"{own}text", f"{own}holds", f"{own}words", f"{own}lines", f"{own}distinct", f"{own}grams", f"{own}kept_lines")
    )


def digest(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars", "kept"]
    return clean(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])
