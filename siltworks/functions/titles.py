"""Titles against queries, and questions with answers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions.clean import bigrams

#: What a query's key is without (a backslash and a small s among it), a title's ordinal, and what only decorates a title.
NOISE = r"[？?，,。.！!：:；;、\\s]|是什么|有哪些|有哪几种|什么是|怎么|如何|流程|步骤|介绍|请问"
ORDINAL = r"^(?:第[一二三四五六七八九十百0-9]+[章节部分]|[一二三四五六七八九十0-9]+[、.．])"
DECORATION = "的|相关|有关|方面|常见|基本|主要|常用|简介|概述|认知"
#: A question and its answer.
QA = [r"(?s)[问Q][:：]\s*(.+?)\n[答A][:：]\s*(.+?)(?=\n[问Q][:：]|\z)", r"(?s)(?:问题|Question)\s*[0-9]*[:：]\s*(.+?)\n(?:答案|Answer)\s*[0-9]*[:：]\s*(.+?)(?=\n(?:问题|Question)|\z)"]


def query_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, ""))


def title_key(text: Column) -> Column:
    return F.regexp_replace(query_key(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), ORDINAL, "")), DECORATION, "")


def title_score(query: Column, title: Column) -> Column:
    """10,000 and the length for a title that holds the query, 8,000 for one it holds, 9,000 and 8,500 by their keys,
    else the bigrams they share from three on; ``query`` is a query's key."""
    plain = query_key(title)
    held = settling_score(query, title_key(query), plain, title_key(title))
    both = F.size(F.array_intersect(bigrams(query), bigrams(plain)))
    return F.when((plain == "") | (held > 0), held).otherwise(F.when(both >= 3, both).otherwise(0))


def settling_score(query: Column, compact_q: Column, plain: Column, compact_t: Column) -> Column:
    """``title_score`` without shared bigrams, from a query's key, the title key of that, and both keys of a title; for those who score a title with many queries."""
    return (
        F.when(plain == "", 0)
        .when(plain.contains(query), 10_000 + F.length(query))
        .when((F.length(plain) >= 4) & query.contains(plain), 8_000 + F.length(plain))
        .when((F.length(compact_q) >= 3) & compact_t.contains(compact_q), 9_000 + F.length(compact_q))
        .when((F.length(compact_t) >= 4) & compact_q.contains(compact_t), 8_500 + F.length(compact_t))
        .otherwise(0)
    )


def section_relevance(query: Column, title: Column) -> Column:
    """By keys: 0 for a query under 3 or a title under 2 characters, 1 if one holds the other, else 0.7 of the query's bigrams and 0.3 of the title's."""
    q, t = title_key(query), title_key(title)
    both = F.size(F.array_intersect(bigrams(q), bigrams(t)))
    share = 0.7 * both / F.greatest(F.size(bigrams(q)), F.lit(1)) + 0.3 * both / F.greatest(F.size(bigrams(t)), F.lit(1))
    return F.when((F.length(q) < 3) | (F.length(t) < 2), 0.0).when(t.contains(q) | q.contains(t), 1.0).otherwise(share)


def qa_pairs(text: Column, question: int = 5, answer: int = 10) -> Column:
    """array<struct<question, answer>> of the pairs whose sides have so many characters, by the first pattern that gives any."""

    def by(pattern: str) -> Column:
        side = lambda k: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(k))
        pairs = F.zip_with(side(1), side(2), lambda q, a: F.struct(F.trim(q).alias("question"), F.trim(a).alias("answer")))
        return F.filter(pairs, lambda p: (F.length(p["question"]) >= question) & (F.length(p["answer"]) >= answer))

    return F.when(F.size(by(QA[0])) > 0, by(QA[0])).otherwise(by(QA[1]))
