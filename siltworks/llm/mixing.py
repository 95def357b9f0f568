"""Mixing to target weights by soft membership, with DataFrame operations only.

A labelled table says to which domain some documents belong.  A naive Bayes
classifier over a document's source, language and binned shape predicts the
posteriors of all; its counts are grouped aggregates of all labelled rows.  Words
that mark a domain are sought in a bounded sample of them (``MARKER_ROWS`` a
domain, those of least hash); how many a text holds is a feature.  Then
projected-gradient least squares fits a rate >= 0 for each document so that the
expected tokens of the domains, rate * tokens * posterior, come to ``targets`` of
all tokens; if they can't, a warning says so.  The gradient of a document's rate, in the
metric of its tokens, is its posteriors times the residuals.  All features are bins, so
documents of equal posteriors are summed up to one row first, and a step is one sum for
each domain over those rows.

Defined cases: null text has no tokens, and its rate moves with its posteriors but
weighs nothing; null source or language is a value of its own; documents without a
label are only scored; of repeated labels of one id the largest values decide;
values unseen among labels count as smoothed zeros; with no labels the posteriors
are the smoothed prior; repeated documents get the same rate.
"""

from __future__ import annotations

import warnings
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut

#: Domains of ``labels`` and the share of the tokens each is to have.
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}
#: Labelled rows of each domain that marker words are sought in, and marker words of each domain, at most.
MARKER_ROWS, MARKERS = 1000, 32
WORD = "[^\\x20\\x09-\\x0D]+"
STEPS, CUT_EVERY, TOLERANCE = 60, 6, 1e-4
#: Rates stand still when a step moves them by less than this (root of the mean square over tokens).
STILL = 1e-9


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def _bin(x: Column, base: float) -> Column:
    """Logarithmic bin of a number >= 0."""
    return F.floor(F.log(x + 1) / float(np.log(base))).cast("string")


def marked_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), "[\\x20\\x09-\\x0D.,;:!?]+"))


def markers(docs: DataFrame, named: DataFrame, domains: list[str], rows_each: int = MARKER_ROWS, words_each: int = MARKERS) -> list[list[str]]:
    """Words far more frequent in documents of each domain than in others of the sample, those that tell most of its rows apart first.

    They are what the classifier fits on the sample; every document is then scored by all of them.
    """
    parts = [named.filter(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_each) for d in domains]
    sample = reduce(DataFrame.unionAll, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(marked_words(F.col("text"))).alias("word"))
    each = cut(rows.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]))
    sizes = [r or 1 for r in sample.agg(*[F.count_if(F.col("domain") == d) for d in domains]).first()]
    out = []
    for k in range(len(domains)):
        mine, rest = F.col(f"n{k}"), sum((F.col(f"n{i}") for i in range(len(domains)) if i != k), F.lit(0))
        odds = F.log((mine + 0.5) / (sizes[k] + 1)) - F.log((rest + 0.5) / (sum(sizes) - sizes[k] + 1))
        best = each.filter((mine >= 3) & (odds > 1) & (F.length("word") > 1)).orderBy((odds * mine).desc(), "word").limit(words_each)
        out.append([r["word"] for r in best.select("word").collect()])
    return out


def shapes(docs: DataFrame, marks: list[list[str]]) -> DataFrame:
    """doc_id, tokens and the binned features."""
    none = F.lit("\0null")
    text = F.coalesce("text", F.lit(""))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", none).alias("f_source"), F.coalesce("lang", none).alias("f_lang"), text.alias("t"))
    some = some.withColumn("tokens", F.regexp_count("t", F.lit(WORD)).cast("double")).withColumn("chars", F.length("t")).withColumn("found", marked_words(F.col("t")))
    held = lambda words: F.size(F.array_intersect("found", F.array(*[F.lit(w) for w in words]).cast("array<string>"))).cast("string")
    per_mille = lambda pattern: 1000 * F.regexp_count(F.col("t"), F.lit(pattern)) / (F.col("chars") + 1)
    return some.select(
        "doc_id",
        "tokens",
        "f_source",
        "f_lang",
        _bin(F.col("tokens"), 2).alias("f_length"),
        _bin(per_mille("[#*$%&|<>!]"), 3).alias("f_symbols"),
        _bin(per_mille("[A-Z]"), 3).alias("f_upper"),
        _bin(per_mille("\n"), 3).alias("f_lines"),
        F.round(F.col("chars") / (F.col("tokens") + 1)).cast("int").cast("string").alias("f_word"),
        *[held(words).alias(f"f_mark_{k}") for k, words in enumerate(marks)],
    )


def named_of(labels: DataFrame, domains: list[str]) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain_of().alias("domain")).filter(F.col("domain").isin(domains))


def posteriors(shaped: DataFrame, named: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, tokens, p (array by domain)."""
    known = cut(shaped.join(named, "doc_id"))
    each = [F.sum((F.col("domain") == d).cast("double")) for d in domains]
    sizes = np.array([x or 0.0 for x in known.agg(*each).first()]) + 1.0
    score = F.array(*[F.lit(float(x)) for x in np.log(sizes / sizes.sum())])
    out = shaped
    for f in [x for x in shaped.columns if x.startswith("f_")]:
        counts = known.groupBy(f).agg(*[c.alias(f"n{k}") for k, c in enumerate(each)])
        values = counts.count() + 1
        logs = lambda n: F.array(*[F.log((n(k) + 0.5) / F.lit(float(sizes[k] + 0.5 * values))) for k in range(len(domains))])
        out = out.join(counts.select(f, logs(lambda k: F.col(f"n{k}")).alias(f"l_{f}")), f, "left")
        score = F.zip_with(score, F.coalesce(F.col(f"l_{f}"), logs(lambda k: F.lit(0.0))), lambda a, b: a + b)
    out = out.select("doc_id", "tokens", score.alias("s")).withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    return out.select("doc_id", "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def fit_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``rate``: projected gradient from 1 on the squared misses of the targets.

    Misses are weighed by the inverse of the posteriors' second moments, so a rare domain
    moves as fast as a frequent one.  Steps go on until all misses are below ``tolerance``,
    or until rates stand still at a larger one, that is, targets can't be met; then ``steps``
    steps on plain squares are taken from 1, and a warning names the misses.  Momentum starts anew after ``steps`` steps at the latest.
    """
    n, each = len(targets), soft
    # Documents of equal posteriors have equal gradients, so each lot of them is one row of the fit.
    soft = cut(soft.groupBy("p").agg(F.sum("tokens").alias("tokens")))
    p = lambda k: F.get("p", F.lit(k))
    total = soft.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * p(k)).alias(f"t{k}") for k in range(n)], *[F.sum(F.col("tokens") * p(i) * p(k)).alias(f"g{i}_{k}") for i in range(n) for k in range(n)]).first()
    if not total["t"]:
        return each.withColumn("rate", F.lit(1.0))

    def spread(rates: DataFrame) -> DataFrame:
        return each.join(rates.select("p", F.col("at").alias("rate")), "p").select(*each.columns, "rate")

    gram = np.array([[total[f"g{i}_{k}"] for k in range(n)] for i in range(n)]) / total["t"]
    inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    table = soft.withColumn("rate", F.lit(1.0)).withColumn("before", F.lit(1.0)).withColumn("moved", F.lit(1.0))
    last, run, plain = np.inf, 0, False
    for step in count():
        # Nesterov's point between the last two rates; the gradient is taken there.
        ahead = F.col("rate") + run / (run + 3) * (F.col("rate") - F.col("before"))
        table = table.withColumn("at", F.greatest(F.lit(0.0), ahead))
        *sums, moved = table.agg(*[F.sum(F.col("at") * F.col("tokens") * p(k)) for k in range(n)], F.sum(F.col("tokens") * F.col("moved"))).first()
        miss = np.array(sums) / total["t"] - np.array(targets)
        if np.abs(miss).max() < tolerance:
            return spread(table)
        if not plain and moved / total["t"] < STILL**2:
            plain, end, last, run, inverse = True, step + steps, np.inf, 0, np.eye(n) / max(np.linalg.eigvalsh(gram)[-1], 1e-9)
            table = soft.withColumn("at", F.lit(1.0)).withColumn("rate", F.lit(1.0))
            miss = np.array([total[f"t{k}"] for k in range(n)]) / total["t"] - np.array(targets)
        if plain and step == end:
            warnings.warn(f"targets can't be met; misses {miss.round(6).tolist()}", stacklevel=2)
            return spread(table)
        far = float(miss @ inverse @ miss)
        run, last = (0 if far > last or run == steps else run + 1), far
        slope = sum((p(k) * float(x) for k, x in enumerate(inverse @ miss)), F.lit(0.0))
        then = F.greatest(F.lit(0.0), F.col("at") - slope)
        table = table.select(*soft.columns, then.alias("rate"), F.col("rate").alias("before"), F.pow(then - F.col("at"), F.lit(2.0)).alias("moved"))
        if step % CUT_EVERY == CUT_EVERY - 1:
            table = cut(table)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, marker_rows: int = MARKER_ROWS, marker_words: int = MARKERS) -> DataFrame:
    """doc_id, tokens, p_<domain> for each, rate."""
    targets = targets or TARGETS
    domains = list(targets)
    named = named_of(labels, domains)
    soft = cut(posteriors(cut(shapes(docs, markers(docs, named, domains, marker_rows, marker_words))), named, domains))
    fitted = fit_rates(soft, [targets[d] for d in domains])
    return fitted.select("doc_id", F.col("tokens").cast("long").alias("tokens"), *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], "rate")
