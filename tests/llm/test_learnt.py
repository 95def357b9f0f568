"""Held-out accuracy, targets met, exact counts and round trips."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import chat_format, language_id, lm_score, mixing, quality_classifier, quality_rules, token_counts
from siltworks.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_prior string"
ODD = [(1, None, None, None, None, "p"), (2, "", "", "", 0, "p"), (3, " \n ", "en", "s", 3, "p"), (4, "word " * 30_000, "en", "s", 150_000, "p"), (4, "word " * 30_000, "en", "s", 150_000, "p"), (5, "héé 漢字 😀.", "xx", "t", 10, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, None), (4, None, 1), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")


def test_quality_scores_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality_classifier.quality(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(rows) > 40
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_quality_of_odd_rows(spark, odd, labels):
    got = quality_classifier.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.quality(odd.limit(0), labels).count() == 0
    assert all(r.score == pytest.approx(0.5) for r in quality_classifier.quality(odd, labels.limit(0)).collect())


def test_language_is_found_without_the_declared_one(spark):
    docs = table(spark, SF, "documents")
    languages, learnt = language_id.learn(language_id.labelled(docs))
    blind = language_id.of_documents(docs).withColumn("declared", F.lit(None).cast("string"))
    got = language_id.identify(blind, languages, learnt).join(docs.select("doc_id", F.col("lang").alias("truth"), "n_chars"), "doc_id").filter("n_chars > 200 and truth in ('en', 'de', 'fr', 'es')")
    n, right, kept = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("truth")), F.count_if("kept")).first()
    assert n > 300 and right / n > 0.97 and kept / n > 0.99


def test_language_of_odd_rows(spark, odd):
    languages, learnt = language_id.learn(language_id.labelled(odd))
    got = {r.doc_id: r for r in language_id.identify(language_id.of_documents(odd), languages, learnt).collect()}
    assert len(got) == 5 and not got[1].kept
    assert language_id.identify(language_id.of_documents(odd.limit(0)), *language_id.learn(language_id.labelled(odd.limit(0)))).count() == 0


def test_rates_meet_targets(spark):
    got = mixing.mix(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert got.filter("rate < 0 or rate is null").count() == 0
    for name, share in mixing.TARGETS.items():
        total = got.agg((F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{name}")) / F.sum("tokens")).alias("x")).first().x
        assert total == pytest.approx(share, abs=0.01)


@pytest.mark.parametrize("shares", [(0.95, 0.049, 0.001), (0.02, 0.97, 0.01), (0.90, 0.09, 0.01)])
def test_skewed_shares_meet_targets(spark, shares):
    rows = [(k, 1e6 * x, [float(i == k) for i in range(3)]) for k, x in enumerate(shares)]
    soft = spark.createDataFrame(rows, "doc_id long, tokens double, p array<double>")
    targets = list(mixing.TARGETS.values())
    got = {r.doc_id: r.rate for r in mixing.fit_rates(soft, targets).collect()}
    for k, x in enumerate(shares):
        assert got[k] * x == pytest.approx(targets[k], abs=mixing.TOLERANCE)


def test_posteriors_equal_brute_force(spark):
    docs, labels, domains = table(spark, SF, "documents"), table(spark, SF, "labels"), list(mixing.TARGETS)
    named = mixing.named_of(labels, domains)
    shaped = mixing.shapes(docs, mixing.markers(docs, named, domains)).cache()
    rows, domain = [r.asDict() for r in shaped.collect()], {r.doc_id: domains.index(r.domain) for r in named.collect()}
    features = [x for x in shaped.columns if x.startswith("f_")]
    known = [r for r in rows if r["doc_id"] in domain]
    sizes = np.bincount([domain[r["doc_id"]] for r in known], minlength=len(domains)) + 1.0
    counts = {f: Counter((r[f], domain[r["doc_id"]]) for r in known) for f in features}
    kinds = {f: len({r[f] for r in known}) + 1 for f in features}
    got = {r.doc_id: r.p for r in mixing.posteriors(shaped, named, domains).collect()}
    right = 0
    for r in rows:
        s = np.log(sizes / sizes.sum())
        for f in features:
            s = s + np.log([(counts[f][r[f], k] + 0.5) / (sizes[k] + 0.5 * kinds[f]) for k in range(len(domains))])
        p = np.exp(s - s.max())
        assert got[r["doc_id"]] == pytest.approx((p / p.sum()).tolist(), abs=1e-9)
        right += r["doc_id"] in domain and int(p.argmax()) == domain[r["doc_id"]]
    assert right > 0.8 * len(known)


def test_labels_of_several_domains_and_clashing_columns_mix(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", None, None), (2, "c", None, None)], "doc_id long, text string, lang string, source string").select("*", *[F.lit("mine").alias(x) for x in ("f_x", "tokens", "rate", "p", "domain")])
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 3 and all(r.rate >= 0 for r in got)


def test_targets_that_cannot_be_met_are_reported(spark):
    soft = spark.createDataFrame([(1, 10.0, [0.5, 0.5]), (2, 30.0, [0.4, 0.6])], "doc_id long, tokens double, p array<double>")
    with pytest.warns(UserWarning, match="can't be met"):
        got = mixing.fit_rates(soft, [0.9, 0.1])
    # All of document 1 and none of 2: 10 r (0.5, 0.5) / 40 is nearest to (0.9, 0.1) at r = 4.
    assert {r.doc_id: r.rate for r in got.collect()} == pytest.approx({1: 4.0, 2: 0.0}, abs=0.05)


def test_mixing_of_odd_rows(spark, odd, labels):
    assert mixing.mix(odd, labels).count() == len(ODD)
    assert mixing.mix(odd, labels.limit(0)).count() == len(ODD)
    assert mixing.mix(odd.limit(0), labels).count() == 0


def test_tokens_by_section_add_up(spark, odd):
    got = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    assert got[1].n_tokens == 0
    for r in got.values():
        assert r.n_tokens == r.outside + sum(s.n_tokens for s in r.sections)
    with open(token_counts.VOCABULARY, "rb") as f:
        encoder, sizes = token_counts._encoder(f.read())
    text = "a longer-word, é\n漢字 end\n"
    spans = [(0, 4), (4, 9), (10, 30)]
    docs = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in spans])], "doc_id long, text string, spans array<struct<start: long, end: long>>")
    at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    for rule in ("first", "largest"):
        row = token_counts.token_counts(docs, "spans", rule=rule).first()
        counts, outside, begin = [0] * len(spans), 0, 0
        for t in encoder.encode_ordinary(text):
            end = begin + int(sizes[t])
            held = [max(0, min(end, at[min(b, len(text))]) - max(begin, at[a])) for a, b in spans]
            if rule == "first":
                held = [int(at[a] <= begin < at[min(b, len(text))]) for a, b in spans]
            counts[int(np.argmax(held))] += max(held) > 0
            outside += max(held) == 0
            begin = end
        assert ([s.n_tokens for s in row.sections], row.outside) == (counts, outside)


def brute_backoff(rows):
    """(n_words, log_score) of each row, in order."""
    texts = [(t or "").split() for _, t in rows]
    grams = lambda w: Counter(tuple(w[j : j + k]) for k in (1, 2, 3) for j in range(len(w) - k + 1))
    whole, size = sum((grams(w) for w in texts), Counter()), sum(map(len, texts))
    for w in texts:
        own, rest = grams(w), max(1, size - len(w))
        c = lambda *g: whole[g] - own[g]  # noqa: B023, E731
        total = 0.0
        for j in range(len(w)):
            if j > 1 and c(*w[j - 2 : j + 1]) > 0:
                total += math.log(c(*w[j - 2 : j + 1]) / c(*w[j - 2 : j]))
            elif j > 0 and c(*w[j - 1 : j + 1]) > 0:
                total += math.log(c(*w[j - 1 : j + 1]) / c(w[j - 1])) + (math.log(0.4) if j > 1 else 0)
            else:
                total += math.log(max(c(w[j]), 0.5) / rest) + min(j, 2) * math.log(0.4)
        yield len(w), total


@pytest.mark.parametrize("letters,bucket_chars", [("abcdef", 200), ("abcdefghijklmnopqrstuvwxyz", 60), ("abcdef", 10**6)])
def test_backoff_scores_equal_brute_force(spark, letters, bucket_chars):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice((1, 1, 1, 2))))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(90, None), (91, " "), (92, "a"), (93, "a"), (None, "a b c"), (7, "a b c d")]
    # A very long text, and rows repeated with one doc_id.
    rows += [(94, " ".join(word() for _ in range(30_000))), (5, "b a b a"), (5, "b a b a"), (5, "c c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("mine").alias(x) for x in ("bucket", "ngram", "part", "words", "totals")])
    got = sorted((r.doc_id or -1, r.n_words, round(r.log_score, 5), round(r.mean_log_score, 6)) for r in lm_score.backoff_scores(docs, bucket_chars=bucket_chars).collect())
    said = [(i or -1, n, round(x, 5), round(x / max(n, 1), 6)) for (i, _), (n, x) in zip(rows, brute_backoff(rows), strict=True)]
    for a, b in zip(got, sorted(said), strict=True):
        assert a == pytest.approx(b, abs=2e-5)


def test_backoff_scores_of_an_empty_table(spark, odd):
    assert lm_score.backoff_scores(odd.limit(0)).count() == 0


def test_rules_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in quality_rules.digest(odd).collect()}
    assert got[1].base_failed and got[2].n_words == 0 and got[4].n_repeat_words == 30_000
    held = quality_rules.clean(odd)
    assert set(DOCS.split()[0:1]) <= set(held.columns) and held.count() == len(ODD)
    assert quality_rules.digest(odd.limit(0)).count() == 0
    names = ["q_text", "q_words", "q_lines", "q_n_dup", "q_kept_lines"]
    held = quality_rules.clean(odd.select("*", *[F.lit("mine").alias(x) for x in names]))
    assert all(held.filter(F.col(x) == "mine").count() == len(ODD) for x in names)


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<\\\\|", "", None, "plain\n<|im_end|>\n", "~1~0"]
    rows = [(1, t, role, x) for t, (role, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", "assistant"))] + [(2, None, None, None), (2, 0, "a\nb<|~", "x"), (3, 5, "user", "dup"), (3, 5, "user", "dup")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(turns, slice_turns=4)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("segments")).alias("loss"), "segments").collect()}
    for c, r in got.items():
        mine = sorted((-1 if t is None else t, role or "", x or "") for conv, t, role, x in rows if conv == c)
        assert [(t.role, t.text) for t in r.turns] == [m[1:] for m in mine]
        assert r.loss == "".join(x for _, role, x in mine if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat_format.format_conversations(turns.limit(0)).count() == 0
