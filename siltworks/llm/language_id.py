"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from hashed word and character n-grams (naive Bayes, learnt
on at most ``max_rows`` labelled rows a language, those of least hash), tempered
to ``TEXT_WEIGHT`` n-grams' worth.  What text alone says is then counted over all
rows, by grouped aggregation: how often each declared code and each address suffix
comes with each language, and how languages are spread over hosts.  A host's prior
is smoothed towards its domain's, that towards the whole table's, each with
``PRIOR`` rows' worth.  The posterior multiplies the four.

Host tables grow with the input and are joined, not collected; a host with very
many rows is combined before the shuffle, and its join side is one row.

Defined cases: null or blank text gives no text evidence; null or blank declared
code, suffix or host gives none of that kind; a row with no evidence gets the
whole table's prior and is rejected; repeated rows are judged alike; with no
labelled rows the language is null and the row is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut
from siltworks.llm.features import ngrams

BUCKETS, SIZES = 1 << 16, (2, 3)
#: Labelled rows of each language to learn from, at most.
MAX_ROWS = 500
#: Most languages that labels may name; more is an error, not a cap.
MAX_LANGUAGES = 200
TEXT_WEIGHT, PRIOR, SMOOTH = 30.0, 20.0, 0.5
MIN_POSTERIOR = 0.5


def _counts(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([index[x] for x in batch.column("label").to_pylist()], np.int64)
            for i, j, bucket, row in ngrams(batch, SIZES, BUCKETS, (1,), lower=True):
                total += np.bincount(label[i:j][row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        where, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(bucket), pa.array(total[where, bucket])], names=["language", "bucket", "n"])

    return run


def _likelihoods(table: np.ndarray):
    n = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros((n, batch.num_rows)), np.zeros(batch.num_rows)
            for i, j, bucket, row in ngrams(batch, SIZES, BUCKETS, (1,), lower=True):
                count[i:j] = np.bincount(row, minlength=j - i)
                for k in range(n):
                    total[k, i:j] = np.bincount(row, table[k][bucket], j - i)
            scale = np.minimum(count, TEXT_WEIGHT) / np.maximum(count, 1)
            flat = pa.array((total * scale).T.reshape(-1))
            ll = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), flat)
            others = [batch.column(x) for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(count.astype(np.int64)), ll], names=[*[x for x in batch.schema.names if x != "text"], "n_grams", "ll"])

    return run


def learn(labelled: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probability of each bucket, from (doc_id, text, label)."""
    rows = labelled.filter("label is not null and trim(label) != '' and text is not null")
    languages = sorted(r["label"] for r in rows.select("label").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"labels name more than {MAX_LANGUAGES} languages")
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    # Ids alone decide the sample, so texts aren't sorted.
    least = [rows.filter(F.col("label") == x).select("label", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for x in languages]
    sample = least[0]
    for more in least[1:]:
        sample = sample.unionAll(more)
    texts = rows.join(F.broadcast(sample.distinct()), ["label", "doc_id"]).select("label", "text")
    counts = texts.mapInArrow(_counts(languages), "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), BUCKETS), SMOOTH)
    table[counts.column("language").to_numpy(), counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _softmax(scores: Column) -> Column:
    weights = F.transform(F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)))
    return F.element_at(weights, 1)


def _sums(post: str, n: int) -> list[Column]:
    return [F.sum(F.get(post, F.lit(k))).alias(f"s{k}") for k in range(n)]


def _packed(n: int) -> Column:
    return F.array(*[F.col(f"s{k}") for k in range(n)])


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """Rows (key columns, text, declared, suffix, domain, host) to the keys, lang, posterior, text_lang, kept."""
    n = len(languages)
    evidence = ["declared", "suffix", "domain", "host"]
    keys = [x for x in rows.columns if x not in ("text", *evidence)]
    clean = rows.select(*keys, "text", *[F.when(F.trim(F.col(x)) != "", F.lower(F.trim(F.col(x)))).alias(x) for x in evidence])
    if n == 0:
        none = F.lit(None).cast("string")
        return clean.select(*keys, none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), F.lit(False).alias("kept"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields if f.name != "text"], "n_grams long, ll array<double>"])
    scored = clean.mapInArrow(_likelihoods(table), schema)
    scored = cut(scored.withColumn("post", F.when(F.col("n_grams") > 0, _softmax(F.col("ll")))))

    whole = scored.agg(*_sums("post", n)).first()
    counts = np.array([(whole[k] or 0.0) + SMOOTH for k in range(n)])
    prior = F.array(*[F.lit(float(x)) for x in counts / counts.sum()])
    share = lambda s, base: F.zip_with(s, base, lambda x, p: (x + PRIOR * p) / (F.aggregate(s, F.lit(0.0), lambda a, b: a + b) + PRIOR))

    domains = scored.filter("domain is not null and post is not null").groupBy("domain").agg(*_sums("post", n)).select("domain", share(_packed(n), prior).alias("domain_prior"))
    hosts = scored.filter("host is not null and post is not null").groupBy("host", "domain").agg(*_sums("post", n)).select("host", "domain", _packed(n).alias("s"))
    hosts = hosts.join(domains, "domain", "left").select("host", F.col("domain").alias("host_domain"), share(F.col("s"), F.coalesce("domain_prior", prior)).alias("host_prior"))

    def likelihood(name: str) -> DataFrame:
        """P(value | language), smoothed by one row spread over the values seen."""
        by = scored.filter(F.col(name).isNotNull() & F.col("post").isNotNull()).groupBy(name).agg(*_sums("post", n))
        total = by.agg(F.count("*").alias("values"), *[F.sum(f"s{k}").alias(f"t{k}") for k in range(n)])
        return by.crossJoin(F.broadcast(total)).select(name, F.array(*[F.log((F.col(f"s{k}") + SMOOTH) / (F.col(f"t{k}") + SMOOTH * (F.col("values") + 1))) for k in range(n)]).alias(f"ll_{name}"))

    fused = scored.join(hosts, (scored["host"] == hosts["host"]) & scored["domain"].eqNullSafe(hosts["host_domain"]), "left").drop(hosts["host"])
    fused = fused.join(domains, "domain", "left").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    base = F.coalesce("host_prior", "domain_prior", prior)
    total = add(add(add(F.transform(base, lambda x: F.log(x)), F.col("ll")), F.coalesce("ll_declared", zero)), F.coalesce("ll_suffix", zero))
    fused = fused.withColumn("fused", _softmax(total)).withColumn("posterior", F.array_max("fused"))
    names = F.array(*[F.lit(x) for x in languages])
    pick = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    known = (F.col("n_grams") > 0) | F.col("ll_declared").isNotNull() | F.col("ll_suffix").isNotNull() | F.col("host_prior").isNotNull()
    return fused.select(*keys, pick(F.col("fused")).alias("lang"), "posterior", pick(F.col("post")).alias("text_lang"), (known & (F.col("posterior") >= min_posterior)).alias("kept"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: their source stands for the host, their column ``lang`` is what they declare."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of raw pages; doc_id is -1 - page_id, which no document has."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host)
    return pages.select((-1 - F.col("page_id").cast("long")).alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), declared.alias("declared"), F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("suffix"), domain.alias("domain"), host.alias("host"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("label"))
