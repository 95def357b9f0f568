"""JSON of unknown shape as variants: redaction to a depth, and payloads of tags in any of their shapes.

Everything is one expression over the row: a value is branched on by its kind, and the entries of an object and the items of an
array go through the same transform, so a level of depth adds a fixed number of nodes to the plan.

Defined cases: null and malformed JSON, and objects that name a key twice, give null; object keys come out sorted, as variants keep them; numbers
are written as the variant writes them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of keys whose values go, keys of large texts, what stands for a value, a depth and a length, secrets in texts, buckets of tags.
SENSITIVE = [
    "api_key", "apikey",
    "api_secret", "secret",
    "password", "passwd",
    "bearer", "token",
    "private_key", "privatekey",
    "ragflow_api_key", "ragflow_endpoint",
    "litellm_api_key",
    "minio_access_key", "minio_secret_key",
    "authorization",
]
LARGE = ["raw_output", "raw_content", "content", "body_markdown", "ai_output", "ai_input", "messages"]
REDACTED, TRUNCATED = "***redacted***", "...[truncated]"
DEPTH, LONGEST = 8, 2000
INLINE_SECRET = r"(?i)(sk-[A-Za-z0-9_-]{20,}|ragflow-[A-Za-z0-9_-]{20,}|Bearer\s+[A-Za-z0-9._\-]{16,})"
BUCKETS = ["regions", "industries", "occupations", "majors", "abilities", "topics", "time_ranges"]


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID or the name of another type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _json(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _entries(value: Column, named: Column) -> Column:
    """array<struct<key, value>> of an object (by key) or an array (without keys); null for others."""
    pairs = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.when(named == "OBJECT", pairs).when(named == "ARRAY", items)


def scrub(text: Column) -> Column:
    """A text cut to its longest length, with the secrets inside masked."""
    cut = F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, LONGEST - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(text)
    return F.regexp_replace(cut, INLINE_SECRET, REDACTED)


def _clean(value: Column, depth: int) -> Column:
    mask = _json(F.lit(REDACTED))
    if depth >= DEPTH:
        return mask

    def of(e: Column) -> Column:
        key = F.lower(e["key"])
        omitted = _json(F.concat(F.lit("<"), F.length(_text(e["value"])).cast("string"), F.lit(" chars omitted>")))
        inner = F.when(key.rlike("|".join(SENSITIVE)), mask).when(key.isin(LARGE) & (kind(e["value"]) == "STRING"), omitted).otherwise(_clean(e["value"], depth + 1))
        return F.concat(F.when(e["key"].isNull(), "").otherwise(F.concat(_json(e["key"]), F.lit(":"))), inner)

    # Each part stands once: a second mention would double the plan at every level. The kind is bound, so it is worked out once.
    def by_kind(k: Column) -> Column:
        inside = F.array_join(F.transform(_entries(value, k), of), ",")
        whole = F.concat(F.when(k == "OBJECT", "{").otherwise("["), inside, F.when(k == "OBJECT", "}").otherwise("]"))
        return F.when(k.isin("OBJECT", "ARRAY"), whole).when(k == "STRING", _json(scrub(_text(value)))).otherwise(F.to_json(value))

    return F.get(F.transform(F.array(kind(value)), by_kind), F.lit(0))


def redact(json: Column) -> Column:
    """JSON with values of sensitive keys masked, large texts told by their length, other texts scrubbed, and whatever lies ``DEPTH`` levels down masked."""
    # Bound, so that a text is parsed once.
    return F.get(F.transform(F.array(F.try_parse_json(json)), lambda v: _clean(v, 0)), F.lit(0))


def tag_shape(json: Column) -> Column:
    """empty, flat, structured or unknown; null for malformed JSON."""
    v = F.try_parse_json(F.coalesce(json, F.lit("null")))
    items = F.try_variant_get(v, "$", "array<variant>")
    flat = F.when(F.size(items) == 0, "empty").when(F.forall(items, lambda x: kind(x) == "STRING"), "flat").otherwise("unknown")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    known = F.when(F.size(keys) == 0, "empty").when(F.exists(keys, lambda k: k.isin(BUCKETS)), "structured").otherwise("unknown")
    return F.when(v.isNull(), F.lit(None).cast("string")).when(kind(v) == "VOID", "empty").when(kind(v) == "ARRAY", flat).when(kind(v) == "OBJECT", known).otherwise("unknown")


def tag_bag(json: Column) -> Column:
    """map<bucket, array<variant>>, all buckets present; flat texts are topics, trimmed, each once; null for unknown and malformed payloads."""
    v, shape = F.try_parse_json(json), tag_shape(json)
    none = F.array().cast("array<variant>")
    texts = F.filter(F.array_distinct(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.regexp_replace(_text(x), r"^\s+|\s+$", ""))), lambda t: t != "")
    topics = F.transform(texts, lambda t: F.to_variant_object(F.struct(t.alias("value"))))
    bucket = lambda b: F.when(shape == "structured", F.coalesce(F.try_variant_get(v, f"$.{b}", "array<variant>"), none)).when((shape == "flat") & F.lit(b == "topics"), topics).otherwise(none)
    return F.when(shape.isin("empty", "flat", "structured"), F.create_map(*[c for b in BUCKETS for c in (F.lit(b), bucket(b))]))


def flat_tags(json: Column) -> Column:
    """The texts of a payload, bucket after bucket, each once: its items if they are texts, or their ``value``; anything else is passed over."""
    v = F.try_parse_json(json)
    said = lambda x: F.when(kind(x) == "STRING", _text(x)).when(kind(F.try_variant_get(x, "$.value", "variant")) == "STRING", F.try_variant_get(x, "$.value", "string"))
    items = F.flatten(F.array(*[F.coalesce(F.try_variant_get(v, f"$.{b}", "array<variant>"), F.array().cast("array<variant>")) for b in BUCKETS]))
    bucketed = F.filter(F.transform(items, lambda x: F.regexp_replace(said(x), r"^\s+|\s+$", "")), lambda t: t.isNotNull() & (t != ""))
    plain = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(kind(x) == "STRING", _text(x))), lambda t: t.isNotNull())
    return F.array_distinct(F.when(kind(v) == "ARRAY", plain).when(kind(v) == "OBJECT", bucketed).otherwise(F.array().cast("array<string>")))
