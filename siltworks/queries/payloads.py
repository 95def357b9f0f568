"""JSON of unknown shape, planted around the properties of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import payloads
from siltworks.operators.ordered import parts
from siltworks.registry import query
from siltworks.sources.readers import table

_SECRET = "sk-" + "ab1" * 8
#: Every 50th text breaks off; the chain under ``deep`` has as many levels as the id's last digit.
_planted = f"""CASE WHEN event_id % 50 = 7 THEN '{{"a": ' ELSE '{{"User_Token": {{"id": "' || user_id || '"}}, "content": "' || repeat(event_type, CAST(event_id % 5 AS INT)) || '", "meta": {{"items": [' || props || ', {{"note": "key {_SECRET} ' || event_type || '"}}, null], "deep": '
 || repeat('{{"v": ', CAST(event_id % 10 AS INT)) || '"x' || event_id || '"' || repeat('}}', CAST(event_id % 10 AS INT)) || '}}, "n": ' || event_id || '}}' END"""
#: What lies eight levels down is six below ``deep``.
_expected = f"""CASE WHEN event_id % 50 <> 7 THEN '{{"User_Token":"{payloads.REDACTED}","content":"<' || length(json_extract_string(j, '$.content')) || ' chars omitted>","meta":{{"deep":'
 || repeat('{{"v":', least(event_id % 10, 6)::INT) || CASE WHEN event_id % 10 >= 6 THEN '"{payloads.REDACTED}"' ELSE '"x' || event_id || '"' END || repeat('}}', least(event_id % 10, 6)::INT)
 || ',"items":[' || replace(props, ' ', '') || ',{{"note":"' || regexp_replace(json_extract_string(j, '$.meta.items[1].note'), '{payloads.INLINE_SECRET}', '{payloads.REDACTED}', 'g') || '"}},null]}},"n":' || (json_extract(j, '$.n'))::VARCHAR || '}}' END"""


#: Rows that one task redacts: the table's file is small for the work on a row, so its splits are fewer than the cores.
REDACTED_ROWS = 25_000


@query(f"""WITH p AS (SELECT event_id, event_type, props, {_planted} AS t FROM events), q AS (SELECT *, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM p), r AS (SELECT event_id, {_expected} AS said FROM q)
SELECT event_id, sha256(said) AS redacted, length(said) AS n_chars, len(string_split(said, '{payloads.REDACTED}')) - 1 AS n_masked FROM r""")
def r9_22_redacted_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    rows = events.repartition(parts(events.count(), each=REDACTED_ROWS), "event_id").select("event_id", payloads.redact(F.expr(_planted)).alias("said"))
    masked = F.when(F.col("said").isNotNull(), F.size(F.split("said", r"\Q" + payloads.REDACTED + r"\E")) - 1).cast("long")
    return rows.select("event_id", F.sha2("said", 256).alias("redacted"), F.length("said").cast("long").alias("n_chars"), masked.alias("n_masked"))


_tags = """CASE event_id % 7 WHEN 0 THEN '["' || event_type || ' ", "b' || user_id % 3 || '", "' || event_type || '"]' WHEN 1 THEN '{"topics": [{"value": "' || event_type || '"}, 4], "regions": ["r' || user_id % 3 || '", {"value": " ' || event_type || '"}], "x": 1}'
 WHEN 2 THEN '{}' WHEN 3 THEN props WHEN 4 THEN '[1, "a"]' WHEN 5 THEN '[' || props END"""
_buckets = " UNION ALL ".join(f"SELECT event_id, {k} AS b, unnest(CASE WHEN json_type(j, '$.{b}') = 'ARRAY' THEN json_extract(j, '$.{b}[*]') ELSE [] END) AS x, generate_subscripts(CASE WHEN json_type(j, '$.{b}') = 'ARRAY' THEN json_extract(j, '$.{b}[*]') ELSE [] END, 1) AS i FROM q WHERE json_type(j) = 'OBJECT'" for k, b in enumerate(payloads.BUCKETS))
_known = " OR ".join(f"json_exists(j, '$.{b}')" for b in payloads.BUCKETS)


@query(rf"""WITH p AS (SELECT event_id, {_tags} AS t FROM events), q AS (SELECT event_id, t, CASE WHEN t IS NULL THEN 'null'::JSON WHEN json_valid(t) THEN t::JSON END AS j FROM p),
s AS (SELECT *, CASE WHEN j IS NULL THEN NULL WHEN json_type(j) = 'NULL' THEN 'empty' WHEN json_type(j) = 'ARRAY' THEN CASE WHEN json_array_length(j) = 0 THEN 'empty' WHEN len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN 'flat' ELSE 'unknown' END
  WHEN json_type(j) = 'OBJECT' THEN CASE WHEN len(json_keys(j)) = 0 THEN 'empty' WHEN {_known} THEN 'structured' ELSE 'unknown' END ELSE 'unknown' END AS shape FROM q),
b AS ({_buckets} UNION ALL SELECT event_id, 0, unnest(json_extract(j, '$[*]')), generate_subscripts(json_extract(j, '$[*]'), 1) FROM q WHERE json_type(j) = 'ARRAY'),
v AS (SELECT b.event_id, b.b, i, CASE WHEN json_type(x) = 'VARCHAR' THEN CASE WHEN json_type(j) = 'ARRAY' THEN x->>'$' ELSE trim(x->>'$') END WHEN json_type(j) = 'OBJECT' AND json_type(x, '$.value') = 'VARCHAR' THEN trim(x->>'$.value') END AS t FROM b JOIN q ON q.event_id = b.event_id),
f AS (SELECT event_id, t, min(b * 1000 + i) AS o FROM v WHERE t IS NOT NULL AND t <> '' GROUP BY ALL), g AS (SELECT event_id, string_agg(t, '|' ORDER BY o) AS flat FROM f GROUP BY event_id),
n AS (SELECT event_id, count(DISTINCT trim(t)) AS n FROM v GROUP BY event_id)
SELECT s.event_id, shape, CASE WHEN shape = 'flat' THEN n.n WHEN shape = 'structured' THEN json_array_length(j, '$.topics') WHEN shape = 'empty' THEN 0 END::BIGINT AS n_topics, coalesce(flat, '') AS flat FROM s LEFT JOIN g ON g.event_id = s.event_id LEFT JOIN n ON n.event_id = s.event_id""")
def r15_16_tag_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.expr(_tags).alias("t"))
    t = F.col("t")
    topics = F.size(F.try_element_at(payloads.tag_bag(t), F.lit("topics")))
    return rows.select("event_id", payloads.tag_shape(t).alias("shape"), F.when(payloads.tag_shape(t).isin("flat", "structured", "empty"), topics).cast("long").alias("n_topics"), F.array_join(payloads.flat_tags(t), "|").alias("flat"))
