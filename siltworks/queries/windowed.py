"""Latest rows, winners, runs, neighbours, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators import ordered
from siltworks.operators.packing import body_units, pack
from siltworks.operators.ranking import combine, first_wins, merge_hits
from siltworks.operators.vectors import cosine, doubles, search
from siltworks.operators.windows import first_by, first_seen, latest, neighbours, runs
from siltworks.registry import query
from siltworks.sources.readers import replace_partition, table


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def r5_01_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT * FROM (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'error'")
def r5_02_latest_then_filter(spark: SparkSession, d: str) -> DataFrame:
    return r5_01_latest_per_key(spark, d).filter("event_type = 'error'")


@query("SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber) = 1")
def r5_03_duplicate_winner(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return first_by(rows, ["l_partkey", "l_suppkey"], F.col("l_shipdate").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_orderkey")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1")
def r5_04_first_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp"))
    return rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[ \\t\\n\\r]+', '', 'g') AS t FROM conversations)
SELECT conv_id, turn FROM x WHERE t IS NULL OR length(t) < 40 UNION ALL
SELECT conv_id, turn FROM (SELECT * FROM x WHERE length(t) >= 40) QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) = 1""")
def r5_06_first_text(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("text", r"[ \t\n\r]+", "")
    key = F.when(F.length(bare) >= 40, F.struct("conv_id", bare.alias("t")))
    return first_seen(table(spark, d, "conversations").select("conv_id", "turn", "text"), key, "turn").select("conv_id", "turn")


@query("""WITH r AS (SELECT p_partkey AS id, 1.0 / (60 + row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)) AS s FROM part WHERE p_size > 25
UNION ALL SELECT p_partkey, 1.0 / (60 + row_number() OVER (ORDER BY p_size DESC, p_partkey)) FROM part WHERE p_retailprice > 905)
SELECT id, round(sum(s::DOUBLE), 9) AS score FROM r GROUP BY 1""")
def r5_07_reciprocal_ranks(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    hits = part.filter("p_size > 25").select(F.lit("price").alias("bucket"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    hits = hits.unionByName(part.filter("p_retailprice > 905").select(F.lit("size").alias("bucket"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score")))
    return combine(hits, "RRF", ["price", "size"]).select("id", F.round("score", 9).alias("score"))


@query("""SELECT a.conv_id, a.turn, count(*) AS n, min(b.turn) AS first_turn, max(b.turn) AS last_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 GROUP BY 1, 2""")
def r5_08_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    near = rows.withColumn("near", neighbours(rows, ["conv_id"], "turn", F.col("role"), 1)).dropDuplicates(["conv_id", "turn"])
    return near.select("conv_id", "turn", F.size("near").cast("long").alias("n"), F.get("near", F.lit(0))["i"].alias("first_turn"), F.element_at("near", -1)["i"].alias("last_turn"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def r5_09_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("heading"))


@query("""WITH x AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM y GROUP BY 1, 2""")
def r5_10_runs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = runs(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], F.col("event_type") == F.lag("event_type").over(w))
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island, event_type FROM events)
SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM x GROUP BY event_type, island HAVING count(*) >= 3""")
def r5_12_long_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_type", "event_id")
    x = ordered.runs(events, ["event_type"], [F.col("event_id").asc()], lambda was: F.col("event_id") == was["event_id"] + 1)
    return x.groupBy("event_type", "run").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).filter("n >= 3").drop("run")


def packed_sql(rows: str, keys: str, most: int, rows_most: int, overlap: int) -> str:
    """Common table expressions that pack ``rows`` (keys, i, n), unit by unit, in ``pu``: the keys, unit, n_rows, total, first, last."""
    q, same = keys.split(", "), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in q)
    return f"""pq AS (SELECT {keys}, i, coalesce(n, 0) AS n, row_number() OVER w - 1 AS pos, sum(coalesce(n, 0)) OVER w AS upto FROM ({rows}) WINDOW w AS (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING)),
pb AS (SELECT {a_keys}, a.pos, greatest(a.pos - {overlap}, 0) AS start, b.upto - b.n AS base, b.i AS first FROM pq a JOIN pq b ON {same("a", "b")} AND b.pos = greatest(a.pos - {overlap}, 0)),
pn AS (SELECT {a_keys}, a.pos, a.start, a.base, a.first, coalesce(min(CASE WHEN b.upto - a.base > {most} OR b.pos - a.start >= {rows_most} THEN b.pos END), max(b.pos) + 1, a.pos + 1) AS nxt
  FROM pb a LEFT JOIN pq b ON {same("a", "b")} AND b.pos > a.pos AND b.pos <= a.pos + {rows_most} GROUP BY {a_keys}, a.pos, a.start, a.base, a.first),
pw AS (SELECT {keys}, 0::BIGINT AS unit, pos, start, base, first, nxt FROM pn WHERE pos = 0 UNION ALL
  SELECT {a_keys}, u.unit + 1, a.pos, a.start, a.base, a.first, a.nxt FROM pw u JOIN pn a ON {same("u", "a")} AND a.pos = u.nxt),
pu AS (SELECT {", ".join(f"u.{k}" for k in q)}, u.unit, (u.nxt - u.start)::BIGINT AS n_rows, (b.upto - u.base)::BIGINT AS total, u.first, b.i AS last FROM pw u JOIN pq b ON {same("u", "b")} AND b.pos = u.nxt - 1)"""


@query(f"""WITH RECURSIVE {packed_sql("SELECT conv_id, turn AS i, length(text) AS n FROM conversations", "conv_id", 1500, 6, 1)} SELECT conv_id, unit, n_rows, total, first, last FROM pu""")
def r5_13_packed_units(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return pack(turns, "conv_id", "turn", "size", most=1500, rows=6, overlap=1)


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey) > 1 THEN 'deprecated' ELSE o_orderstatus END AS status FROM orders""")
def r5_15_deprecate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy(rank, F.col("o_orderdate").desc_nulls_last(), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.when(F.row_number().over(w) > 1, "deprecated").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 40")
def r6_03_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_first(), "c_custkey").offset(40).limit(20)


@query("""WITH x AS (SELECT doc_id, 100 * (length(left(text, 80)) - length(replace(left(text, 80), 'the', ''))) / 3 + 10 * (length(left(text, 500)) - length(replace(left(text, 500), 'tion', ''))) / 4 AS score FROM documents)
SELECT doc_id, score::BIGINT AS score FROM x ORDER BY score DESC NULLS LAST, doc_id LIMIT 8""")
def r6_07_text_score(spark: SparkSession, d: str) -> DataFrame:
    hits = lambda n, t: ((F.length(F.left("text", F.lit(n))) - F.length(F.replace(F.left("text", F.lit(n)), F.lit(t), F.lit("")))) / len(t)).cast("long")
    score = 100 * hits(80, "the") + 10 * hits(500, "tion")
    return table(spark, d, "documents").select("doc_id", score.alias("score")).orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(8)


@query("""WITH x AS (SELECT source, max(n_chars) AS best, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1)
SELECT source, n, first FROM (SELECT *, best + 15 * least(n, 3) AS s FROM x ORDER BY s DESC, first LIMIT 3) ORDER BY first""")
def r6_08_best_sections(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("best"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return x.withColumn("s", F.col("best") + 15 * F.least("n", F.lit(3))).orderBy(F.col("s").desc(), "first").limit(3).orderBy("first").select("source", "n", "first")


def tag_hits(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    brand = part.filter("p_brand IN ('Brand#1', 'Brand#2')").select(F.lit("brand").alias("bucket"), F.col("p_partkey").alias("id"), F.lit(1.0).alias("score"))
    kind = part.filter("p_type IN ('LARGE', 'SMALL')").select(F.lit("type").alias("bucket"), F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))
    return brand.unionByName(kind)


TAGS = """WITH h AS (SELECT 'brand' AS bucket, p_partkey AS id, 1.0::DOUBLE AS score FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
UNION ALL SELECT 'type', p_partkey, p_size / 50 FROM part WHERE p_type IN ('LARGE', 'SMALL')) """


@query(TAGS + "SELECT id, round(sum(score), 6) AS score FROM h GROUP BY 1 HAVING count(DISTINCT bucket) = 2")
def r7_01_tags_and(spark: SparkSession, d: str) -> DataFrame:
    return combine(tag_hits(spark, d), "AND", ["brand", "type", "none"], optional=frozenset({"none"})).select("id", F.round("score", 6).alias("score"))


@query(TAGS + "SELECT id, round(sum(score * CASE bucket WHEN 'brand' THEN 0.3 ELSE 1.0 END), 6) AS score FROM h GROUP BY 1")
def r7_02_tags_linear(spark: SparkSession, d: str) -> DataFrame:
    return combine(tag_hits(spark, d), "LINEAR", ["brand", "type"], {"brand": 0.3}).select("id", F.round("score", 6).alias("score"))


@query(TAGS + "SELECT id, max(score) AS score, string_agg(bucket, ',' ORDER BY bucket) AS found_by FROM h GROUP BY 1")
def r7_03_merged_hits(spark: SparkSession, d: str) -> DataFrame:
    return merge_hits(tag_hits(spark, d).withColumnRenamed("bucket", "query")).select("id", "score", F.concat_ws(",", "queries").alias("found_by"))


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(s_name, c_name) AS name FROM (SELECT s_suppkey, s_name FROM supplier) FULL JOIN (SELECT c_custkey, c_name FROM customer) ON s_suppkey = c_custkey")
def r7_04_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return first_wins([table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")], "id")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def r7_05_name_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr("n_name AS name").union(table(spark, d, "region").select("r_name")).union(table(spark, d, "customer").select("c_mktsegment")).distinct()


COSINE = "CASE WHEN len(a.e) = len(b.e) AND len(a.e) > 0 AND list_sum(list_transform(a.e, lambda x: x * x)) > 0 AND list_sum(list_transform(b.e, lambda x: x * x)) > 0 THEN list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) ELSE 0.0 END"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT b.vec_id AS query, a.vec_id AS id, round({COSINE}, 6) AS score FROM v a, v b WHERE b.vec_id % 100 = 0 AND {COSINE} >= 0.2
QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id) <= 10""")
def r8_01_cosine_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    found = search(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("probe")), 0.2, 10)
    return found.select("query", "id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round({COSINE}, 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def r8_02_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("e"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("e"), F.col("f")), 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
h AS (SELECT b.vec_id AS query, a.vec_id AS id, {COSINE} AS score FROM v a, v b WHERE b.vec_id % 100 = 0 AND {COSINE} >= 0.2 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COSINE} DESC, a.vec_id) <= 10)
SELECT id, round(max(score), 6) AS score, count(*) AS n_queries FROM h GROUP BY 1""")
def r8_04_expanded_search(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    found = search(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("probe")), 0.2, 10)
    return merge_hits(found).select("id", F.round("score", 6).alias("score"), F.size("queries").cast("long").alias("n_queries"))


@query("""WITH want AS (SELECT * FROM (VALUES ('brand#1'), ('brand#3'), ('big')) t(tag)), alias AS (SELECT 'big' AS alias, 'large' AS tag),
x AS (SELECT p_partkey AS id, lower(p_brand) AS tag FROM part UNION ALL SELECT p_partkey, lower(p_type) FROM part)
SELECT id, min(layer) AS layer FROM (SELECT id, 1 AS layer FROM x JOIN want USING (tag) UNION ALL SELECT id, 2 FROM x JOIN alias USING (tag) JOIN want ON want.tag = alias.alias) GROUP BY 1""")
def r8_11_layered_tags(spark: SparkSession, d: str) -> DataFrame:
    """Exact tags, then those an alias stands for; the first layer that finds a target wins."""
    want = spark.createDataFrame([("brand#1",), ("brand#3",), ("big",)], "tag string")
    alias = spark.createDataFrame([("big", "large")], "alias string, tag string")
    part = table(spark, d, "part")
    tags = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("tag"))
    exact = tags.join(F.broadcast(want), "tag").select("id", F.lit(1).alias("layer"))
    meant = alias.join(want.withColumnRenamed("tag", "alias"), "alias").select("tag").join(want, "tag", "left_anti")
    return exact.unionByName(tags.join(F.broadcast(meant), "tag").select("id", F.lit(2).alias("layer"))).groupBy("id").agg(F.min("layer").alias("layer"))


@query("SELECT DISTINCT doc_id FROM documents WHERE lower(lang) IN ('de', 'fr') OR lower(source) IN ('src1')")
def r8_14_any_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.lower("lang").isin("de", "fr") | F.lower("source").isin("src1")).select("doc_id").distinct()


@query("SELECT p_partkey, round((0.5 * p_size / 50 + 0.5 * (p_brand = 'Brand#2')::INT) / 1.0, 6)::DOUBLE AS score FROM part ORDER BY score DESC, p_partkey LIMIT 50")
def r8_16_weighted_rerank(spark: SparkSession, d: str) -> DataFrame:
    score = (0.5 * F.col("p_size") / 50 + 0.5 * (F.col("p_brand") == "Brand#2").cast("int")) / 1.0
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(50)


@query("""WITH t AS (SELECT p_partkey AS id, 'brand' AS tag_type, p_brand AS tag FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'type', split_part(p_name, ' ', 1) FROM part)
SELECT id, tag_type, lower(trim(tag)) AS norm FROM t WHERE tag IS NOT NULL GROUP BY ALL""")
def r8_20_projected_tags(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("tag_type"), c.alias("tag")) for k, c in (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("type", F.split("p_name", " ")[0]))])
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(pairs).alias("t")).filter("t.tag is not null")
    return t.select("id", "t.tag_type", F.lower(F.trim("t.tag")).alias("norm")).distinct()


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 1.0 FROM orders WHERE o_orderstatus = 'P'""")
def r8_21_replaced_partition(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return replace_partition(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, ["l_orderkey"])


CHUNKS = """c0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, k, length(line) AS n, k // 7 AS heading, CASE WHEN k % 11 = 5 THEN 'table_row' WHEN k % 11 = 9 THEN 'image' ELSE 'body' END AS role FROM c0 WHERE k % 13 <> 8),
c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, heading ORDER BY k) AS x FROM c1 WHERE role = 'body'),
c3 AS (SELECT doc_id, k AS i, n, heading * 100000 + k - x AS run FROM c2)"""


@query(f"""WITH RECURSIVE {CHUNKS}, {packed_sql("SELECT doc_id, run, i, n FROM c3", "doc_id, run", 900, 4, 1)}
SELECT doc_id, CASE WHEN unit = 0 THEN 'section' ELSE 'sliding_window' END AS unit_type, first, last, n_rows AS n_chunks, total AS chars FROM pu
UNION ALL SELECT doc_id, CASE role WHEN 'image' THEN 'visual_context' ELSE role END, k, k, 1, n FROM c1 WHERE role <> 'body'""")
def r11_10_extraction_units(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as chunks, seven under a heading, some of them rows and images, some missing."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).filter("k % 13 <> 8")
    role = F.when(F.col("k") % 11 == 5, "table_row").when(F.col("k") % 11 == 9, "image").otherwise("body")
    method = F.when(role == "body", "llm").otherwise("rule")
    chunks = lines.select("doc_id", F.col("k").alias("chunk_index"), role.alias("role"), method.alias("method"), F.floor(F.col("k") / 7).alias("heading"), F.length("line").alias("chars"))
    return body_units(chunks, most=900, rows=4)
