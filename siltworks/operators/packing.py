"""Greedy packing of ordered rows into units, and units of contiguous body chunks.

Where a unit ends depends only on the first row that is new in it: it holds the ``overlap`` rows
before that one, as far as there are such, and goes on while it has room.  So each row knows the row at which
the unit that it would open is followed by the next, and the units of a key are the path from its first
row.  A key is cut into slices of ``SLICE`` rows by row number; each slice says, for each row that a path
may enter it by (the first ``rows`` ones), by which row the path leaves it and after how many units.
These maps are put together slice after slice, and each slice then walks its own part of the
path.  Everything is built of array expressions; a task holds a slice, and of a key
the maps, a few numbers for ``SLICE`` rows.

Defined cases: null sizes are 0; null keys are a key; a row larger than a unit is a unit of its own
with what it overlaps; ties in the order are packed in either way; an empty table has no units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators.ordered import Placed, meet, runs, written

#: Rows of a key that one array holds.
SLICE = 1024
#: Characters and chunks of a unit, chunks that a unit takes over, and what units of single chunks are called.
UNIT_CHARS, UNIT_CHUNKS, UNIT_OVERLAP = 24000, 24, 1
SINGLE = {"table_row": "table_row", "metric_image": "visual_context", "chart": "visual_context", "image": "visual_context"}


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, n, pos (from 0), sum (of n before) of rows (keys, i, n), without a window over a key."""
    p = Placed(df, keys, [F.col("i").asc_nulls_first()])
    inside = F.coalesce(F.sum("n").over(p.inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums, counts = p.offsets(p.rows, F.sum("n")), p.offsets(p.rows, F.count("*"))
    known = meet(p.rows.withColumn(p.was, inside), sums.drop(p.total), [*keys, p.part])
    known = meet(known, counts.select(*keys, p.part, F.col(p.before).alias("rows_")), [*keys, p.part])
    return known.select(*keys, "i", "n", (F.col(p.at) - F.col(p.first) + F.col("rows_")).alias("pos"), (F.col(p.was) + F.col(p.before)).alias("sum"))


def _sliced(placed: DataFrame, keys: list[str], size: int, rows: int, overlap: int) -> DataFrame:
    """keys, slice, items (sorted struct<pos, i, n, sum>) of each slice, with ``overlap`` rows before and ``rows`` after it."""
    own = F.floor(F.col("pos") / size)
    near = F.array_compact(F.array(own, F.when((own > 0) & (F.col("pos") % size < rows), own - 1), F.when(F.col("pos") % size >= size - overlap, own + 1)))
    laid = placed.withColumn("slice", F.explode(near))
    return laid.groupBy(*keys, "slice").agg(F.sort_array(F.collect_list(F.struct("pos", "i", "n", "sum"))).alias("items"))


def _next(items: Column, x: Column, most: int, rows: int, overlap: int) -> Column:
    """The row at which the unit whose first new row is ``x`` is followed by the next."""
    start = F.greatest(x["pos"] - overlap, F.lit(0))
    first = F.get(items, F.lit(0))["pos"]
    base = F.get(items, (start - first).cast("int"))["sum"]
    ahead = F.slice(items, (x["pos"] - first + 2).cast("int"), F.lit(rows))
    fits = F.filter(ahead, lambda y: (y["sum"] + y["n"] - base <= most) & (y["pos"] - start < rows))
    return x["pos"] + 1 + F.size(fits)


def pack(df: DataFrame, key: str | list[str], order: str, size: str, most: int, rows: int, overlap: int = 0) -> DataFrame:
    """(keys, unit, n_rows, total, first, last): units of at most ``most`` in size and ``rows`` rows, each but the first begun with the last ``overlap`` rows of the one before."""
    keys = [key] if isinstance(key, str) else list(key)
    if rows <= overlap or rows < 1 or overlap < 0:
        raise ValueError("rows must be more than overlap, which must not be negative")
    span = max(SLICE, 2 * rows)
    own = [f"key{k}" for k in range(len(keys))]
    slim = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(order).cast("long").alias("i"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("n"))
    sliced = _sliced(_placed(slim, own), own, span, rows, overlap)
    low = F.col("slice") * span
    mine = F.filter("items", lambda x: (x["pos"] >= low) & (x["pos"] < low + span))
    # Each of the slice's rows with the row that follows its unit; the lists are bound once, before they are walked.
    steps = written(sliced.withColumn("mine", mine).withColumn("steps", F.transform("mine", lambda x: F.struct(x["pos"].alias("pos"), _next(F.col("items"), x, most, rows, overlap).alias("to")))).drop("mine"))
    steps = steps.filter(F.size("steps") > 0)
    none = F.array().cast("array<struct<out: bigint, n: int>>")

    def back(ends: Column, s: Column) -> Column:
        """Ends of the paths from the next ``rows`` rows, nearest first, with those of one row more."""
        within = F.get(ends, (s["to"] - s["pos"] - 1).cast("int"))
        end = F.when(within.isNull(), F.struct(s["to"].alias("out"), F.lit(1).alias("n"))).otherwise(F.struct(within["out"].alias("out"), (within["n"] + 1).alias("n")))
        return F.slice(F.concat(F.array(end), ends), F.lit(1), F.lit(rows))

    maps = steps.select(*own, "slice", F.aggregate(F.reverse("steps"), none, back).alias("ends"))
    by_key = maps.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("slice", "ends"))).alias("maps"))
    entry = "array<struct<slice: bigint, pos: bigint, unit: bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("unit"), F.array().cast(entry).alias("all"))

    def through(a: Column, m: Column) -> Column:
        end = F.get(m["ends"], (a["pos"] - m["slice"] * span).cast("int"))
        seen = F.struct(m["slice"].alias("slice"), a["pos"].alias("pos"), a["unit"].alias("unit"))
        return F.struct(F.coalesce(end["out"], a["pos"]).alias("pos"), (a["unit"] + F.coalesce(end["n"], F.lit(0))).alias("unit"), F.array_append(a["all"], seen).alias("all"))

    entries = by_key.select(*own, F.explode(F.aggregate("maps", start, through, lambda a: a["all"])).alias("e")).select(*own, F.col("e.slice").alias("slice"), F.col("e.pos").alias("enter"), F.col("e.unit").alias("before"))
    unit = "array<struct<pos: bigint, to: bigint>>"

    def walk(a: Column, s: Column) -> Column:
        here = s["pos"] == a["at"]
        return F.struct(F.when(here, s["to"]).otherwise(a["at"]).alias("at"), F.when(here, F.array_append(a["units"], s)).otherwise(a["units"]).alias("units"))

    walked = meet(steps, entries, [*own, "slice"]).withColumn("units", F.aggregate("steps", F.struct(F.col("enter").alias("at"), F.array().cast(unit).alias("units")), walk, lambda a: a["units"]))
    found = walked.select(*own, "items", "before", F.posexplode("units").alias("k", "u"))
    first = F.get("items", F.lit(0))["pos"]
    begin = F.greatest(F.col("u.pos") - overlap, F.lit(0))
    a, b = F.get("items", (begin - first).cast("int")), F.get("items", (F.col("u.to") - 1 - first).cast("int"))
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], (F.col("before") + F.col("k")).alias("unit"), (F.col("u.to") - begin).alias("n_rows"), (b["sum"] + b["n"] - a["sum"]).alias("total"), a["i"].alias("first"), b["i"].alias("last"))


def body_units(chunks: DataFrame, policy: bool = False, most: int = UNIT_CHARS, rows: int = UNIT_CHUNKS, overlap: int = UNIT_OVERLAP) -> DataFrame:
    """(doc_id, unit_type, first, last, n_chunks, chars) of chunks (doc_id, chunk_index, role, method, heading, chars).

    Contiguous body chunks for a language model under one heading (of a policy: under any) are packed; the first unit of such a run is a
    section, the others are windows.  Any other chunk is a unit of its own, named after its role.
    """
    body = F.coalesce((F.col("role") == "body") & (F.col("method") == "llm"), F.lit(False))
    slim = chunks.select("doc_id", "chunk_index", "heading", "chars").filter(body)
    same = lambda was: (F.col("chunk_index") == was["chunk_index"] + 1) & (F.lit(policy) | F.col("heading").eqNullSafe(was["heading"]))
    packed = pack(runs(slim, ["doc_id"], [F.col("chunk_index").asc()], same), ["doc_id", "run"], "chunk_index", "chars", most, rows, overlap)
    names = ("policy_document", "policy_window") if policy else ("section", "sliding_window")
    windows = packed.select("doc_id", F.when(F.col("unit") == 0, names[0]).otherwise(names[1]).alias("unit_type"), "first", "last", F.col("n_rows").alias("n_chunks"), F.col("total").alias("chars"))
    called = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SINGLE.items() for x in kv]), F.coalesce("role", F.lit(""))), F.lit("chunk"))
    index = F.col("chunk_index").cast("long")
    alone = chunks.filter(~body).select("doc_id", called.alias("unit_type"), index.alias("first"), index.alias("last"), F.lit(1).cast("long").alias("n_chunks"), F.coalesce(F.col("chars").cast("long"), F.lit(0).cast("long")).alias("chars"))
    return windows.unionByName(alone)
