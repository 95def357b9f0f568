"""Removal of byte strings that occur twice, by a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in
this text or another.  Whether that holds for a start is decided for some starts at once:

1. Every start has an anchor, the place of the least hash of eight bytes among the
   first ``window`` places of its string.  Equal strings have equal anchors, so strings
   of different anchors' surroundings needn't be compared.  One row goes out for an anchor, about
   one for ``window / 2`` bytes, with two hashes: of the bytes that all strings
   of an anchor have behind it (the core), and of the union of its strings.
2. Anchors are counted by core, with partial sums.  A core that occurs once is done: its
   suffix differs from all others at a depth that every string reaches.  If all
   anchors of a core have one union, all their strings occur twice.
3. What is left are cores with different unions, at the edges of copies.  One anchor for each union
   is brought together by core, with its bytes, and the suffixes at these anchors
   are sorted, deep-shallow: multikey quicksort to ``SHALLOW`` bytes, then a blind trie for each
   group that is equal so far, which compares a suffix with one other only.  The reversed
   bytes before the anchors are sorted likewise.  Two strings are equal if their anchors share
   so many bytes behind, and before, in these two orders.
4. A core of more than ``MOST`` unions isn't sorted in one task: its strings are hashed one by
   one and counted, with partial sums.

Hashes are of 64 bits, and two must agree (core and union), or of 128 bits in step 4.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; rows are
texts of their own, repeated rows and rows without doc_id too, so the bytes of a text of that length in two rows go in both;
further columns are ignored; an empty table gives an empty one.  Bytes
that are left need not be valid UTF-8, so they are binary.  A task holds the bytes of
``STEP`` of text, or of one longer text, at some 50 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm import textnp
from siltworks.llm.common import cut

LENGTH = 400
WINDOW = 200
SHALLOW = 16
#: Unions of one core that are sorted in one task.
MOST = 200
#: Anchors sorted at a time.
SORTED = 4000
#: Spans up to which they are sent to the texts; beyond, both are shuffled.
BROADCAST = 500_000
#: Bytes of text that are worked on at a time, unless one text is longer.
STEP = 500_000
_U = np.uint64


def anchors(text: np.ndarray, at: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of the stretches of starts that have one anchor, over all texts."""
    n, none = len(text), np.zeros(0, np.int64)
    step = np.zeros(n + 1, np.int8)
    long = np.diff(at) >= length
    step[at[:-1][long]] += 1
    step[at[1:][long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[:n], dtype=np.int8))
    if not len(starts):
        return none, none, none
    value = text.astype(_U)
    for s in (1, 2, 4):
        value[:-s] |= value[s:] << _U(8 * s)
    value = textnp.mix(value)
    value &= _U(0xFFFFFFFF00000000)
    value |= np.arange(n, dtype=_U)  # the leftmost of equals
    padded = np.full(-(-(n + window) // window) * window, np.iinfo(np.uint64).max, _U)
    padded[:n] = value
    tiles = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(tiles, axis=1).ravel()
    least = (np.minimum(ahead[starts], behind[starts + window - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    opens = np.ones(len(starts) + 1, bool)
    opens[1:-1] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    return starts[opens[:-1]], starts[opens[1:]], least[opens[:-1]]


def _find(length: int, window: int):
    core = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, signed = xxhash.xxh3_64_intdigest, lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        for batch in batches:
            for i, j, text, at in textnp.each(batch, "text", STEP):
                first, last, place = anchors(text, at, length, window)
                row = np.searchsorted(at, first, "right") - 1
                held, a, b, p = memoryview(text), first.tolist(), last.tolist(), place.tolist()
                cores = [of(held[x : x + core]) for x in p]
                unions = [of(held[x : y + length], z - x) for x, y, z in zip(a, b, p, strict=True)]
                packed = ((first - at[row]) << 16) | ((place - first) << 8) | (last - first)
                keys = [batch.column(x)[i:j].take(pa.array(row)) for x in ("id", "sum")]
                yield pa.RecordBatch.from_arrays([signed(cores), signed(unions), *keys, pa.array(packed)], names=["core", "whole", "id", "sum", "place"])

    return run


def _cut_out(length: int):
    """The strings' unions at some places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, sum_, text, places in zip(*[batch.column(x) for x in ("id", "sum", "text", "places")], strict=True):
                data, id_, sum_ = text.as_buffer(), id_.as_py(), sum_.as_py()
                for x in places.as_py():
                    start = x["place"] >> 16
                    out.append((x["core"], x["whole"], x["alone"], id_, sum_, x["place"], data[start : start + (x["place"] & 255) + length].to_pybytes()))
            schema = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("alone", pa.bool_()), ("id", pa.int64()), ("sum", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000], strict=True), schema, strict=True)], schema=schema)

    return run


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share from their beginning."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, d: int) -> int:
    return s[d] if d < len(s) else -1


def blind_trie(texts: list[bytes], ids: list[int]) -> list[int]:
    """Sort strings by a trie whose inner nodes hold a depth and branch on the byte there, without the bytes between.

    A new string goes down without looking between; the leaf it meets shares as much with it
    as any other does, so one comparison says where it belongs.
    """
    root: tuple | list = [ids[0]]  # a leaf: the ids of one string
    for k in ids[1:]:
        s, node = texts[k], root
        while isinstance(node, tuple):
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        other = texts[node[0]]
        d = common(s, other)
        if d == len(s) == len(other):
            node.append(k)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < d:
            above, node = node, node[1][_byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == d:
            node[1][_byte(s, d)] = [k]
            continue
        made = (d, {_byte(s, d): [k], _byte(other, d): node})
        if above is None:
            root = made
        else:
            above[1][_byte(s, above[0])] = made
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(texts: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort to a shallow depth, blind tries for groups that are equal to there."""
    out, todo = [], [(list(range(len(texts))), 0)]
    while todo:
        ids, d = todo.pop()
        if len(ids) < 2:
            out += ids
        elif d >= shallow:
            out += blind_trie(texts, ids)
        else:
            byte = [_byte(texts[k], d) for k in ids]
            pivot = sorted((byte[0], byte[len(ids) // 2], byte[-1]))[1]
            parts: tuple[list, list, list] = ([], [], [])
            for k, c in zip(ids, byte, strict=True):
                parts[(c > pivot) - (c < pivot)].append(k)  # equal, greater, smaller
            todo += [(parts[1], d), (parts[0], d + 1 if pivot >= 0 else shallow), (parts[2], d)]
    return out


def _ranked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the order, bytes shared with the one before) of each string, the second by place."""
    order = deep_shallow(texts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, np.array([-1] + [common(texts[a], texts[b]) for a, b in zip(order, order[1:])])  # noqa: B905


def repeated(texts: list[bytes], back: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """For strings' unions with anchors at ``back``: (k, first, last) of starts in union k that another union has too."""
    behind, shared_behind = _ranked([s[b:] for s, b in zip(texts, back.tolist(), strict=True)])
    before, shared_before = _ranked([s[:b][::-1] for s, b in zip(texts, back.tolist(), strict=True)])
    twice = np.zeros((len(texts), int(span.max()) + 2), bool)
    for o in range(int((back - span).min()), int(back.max()) + 1):  # bytes before the anchor
        live = np.flatnonzero((back - span <= o) & (o <= back))
        key = np.cumsum(shared_behind < length - o)[behind[live]] * (len(texts) + 1) + np.cumsum(shared_before < o)[before[live]]
        by_key = np.argsort(key, kind="stable")
        same = np.zeros(len(live) + 1, bool)
        same[1:-1] = key[by_key[1:]] == key[by_key[:-1]]
        again = live[by_key[same[1:] | same[:-1]]]
        twice[again, back[again] - o] = True
    edge = np.diff(twice.astype(np.int8), axis=1, prepend=0)
    k, first = np.nonzero(edge == 1)
    return np.stack([k, first, np.nonzero(edge == -1)[1] - 1], axis=1)


def _sort(length: int):
    """Unions, sorted by core and union, to the starts in them that occur twice; cores aren't divided."""
    schema = pa.schema([(x, pa.int64()) for x in ("id", "sum", "first", "last")])

    def solve(rows: dict[str, list]) -> pa.RecordBatch:
        place = np.array(rows["place"])
        keep = np.ones(len(place), bool)
        core, whole = np.array(rows["core"]), np.array(rows["whole"])
        keep[1:] = (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])  # the same union of a repeated row
        k = np.flatnonzero(keep)
        found = repeated([rows["bytes"][x] for x in k], (place[k] >> 8) & 255, place[k] & 255, length)
        at = k[found[:, 0]]
        alone = np.array(rows["alone"])[at]
        at, found = at[alone], found[alone]
        start = place[at] >> 16
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(rows["id"])[at], np.array(rows["sum"])[at], start + found[:, 1], start + found[:, 2])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            n = sum(x.num_rows for x in held)
            if n < SORTED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            core = table.column("core").to_numpy()
            until = int(np.searchsorted(core, core[-1]))  # the last core may go on
            if until:
                yield solve(table.slice(0, until).to_pydict())
            held = table.slice(until).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).to_pydict())

    return run


def _strings(length: int):
    """Every string of some unions, as a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                place = part.column("place").to_numpy()
                size = (place & 255) + 1
                found = [xxhash.xxh3_128_digest(data[i : i + length]) for data, n in zip(part.column("bytes").to_pylist(), size.tolist(), strict=True) for i in range(n)]
                of = np.repeat(np.arange(len(place)), size)
                first = (place >> 16)[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *[part.column(x).take(pa.array(of)) for x in ("id", "sum")], pa.array(first)], names=["string", "id", "sum", "first"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key of a row: its doc_id and a hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return row.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("sum"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """id, sum (as of _texts), first, last: stretches of starts, in bytes, whose strings of ``length`` bytes occur twice."""
    texts = _texts(docs)
    found = cut(texts.select("id", "sum", "text").mapInArrow(_find(length, window), "core long, whole long, id long, sum long, place long"))
    cores = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).filter("n > 1")
    cores = cut(cores.select("core", (F.col("low") != F.col("high")).alias("mixed")))  # else a hot core's side of the join can't be split
    again = cut(found.join(cores, "core"))
    mixed = again.filter("mixed")
    wholes = cut(mixed.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "sum", "place")).alias("at")))
    first = F.shiftright("place", 16)
    stretch = lambda df: df.select("id", "sum", first.alias("first"), (first + F.col("place").bitwiseAND(255)).alias("last"))
    copies = cut(wholes.filter("n > 1").select("core", "whole"))
    out = stretch(again.filter("not mixed")).unionAll(cut(stretch(mixed.join(copies, ["core", "whole"]))))

    places = wholes.select("at.id", "at.sum", F.struct("core", "whole", F.col("at.place").alias("place"), (F.col("n") == 1).alias("alone")).alias("place"))
    per_text = places.groupBy("id", "sum").agg(F.collect_list("place").alias("places"))
    unions = texts.select("id", "sum", "text").join(per_text.hint("shuffle_merge"), ["id", "sum"]).mapInArrow(_cut_out(length), "core long, whole long, alone boolean, id long, sum long, place long, bytes binary")
    hot = cut(wholes.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select("core"))
    unions = cut(unions)
    rest = unions.join(hot, "core", "left_anti").repartition("core").sortWithinPartitions("core", "whole")
    out = out.unionAll(rest.mapInArrow(_sort(length), "id long, sum long, first long, last long"))
    many = unions.join(hot, "core", "left_semi").dropDuplicates(["core", "whole"]).select("id", "sum", "place", "bytes", "alone")
    if not hot.isEmpty():
        strings = cut(many.select("id", "sum", "place", "bytes").mapInArrow(_strings(length), "string binary, id long, sum long, first long"))
        twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
        out = out.unionAll(strings.join(twice, "string").select("id", "sum", "first", F.col("first").alias("last")))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, at, parts = text.as_py().encode(), 0, []
            for s in spans.as_py() or []:
                parts.append(data[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("spans"), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


SPAN = "struct<start: bigint, end: bigint>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes, end exclusive, maximal), kept (the bytes left)."""
    by_text = Window.partitionBy("id", "sum").orderBy("start", "end")
    spans = repeated_starts(docs, length, window).select("id", "sum", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    opens = F.coalesce(F.col("start") > F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    numbered = spans.withColumn("opens", opens).withColumn("k", F.sum("opens").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("id", "sum", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    per_text = cut(merged.groupBy("id", "sum").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
    if (per_text.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST:
        per_text = F.broadcast(per_text)
    joined = _texts(docs).join(per_text, ["id", "sum"], "left")
    ready = joined.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return ready.mapInArrow(_apply, f"doc_id long, n_bytes long, spans array<{SPAN}>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """One row a text: how many bytes it has, how many went in how many spans, and the check sum of the rest."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
