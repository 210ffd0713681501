"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A document is the set of 64-bit digests of its paragraphs. A sketch has three rows of cells; a digest goes to
one cell of each row, and a cell keeps a count, the XOR of its digests and the XOR of their check values. Two
versions' sketches subtract cell by cell, which leaves only the digests in which they differ; peeling takes
digests from cells that hold exactly one, removes them from their other cells, and goes on, and so recovers the
digests that only one side has. If that does not empty the sketch, both sides are sketched larger: spread by
hash over parts of a few digests each, and a part that still fails again with twice the cells and another
hash, up to RETRIES times. That a part fails every time has a probability below 1e-20; it would be an error,
never a wrong result.

Scale: texts are shuffled once, by ranges of the document id, to meet their successor; everything else happens in
the document's row. Ranges follow the number of rows, and rows that share an id, or have none, are ranged by a
hash of their text, so no id is a hot key. Work follows the number of paragraphs; parts bound the size of any one
sketch. A text of any length is read whole.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A paragraph is a run of a line of at least so many characters up to a sentence's end, within four times as many; else
#: so many up to the end of a word, or the rest of the line.
PARAGRAPH = 96
#: Cells in each of the three rows of the fingerprint, and of a part's first sketch.
WIDTH, PART_WIDTH = 8, 8
#: Digests that a part is meant for.
PART_KEYS = 8
#: Sketches of a part, each twice as wide as the one before.
RETRIES = 12
ROUNDS = 16
#: Rows of a range in which documents meet their successors, about.
RANGE_ROWS = 250_000
CELL = "array<struct<n:int,x:bigint,c:bigint>>"
FOUND = "struct<ok:boolean,a:array<bigint>,b:array<bigint>>"


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for a null, empty or blank text."""
    cut = rf"[^\n]{{{PARAGRAPH},{4 * PARAGRAPH}}}?[.!?](?=\s|$)|[^\n]{{{PARAGRAPH}}}[^\n ]*|[^\n]+"
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(cut), F.lit(0))
    return F.array_distinct(F.transform(F.filter(runs, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p)))


def _check(key: str) -> str:
    return f"xxhash64({key}, 7)"


def _slot(key: str, row: str, bits: str, salt: str) -> str:
    """SQL: the cell of a key in a row of 1 << bits cells."""
    return f"(shiftrightunsigned(xxhash64({key}, {salt}), {row} * {bits}) & (shiftleft(1L, {bits}) - 1L))"


def _cells(keys: str, bits: str, salt: str) -> str:
    """SQL: the 3 << bits cells of a sketch of keys. A key is read once per cell row and position, so sketches are small."""
    rows = [
        f"transform(sequence(0, shiftleft(1, {bits}) - 1), j -> aggregate({keys}, struct(0 as n, 0L as x, 0L as c), (a, k) ->"
        f" if({_slot('k', str(row), bits, salt)} = j, struct(a.n + 1 as n, a.x ^ k as x, a.c ^ {_check('k')} as c), a)))"
        for row in range(3)
    ]
    return f"concat({', '.join(rows)})"


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> struct(p.n - q.n as n, p.x ^ q.x as x, p.c ^ q.c as c))"


def _peel(cells: str, bits: str, salt: str) -> str:
    """SQL: struct(ok, a, b) of subtracted cells: whether all were recovered, and the digests of either side."""
    row, at = f"cast(floor(i / shiftleft(1, {bits})) as int)", f"i % shiftleft(1, {bits})"
    found = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and c.c = {_check('c.x')}), c -> struct(c.n as n, c.x as x)))"
    after = (
        f"transform(s.cells, (c, i) -> aggregate(found, c, (z, f) -> if({_slot('f.x', row, bits, salt)} = {at},"
        f" struct(z.n - f.n as n, z.x ^ f.x as x, z.c ^ {_check('f.x')} as c), z)))"
    )
    side = lambda s, n: f"concat(s.{s}, transform(filter(found, f -> f.n = {n}), f -> f.x))"
    # found is bound as the one element of an array, so that it is computed once.
    step = (
        "if(s.done, s, element_at(transform(array(" + found + "), found -> if(size(found) = 0, struct(s.cells as cells, s.a as a, s.b as b, true as done),"
        f" struct({after} as cells, {side('a', 1)} as a, {side('b', -1)} as b, false as done))), 1))"
    )
    none = "cast(array() as array<bigint>)"
    begin = f"struct({cells} as cells, {none} as a, {none} as b, false as done)"
    end = "struct(not exists(s.cells, c -> c.n != 0 or c.x != 0 or c.c != 0) as ok, s.a as a, s.b as b)"
    return f"cast(aggregate(sequence(1, {ROUNDS}), {begin}, (s, r) -> {step}, s -> {end}) as {FOUND})"


def _bound(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _part_difference(p: str) -> str:
    """SQL: struct(ok, a, b) for one part p with key arrays p.a and p.b: sketches of growing width, each with a hash of its
    own, until one peels."""
    bits, salt = f"({PART_WIDTH.bit_length() - 1} + t)", "(11 + t)"
    tried = _peel(_subtract(_cells(f"{p}.a", bits, salt), _cells(f"{p}.b", bits, salt)), bits, salt)
    none = f"cast(struct(false as ok, array() as a, array() as b) as {FOUND})"
    return f"aggregate(sequence(0, {RETRIES - 1}), {none}, (g, t) -> if(g.ok, g, {tried}), g -> if(g.ok, g, raise_error('no sketch of a part peels')))"


def _spread(keys: str, wide: str, inner: str) -> str:
    """SQL: keys dealt to wide * inner parts, in two steps so that work stays near-linear."""
    at = lambda k, div: f"cast(pmod(shiftrightunsigned(xxhash64({k}, 17), {div}), %s) as int)"
    coarse = f"transform(sequence(0, {wide} - 1), i -> filter({keys}, k -> {at('k', 8) % wide} = i))"
    return f"flatten(transform({coarse}, g -> transform(sequence(0, {inner} - 1), j -> filter(g, k -> {at('k', 36) % inner} = j))))"


def difference(a: str, b: str, base_a: str, base_b: str) -> Column:
    """struct(ok, a, b): the digests that only one side has. The fingerprints' own cells come first; if those do not peel,
    the sides are dealt to parts."""
    bits = str(WIDTH.bit_length() - 1)
    base = _peel(_subtract(base_a, base_b), bits, "3")
    total = f"(size({a}) + size({b}))"
    wide = f"greatest(1, cast(ceil(sqrt({total} / {PART_KEYS})) as int))"
    parts = f"zip_with({_spread('s.a', 's.w', 's.w')}, {_spread('s.b', 's.w', 's.w')}, (x, y) -> struct(x as a, y as b))"
    joined = "struct(true as ok, flatten(transform(d, r -> r.a)) as a, flatten(transform(d, r -> r.b)) as b)"
    larger = _bound(f"struct({a} as a, {b} as b, {wide} as w)", "s", _bound(f"transform({parts}, p -> {_part_difference('p')})", "d", joined))
    return F.expr(_bound(base, "r0", f"if(r0.ok, r0, cast({larger} as {FOUND}))"))


def likeness(found: str, a: str, b: str) -> Column:
    """Shared digests over all digests; 1 where neither side has any."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, cast(size({a}) - size({found}.a) as double) / (size({a}) + size({found}.b)))")


def printed(cells: str) -> Column:
    """A sketch as text that can be read back: base64 of each cell's count (4 bytes), XOR and check (8 each)."""
    return F.expr(f"base64(unhex(array_join(transform({cells}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.x), 16, '0'), lpad(hex(c.c), 16, '0'))), '')))")


def listed(keys: str) -> Column:
    """Digests as text: 16 hexadecimal digits each, sorted, comma-joined."""
    return F.expr(f"array_join(array_sort(transform({keys}, k -> lower(lpad(hex(k), 16, '0')))), ',')")


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """df plus columns that are computed once, however often they are used: a generator stands between the projections."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__b")
    return df.select("*", packed).select(*df.columns, *[F.col(f"__b.{n}").alias(n) for n in columns])


def bucket_bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the table into about equal ranges; an id that fills several ranges is named several times."""
    marks = [k / buckets for k in range(1, buckets)]
    return docs.agg(F.percentile_approx("doc_id", marks, 20 * buckets)).first()[0] or [] if marks else []


def _constant(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _bucket(found: list[int], nulls: int) -> tuple[Column, Column]:
    """(bucket, part) of a row: how many different bounds are at most its id, by binary search, and 0 for a null id; part 0,
    or for an id that fills several ranges, and for null ids, which share of the hashes of its text it is in, from 1 on.
    In the order of successors buckets descend, and parts ascend with descending hashes."""
    bounds = sorted(set(found))
    tally = Counter(found)
    times = [tally[b] for b in bounds]
    at = F.lit(0)
    if bounds:
        steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
        edges = _constant(bounds)

        def step(a, s):
            low = F.element_at(edges, F.least(a + s, F.lit(len(bounds)))) <= F.col("doc_id")
            return F.when((a + s <= len(bounds)) & low, a + s).otherwise(a)

        at = F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step), F.lit(0))
    shares = F.when(F.col("doc_id").isNull(), F.lit(nulls).cast("bigint"))
    if bounds:
        shares = shares.when((at > 0) & (F.element_at(edges, F.greatest(at, F.lit(1))) == F.col("doc_id")), F.element_at(_constant(times), F.greatest(at, F.lit(1))))
    place = F.floor((0.5 - F.col("h") / F.lit(2.0**64)) * shares)  # 0 for the largest hashes
    part = F.when(shares.isNull() | (F.col("doc_id").isNotNull() & (shares < 2)), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(place, shares - 1)) + 1)
    return at.cast("int"), part.cast("int")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, body, keys, next_body, next_keys): each document with the next one in descending doc_id order; after the
    last comes the first. Null ids come last, equal ids by a hash of their text. One shuffle of the texts."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body")).withColumn("h", F.xxhash64("body"))
    rows, ids = slim.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    buckets = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 4), -(-rows // range_rows))
    bucket, part = _bucket(bucket_bounds(slim, buckets), max(1, -(-buckets * (rows - ids) // max(1, rows))))
    placed = slim.withColumns({"bucket": bucket, "part": part, "keys": paragraphs(F.col("body"))})
    w = Window.partitionBy("bucket", "part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    found = placed.withColumn("next", F.lead(F.struct("body", "keys")).over(w))
    # The first document of every range, which is the successor of the last one of the range before it.
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("h").alias("c"))
    tops = slim.select("doc_id", "h", bucket.alias("bucket"), part.alias("part")).groupBy("bucket", "part").agg(F.max(key).alias("top"))
    firsts = sorted((-r["bucket"], r["part"], r["top"]["b"], r["top"]["c"]) for r in tops.collect())  # a row per range
    chain = [(-b, p, *firsts[(k + 1) % len(firsts)][2:]) for k, (b, p, *_) in enumerate(firsts)]
    links = spark.createDataFrame(chain, "after int, after_part int, t_id bigint, t_h bigint")
    # A row per range: as many as shuffle partitions times four, or as rows / range_rows.
    heads = slim.join(F.broadcast(links), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
    heads = heads.select("after", "after_part", F.col("body").alias("head_body"), paragraphs(F.col("body")).alias("head_keys")).dropDuplicates(["after", "after_part"])
    joined = found.join(heads, (found.bucket == heads.after) & (found.part == heads.after_part), "left")
    return joined.select(
        "doc_id", "body", "keys",
        F.when(F.col("next").isNull(), F.col("head_body")).otherwise(F.col("next.body")).alias("next_body"),
        F.when(F.col("next").isNull(), F.col("head_keys")).otherwise(F.col("next.keys")).alias("next_keys"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    differing_edited, differing_next (digests on one side only), removed, added (those that only the text, or only the edited
    text, has, as recovered).

    A null text is empty; a blank one has no paragraphs, and two such are alike with 1. Rows that repeat keep a row each,
    next to each other in the order; null ids come last. A single row is its own successor. Very long texts count whole.
    Other columns are ignored; an empty table gives no rows.
    """
    n = F.length("body").cast("bigint")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(body, cast(length(body) - floor(length(body) / 3) as int))"), F.substr("next_body", F.lit(1), third))
    a = _barrier(with_next(docs), n_chars=n, edited=edited)
    b = _barrier(a, edited_keys=paragraphs(F.col("edited")))
    bits = str(WIDTH.bit_length() - 1)
    c = _barrier(b, cells=F.expr(_cells("keys", bits, "3")), edited_cells=F.expr(_cells("edited_keys", bits, "3")), next_cells=F.expr(_cells("next_keys", bits, "3")))
    d = _barrier(c, to_edited=difference("keys", "edited_keys", "cells", "edited_cells"), to_next=difference("keys", "next_keys", "cells", "next_cells"))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("cells").alias("fingerprint"),
        printed("edited_cells").alias("edited_fingerprint"),
        likeness("to_edited", "keys", "edited_keys").alias("near_edited"),
        likeness("to_next", "keys", "next_keys").alias("near_next"),
        F.expr("cast(size(to_edited.a) + size(to_edited.b) as bigint)").alias("differing_edited"),
        F.expr("cast(size(to_next.a) + size(to_next.b) as bigint)").alias("differing_next"),
        listed("to_edited.a").alias("removed"),
        listed("to_edited.b").alias("added"),
    )
