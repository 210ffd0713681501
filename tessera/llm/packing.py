"""Packing token sequences by minimum bin slack.

Documents are cut at multiples of the capacity; the pieces left over have at most capacity - 1 tokens, so
what remains to be packed is a histogram of at most capacity - 1 counts however large the corpus is. On
that histogram the driver fills one sequence after another: the longest length left goes in, and a subset-sum
dynamic program over the other lengths, one machine integer of capacity + 1 bits per length, finds the
multiset that comes closest to the capacity; backtracking gives the count of each length. A filling is
repeated as often as the histogram allows, which uses up some length, so there are only a few thousand
fillings, and the plan that all tasks get has at most capacity * sqrt(2 * capacity) rows, 131,072 for 2048
tokens. Each piece finds its place from its length and its number among pieces of that length.

Scale: texts are read once, in place, and only pieces (a few numbers each) are written to the shared
folder. A piece's number is counted within its task while it is made; per-task counts, not pieces, are
summed up to make the numbers global, so a length that a third of all pieces have is never in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .tokens import WIDE, WORD_BPE, default_path, encoder

CAPACITY = 2048
END = 1
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth")])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    import uuid

    enc, task, met = encoder(path), uuid.uuid4().int >> 65, defaultdict(int)
    tail = enc.pack([end])
    for b in batches:
        rows: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            ids = np.frombuffer(enc.encode(text.as_py()) + tail, enc.dtype).astype(WIDE)
            for at in range(0, len(ids), capacity):
                part = ids[at : at + capacity]
                rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), task, met[len(part)]))
                met[len(part)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=PIECES)


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how many in one sequence), ...], sequences filled so), ...]: uses every piece exactly once."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    full = (1 << (capacity + 1)) - 1
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        room, states = capacity - first, [(0, 1)]
        reach, goal = 1, 1 << room
        for n in lengths:
            if n > room:
                continue
            spare, step = min(left[n] - (n == first), room // n), 1
            now = reach
            while spare > 0:  # a bounded number of pieces of this length, by doubling
                use = min(step, spare)
                now |= (now << (use * n)) & full
                spare, step = spare - use, step * 2
            now &= (1 << (room + 1)) - 1
            if now != reach:
                states.append((n, now))
                reach = now
                if reach & goal:
                    break
        total, took = reach.bit_length() - 1, defaultdict(int)
        took[first] = 1
        for k in range(len(states) - 1, 0, -1):  # backtrack: the fewest pieces of each length that explain the total
            n, before = states[k][0], states[k - 1][1]
            while not before >> total & 1:
                total -= n
                took[n] += 1
        times = min(left[n] // m for n, m in took.items())
        out.append((sorted(took.items(), reverse=True), times))
        for n, m in took.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def places(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, per, offset, sequence): pieces of the length numbered low to high - 1 go, per of them
    to a sequence, side by side from offset on, to sequences from that one on."""
    out, used, sequence = [], defaultdict(int), 0
    for filling, times in fillings(counts, capacity):
        offset = 0
        for n, m in filling:
            out.append((n, used[n], used[n] + m * times, m, offset, sequence))
            used[n] += m * times
            offset += n * m
        sequence += times
    return out


def packed(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; a very long one has as many pieces as it needs. Rows that repeat a doc_id,
    and null ids, are documents of their own; other columns are ignored. An empty table gives no rows. Equal tables give equal fillings; which of two pieces of
    the same length takes which place is open.
    """
    path, spark = path or default_path(WORD_BPE), docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = saved(slim.mapInArrow(lambda it: _pieces(it, path, end, capacity), PIECES_SQL))
    made = saved(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in made.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(places(counts, capacity) or [], "len long, low long, high long, per long, at long, first long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # A row per task and length: it grows with the corpus, so it is shuffled, not broadcast.
    ranked = pieces.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # At most capacity + 1 lengths and a few thousand fillings of at most sqrt(2 * capacity) lengths each.
    put = ranked.join(F.broadcast(plan), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    index = F.col("rank") - F.col("low")
    return put.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(index / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + index % F.col("per") * F.col("length")).alias("offset"),
    )
