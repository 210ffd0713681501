"""Binary token output: static range asymmetric numeral system.

A segment holds whole documents under one shared frequency table; its blocks are coded independently of
each other. Within a block, symbol i belongs to lane i mod lanes; all lanes take a step together, so numpy
codes a whole step at a time and the words that lanes put out interleave in one stream. Every few steps the
lane states and the place in the stream are stored as a checkpoint, from which decoding can begin, and each
block carries the CRC-32 of its ids, which decoding verifies.

Scale: one range shuffle puts documents in order; encoding works on segments of bounded size without seeing
any other one; decoding works on single blocks, one row each, and only documents
that cross a block's edge meet again, by a few numbers. Global positions come from per-segment totals. The
container is Parquet in the shared folder, so it can be written and read wherever Spark can.

A text of any length is encoded whole, and held whole by one task; its ids fill as many blocks as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .tokens import BYTE_BPE, WIDE, default_path, encoder

END = 2
BITS = 17
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK = 1 << 20
#: Steps between two checkpoints.
EVERY = 256
#: Ids of a segment; it ends with the document that reaches them.
SEGMENT = 1 << 22
U = np.uint64


# --- one block --------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum 2 ** bits, at least 1 for each symbol that occurs."""
    size, total = 1 << bits, int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    if int((counts > 0).sum()) > size:
        raise ValueError("more symbols than slots")
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / total), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    off = size - int(f.sum())
    if off > 0:
        f[order[0]] += off
    while off < 0:  # take from the largest, which lose least
        able = order[f[order] > 1][: max(1, -off)]
        give = np.minimum(f[able] - 1, np.maximum(1, f[able] * -off // max(1, int(f[able].sum()))))
        spent = np.cumsum(give)
        give = np.where(spent <= -off, give, 0)
        f[able] -= give
        off += int(give.sum())
    return f


def encode_block(ids: np.ndarray, freq: np.ndarray, bits: int = BITS, lanes: int = LANES, every: int = EVERY) -> dict:
    """ids under the table as {n, lanes, stream, states, points, crc}: states are those decoding begins with, points
    the checkpoints as (step, place in the stream, states) packed one after the other."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 256))
    cum = np.concatenate(([0], np.cumsum(freq)[:-1]))
    f_of, c_of = freq[ids].astype(U), cum[ids].astype(U)
    x = np.full(lanes, LOW, U)
    steps, limit = -(-n // lanes), U(63 - bits)
    chunks: list[np.ndarray] = []
    points: list[tuple[int, int, bytes]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        f, c = f_of[t * lanes : (t + 1) * lanes], c_of[t * lanes : (t + 1) * lanes]
        now = x[: len(f)]
        out = now >> limit >= f
        if out.any():
            chunks.append(now[out].astype(np.uint32))
            written += len(chunks[-1])
            now = np.where(out, now >> U(32), now)
        q = now // f
        x[: len(f)] = (q << U(bits)) + (now - q * f) + c
        if t and t % every == 0:
            points.append((t, written, x.astype("<u8").tobytes()))
    stream = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
    packed = b"".join(np.array([t, written - w], "<u8").tobytes() + s for t, w, s in reversed(points))
    return {
        "n": n, "lanes": lanes, "stream": stream.astype("<u4").tobytes(), "states": x.astype("<u8").tobytes(),
        "points": packed, "crc": zlib.crc32(ids.astype(WIDE).tobytes()),
    }


class Table:
    """A frequency table opened for decoding."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.mask = U(bits), U((1 << bits) - 1)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.freq, self.cum = freq.astype(U), np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U)


def checkpoints(block: dict) -> list[tuple[int, int, np.ndarray]]:
    size = 16 + 8 * block["lanes"]
    out = []
    for at in range(0, len(block["points"]), size):
        t, place = np.frombuffer(block["points"], "<u8", 2, at).tolist()
        out.append((t, place, np.frombuffer(block["points"], "<u8", block["lanes"], at + 16)))
    return out


def decode_block(block: dict, table: Table, point: int | None = None) -> np.ndarray:
    """The ids of a block; with point, those from that checkpoint on. The stream must end, with every lane
    back at its first state, where the ids do; a whole block is also held against its checksum."""
    n, lanes = block["n"], block["lanes"]
    stream = np.frombuffer(block["stream"], "<u4").astype(U)
    first, place, x = 0, 0, np.frombuffer(block["states"], "<u8").astype(U)
    if point is not None:
        first, place, x = checkpoints(block)[point]
        x = x.astype(U)
    x = x.copy()
    out = np.empty(n - first * lanes, np.uint32)
    for t in range(first, -(-n // lanes)):
        width = min(lanes, n - t * lanes)
        now = x[:width]
        slot = now & table.mask
        s = table.symbol[slot]
        out[(t - first) * lanes : (t - first) * lanes + width] = s
        now = table.freq[s] * (now >> table.bits) + slot - table.cum[s]
        need = np.flatnonzero(now < LOW)
        if len(need):
            now[need] = now[need] << U(32) | stream[place : place + len(need)]
            place += len(need)
        x[:width] = now
    if place != len(stream) or (x != LOW).any() or (point is None and zlib.crc32(out.astype(WIDE).tobytes()) != block["crc"]):
        raise ValueError("a block does not match its checksum")
    return out


# --- segments and files -----------------------------------------------------------------------------

BLOCK_TYPE = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("lanes", pa.int64()), ("stream", pa.binary()), ("states", pa.binary()), ("points", pa.binary()), ("crc", pa.int64())])
SEGMENTS = pa.schema(
    [("part", pa.int64()), ("segment", pa.int64()), ("table", pa.binary()), ("blocks", pa.list_(BLOCK_TYPE)), ("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64()))]
)
SEGMENTS_SQL = (
    "part long, segment long, table binary, blocks array<struct<at:long,n:long,lanes:long,stream:binary,states:binary,points:binary,crc:long>>,"
    " docs array<long>, lens array<long>"
)


def pack_table(freq: np.ndarray) -> bytes:
    used = np.flatnonzero(freq)
    head = np.array([len(freq), len(used)], "<u4").tobytes()
    return zlib.compress(head + np.diff(used, prepend=0).astype("<u2" if len(freq) <= 1 << 16 else "<u4").tobytes() + freq[used].astype("<u4").tobytes(), 1)


def open_table(packed: bytes) -> Table:
    raw = zlib.decompress(packed)
    size, used = np.frombuffer(raw, "<u4", 2).tolist()
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    freq = np.zeros(size, np.int64)
    freq[np.cumsum(np.frombuffer(raw, kind, used, 8).astype(np.int64))] = np.frombuffer(raw, "<u4", used, 8 + kind.itemsize * used)
    return Table(freq)


def _segment(part: int, serial: int, held: list[tuple[int | None, np.ndarray]], block: int) -> dict:
    ids = np.concatenate([a for _, a in held])
    freq = frequencies(np.bincount(ids))
    blocks = [{"at": at} | encode_block(ids[at : at + block], freq) for at in range(0, len(ids), block)]
    return {"part": part, "segment": serial, "table": pack_table(freq), "blocks": blocks, "docs": [d for d, _ in held], "lens": [len(a) for _, a in held]}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, block: int, segment: int) -> Iterator[pa.RecordBatch]:
    enc, part, serial = encoder(path), TaskContext.get().partitionId(), 0
    tail = enc.pack([end])
    held, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((doc, np.frombuffer(enc.encode(text.as_py()) + tail, enc.dtype)))
            size += len(held[-1][1])
            if size >= segment:
                yield pa.RecordBatch.from_pylist([_segment(part, serial, held, block)], schema=SEGMENTS)
                held, size, serial = [], 0, serial + 1
    if held:
        yield pa.RecordBatch.from_pylist([_segment(part, serial, held, block)], schema=SEGMENTS)


def write_ids(docs: DataFrame, path: str | None = None, end: int = END, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """The segments of docs (doc_id, text) in ascending doc_id order, written to the shared folder.

    Null ids come first; rows with one id are ordered by a hash of their text. part and segment order the segments."""
    path = path or default_path(BYTE_BPE)
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.mapInArrow(lambda it: _encode(it, path, end, block, segment), SEGMENTS_SQL), codec="uncompressed")


def combined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings put together, from theirs and the second one's size: size zero bytes are appended to
    the first by squaring the operator for one zero bit."""
    if not size:
        return first

    def times(m, v):
        out = 0
        for row in m:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    op = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):  # one zero byte
        op = [times(op, x) for x in op]
    while size:
        if size & 1:
            first = times(op, first)
        size >>= 1
        if size:
            op = [times(op, x) for x in op]
    return first ^ second


PIECES = pa.schema([(c, pa.int64()) for c in ("part", "segment", "doc", "doc_id", "at", "n", "crc", "whole")])
PIECES_SQL = "part long, segment long, doc long, doc_id long, at long, n long, crc long, whole long"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, segment, table, block, docs, lens) → what each block holds of each of its documents."""
    for b in batches:
        for i in range(b.num_rows):  # one block at a time is opened
            row = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
            ids = decode_block(row["block"], open_table(row["table"])).astype(WIDE)
            ends = np.cumsum(np.array(row["lens"], np.int64))
            begin = row["block"]["at"]
            first, last = np.searchsorted(ends, [begin, begin + len(ids) - 1], side="right")
            docs = np.arange(first, last + 1)
            high = np.minimum(ends[docs], begin + len(ids))
            start = ends[docs] - np.array(row["lens"], np.int64)[docs]
            low = np.maximum(start, begin)
            view = memoryview(ids).cast("B")
            crcs = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip((low - begin).tolist(), (high - begin).tolist())]
            whole = (low == start) & (high == ends[docs])
            n = len(docs)
            cols = [[row["part"]] * n, [row["segment"]] * n, docs, [row["docs"][d] for d in docs.tolist()], low, high - low, crcs, whole.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=PIECES)


def _joined_crc(pieces):
    """The CRC-32 of a document from its pieces in order: array<struct<at, n, crc>>."""

    @F.pandas_udf("long")
    def joined(found):
        import pandas as pd

        def one(rows):
            out = 0
            for r in rows:
                out = combined_crc(out, int(r["crc"]), 4 * int(r["n"]))
            return out

        return pd.Series([one(x) for x in found], dtype="int64")

    return joined(pieces)


def read_ids(segments: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, from decoded ids,
    block by block."""
    totals = segments.select("part", "segment", F.expr("aggregate(lens, 0L, (a, x) -> a + x)").alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))  # a row per written file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.withColumn("n", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("n") + F.col("base")).alias("begin"))
    blocks = segments.select("part", "segment", "table", F.explode("blocks").alias("block"), "docs", "lens")
    pieces = saved(blocks.mapInArrow(_decode, PIECES_SQL))
    # Only documents that cross a block's edge are put together: a row for each block they reach.
    parted = pieces.filter("whole = 0").groupBy("part", "segment", "doc").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))
    parted = parted.select("part", "segment", "doc_id", F.expr("p[0].at").alias("at"), F.expr("aggregate(p, 0L, (a, x) -> a + x.n)").alias("n"), _joined_crc("p").alias("crc"))
    decoded = pieces.filter("whole = 1").select("part", "segment", "doc_id", "at", "n", "crc").unionByName(parted)
    return decoded.join(begins, ["part", "segment"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """One row per row of docs: doc_id, start, n_tokens, ids_crc32, read back from the files.

    A null or empty text is its end id alone; a very long one counts whole. Rows that repeat a doc_id, and null ids (first), are documents of their
    own; other columns are ignored; an empty table gives no rows.
    """
    return read_ids(write_ids(docs, path, end))
