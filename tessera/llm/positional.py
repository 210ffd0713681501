"""Benchmark decontamination through a distributed positional inverted index.

The training text is cut into blocks of whole documents. Each block is one index row: its sorted terms,
and per term the ascending word positions at which it stands (the posting list); documents follow each
other with a gap, so no phrase crosses from one into the next. Nothing in building the index needs a
shuffle, its size follows the text, and it is written once to the shared folder.

A search takes one index block at a time. Phrases are listed under one of their terms, the one that the
fewest phrases hold, so a block looks only at phrases whose listed term it holds; the posting lists of a
phrase's terms, each shifted by the term's offset in the phrase, are intersected from the rarest in the
block onwards. Phrases reach the blocks in chunks of at most CHUNK_PHRASES, an item's phrases in several
chunks where need be, so what is sent to the executors at once is bounded whatever the size of the
benchmark or of one item; each chunk is one pass over the (small) index, not over the text. A row of the
index is known by its block and its place there, so results of several chunks are put together per row;
with one chunk they are put together already, and that step would change nothing.

Texts and items are read whole, however long: a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, saved, without

WINDOW = 10
#: Words of one index block; a longer document is a block of its own.
BLOCK_WORDS = 400_000
#: Most phrases sent to the executors at once.
CHUNK_PHRASES = 200_000
#: Bytes that are not part of a word become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def windows(text: str | None, size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """The distinct phrases of an item: each run of size words, or all its words if it has fewer."""
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _block(name: str, held: list[tuple[object, list[bytes]]], gap: int) -> dict:
    flat = [w for _, ws in held for w in ws]
    lens = np.array([len(ws) for _, ws in held], np.int64)
    starts = np.concatenate(([0], np.cumsum(lens + gap)))
    at = np.arange(len(flat)) + np.repeat(np.arange(len(held)) * gap, lens)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    order = np.argsort(ids, kind="stable")
    return {
        "block": name,
        "terms": b" ".join(number),
        "counts": np.bincount(ids, minlength=len(number)).astype(np.int32).tobytes(),
        "positions": at[order].astype(np.int32 if starts[-1] < 2**31 else np.int64).tobytes(),
        "starts": starts.tobytes(),
        "rows": [r for r, _ in held],
    }


def _index(batches: Iterator[pa.RecordBatch], gap: int, block_words: int) -> Iterator[pa.RecordBatch]:
    import uuid

    name, serial, held, size, schema = uuid.uuid4().hex, 0, [], 0, None
    for b in batches:
        binary = ((c, pa.binary()) for c in ("terms", "counts", "positions", "starts"))
        schema = pa.schema([("block", pa.string()), *binary, ("rows", pa.list_(b.schema.field(0).type))])
        for row, text in zip(b.column(0).to_pylist(), b.column(1)):
            w = words(text.as_py())
            if held and size + len(w) > block_words:
                yield pa.RecordBatch.from_pylist([_block(f"{name}-{serial}", held, gap)], schema=schema)
                serial, held, size = serial + 1, [], 0
            held.append((row, w))
            size += len(w)
    if held:
        yield pa.RecordBatch.from_pylist([_block(f"{name}-{serial}", held, gap)], schema=schema)


def build_index(docs: DataFrame, key: str | Column = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The positional index of docs.text, one row per block; key, of any type, comes back with a row's matches."""
    slim = docs.select((F.col(key) if isinstance(key, str) else key).alias("key"), "text")
    kind = slim.schema["key"].dataType.simpleString()
    schema = f"block string, terms binary, counts binary, positions binary, starts binary, rows array<{kind}>"
    return saved(slim.mapInArrow(lambda it: _index(it, window, block_words), schema))


class Postings:
    """One block of the index, opened."""

    def __init__(self, row: dict):
        terms = row["terms"].split(b" ") if row["terms"] else []
        counts = np.frombuffer(row["counts"], np.int32)
        self.ends = np.cumsum(counts)
        self.number = dict(zip(terms, range(len(terms))))
        starts = np.frombuffer(row["starts"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32 if starts[-1] < 2**31 else np.int64)
        self.starts, self.rows = starts, row["rows"]
        self.counts = counts

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.counts[term] : self.ends[term]]

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the phrase begins, from its rarest term in this block onwards."""
        get = self.number.get
        ids = []
        for t in terms:
            if (i := get(t)) is None:
                return np.empty(0, np.int64)
            ids.append(i)
        found = None
        for offset in sorted(range(len(ids)), key=lambda k: self.counts[ids[k]]):
            here = self.postings(ids[offset])
            if found is None:
                found = here.astype(np.int64) - offset
            else:
                spot = np.searchsorted(here, found + offset)
                found = found[(spot < len(here)) & (here[np.minimum(spot, len(here) - 1)] == found + offset)]
            if not len(found):
                break
        return found

    def near(self, terms: tuple[bytes, ...], span: int) -> np.ndarray:
        """Positions of the rarest term around which every other term stands within span words, inside one document."""
        ids = [self.number.get(t) for t in dict.fromkeys(terms)]
        if not ids or None in ids:
            return np.empty(0, np.int64)
        ids.sort(key=lambda i: self.counts[i])
        found = self.postings(ids[0]).astype(np.int64)
        doc = np.searchsorted(self.starts, found, side="right") - 1
        low, high = np.maximum(found - span, self.starts[doc]), np.minimum(found + span, self.starts[doc + 1] - 1)
        ok = np.ones(len(found), bool)
        for i in ids[1:]:
            here = self.postings(i)
            ok &= np.searchsorted(here, low) < np.searchsorted(here, high, side="right")
        return found[ok]


def _listed(phrases: list[tuple[tuple[bytes, ...], list[str]]]) -> dict[bytes, list[int]]:
    """The numbers of the phrases under the term of each that the fewest phrases hold."""
    held = Counter(t for terms, _ in phrases for t in set(terms))
    out: dict[bytes, list[int]] = {}
    for k, (terms, _) in enumerate(phrases):
        out.setdefault(min(terms, key=held.__getitem__), []).append(k)
    return out


def _find(batches: Iterator[pa.RecordBatch], sent, gap: int, span: int | None) -> Iterator[pa.RecordBatch]:
    """sent: phrases [(terms, [item, ...])] and the list of them by term. One row per indexed row: its block and place
    there, its key, its words, the spans (start, end) of hits, merged, and the items."""
    phrases, listed = sent
    for b in batches:
        schema = pa.schema([("block", pa.string()), ("place", pa.int32()), ("key", b.schema.field("rows").type.value_type), *FOUND])
        for row in b.to_pylist():
            block = Postings(row)
            begins, ends, owner = [], [], []
            for term in listed.keys() & block.number.keys():
                for k in listed[term]:
                    terms = phrases[k][0]
                    at = block.phrase(terms) if span is None else block.near(terms, span)
                    if len(at):
                        begins.append(at)
                        ends.append(at + (len(terms) if span is None else 1))
                        owner.append(np.full(len(at), k))
            n = len(block.rows)
            lens = np.diff(block.starts) - gap
            out = {"block": [row["block"]] * n, "place": list(range(n)), "key": block.rows, "n_words": lens.tolist(), "spans": [[] for _ in range(n)], "items": [[] for _ in range(n)]}
            if begins:
                begin, end, own = np.concatenate(begins), np.concatenate(ends), np.concatenate(owner)
                order = np.argsort(begin, kind="stable")
                begin, end, own = begin[order], end[order], own[order]
                doc = np.searchsorted(block.starts, begin, side="right") - 1
                for d in np.unique(doc):
                    a, z = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
                    merged: list[list[int]] = []
                    for s, e in zip((begin[a:z] - block.starts[d]).tolist(), (end[a:z] - block.starts[d]).tolist()):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    out["spans"][d] = [{"start": s, "end": e} for s, e in merged]
                    out["items"][d] = sorted({i for k in np.unique(own[a:z]) for i in phrases[k][1]})
            yield pa.RecordBatch.from_pydict(out, schema=schema)


FOUND = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
FOUND_SQL = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _chunks(items: DataFrame, window: int, chunk: int) -> Iterator[list]:
    """The phrases of the items, at most chunk of them at a time; one item after another is read on the driver."""
    held: dict[tuple[bytes, ...], set[str]] = {}
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        w = words(r["text"])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            held.setdefault(tuple(w[i : i + window]), set()).add("" if r["i"] is None else r["i"])
            if len(held) >= chunk:
                yield [(w, sorted(s)) for w, s in held.items()]
                held = {}
    yield [(w, sorted(s)) for w, s in held.items()]


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, chunk: int = CHUNK_PHRASES) -> DataFrame:
    """One row per indexed row: key, n_words, spans (merged word ranges of phrase occurrences) and items (ids, as strings,
    sorted, that have a phrase there). With span, terms need only stand within span words of the phrase's rarest term, in
    any order, and spans hold that term's positions."""
    sc = index.sparkSession.sparkContext
    schema = f"block string, place int, key {index.schema['rows'].dataType.elementType.simpleString()}, {FOUND_SQL}"
    parts = []
    for phrases in _chunks(items, window, chunk):
        sent = sc.broadcast((phrases, _listed(phrases)))
        parts.append(index.mapInArrow(lambda it, sent=sent: _find(it, sent.value, window, span), schema))
    if len(parts) == 1:
        return parts[0].drop("block", "place")
    merge = F.expr(
        "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:long,end:long>>), (a, s) ->"
        " if(size(a) > 0 and s.start <= element_at(a, -1).end, concat(slice(a, 1, size(a) - 1),"
        " array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))), concat(a, array(s))))"
    )
    found = reduce(DataFrame.unionByName, parts).groupBy("block", "place").agg(
        F.first("key").alias("key"), F.max("n_words").alias("n_words"), merge.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return found.drop("block", "place")


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk: int = CHUNK_PHRASES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window),
    n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated.

    Null and blank texts have no words and no hits; an item without words has no windows; items that repeat an
    id count once; a null item id counts as the empty string. Rows that repeat a doc_id, and null ids, keep a row
    each. Very long texts and items count whole. An empty benchmark hits nothing; an empty table gives no rows. Other
    columns are ignored.
    """
    found = matches(build_index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", window), items, window, None, chunk)
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk: int = CHUNK_PHRASES) -> DataFrame:
    """docs without the rows in which a window of an item occurs. Rows are known by doc_id and text together, so a
    repeated or null doc_id never takes another row with it. Null and blank texts stay, as does every row if the benchmark
    is empty; rows that repeat stay or go together; columns may have any names; an empty table gives no rows."""
    index = build_index(docs.select(F.struct(*row_keys()).alias("k"), "text"), "k", window)
    found = matches(index, items, window, None, chunk)
    return without(docs, saved(found.filter(F.size("spans") > 0).select("key.k1", "key.k2").distinct()))
