"""SimHash near-duplicates, linked through BK-trees.

A document's fingerprint is the 64-bit majority vote over the XXH64 hashes of its word shingles.
Fingerprints at Hamming distance <= radius are linked and connected components are the classes.

Scale: equal fingerprints collapse to one node first, so groups of exact copies cost one node.
Nodes are sharded by what any linked pair must share: cut into radius + 2 bands, two fingerprints
at distance <= radius agree on at least two bands, so a node goes to one shard per pair of bands
(six for radius 2, 32 equal bits each). Every shard holds a BK-tree of its own. A shard of more than
TREE_NODES is cut the same way once more, over the bits its nodes need not share: for radius 2 a node goes
to six shards of 48 equal bits, which cannot hold more than 65,536 fingerprints whatever the corpus, so a
node is never in more than 36 trees. Trees are shipped to the nodes of their shard by the shuffle, not
broadcast to every executor: the trees of all shards together grow with the corpus, and a broadcast must
not. A shard emits a spanning forest (fewer edges than nodes), never its pairs. Components come from
alternating star contraction on written tables, round by round until nothing changes.

Texts are read whole, however long: the hashes of one text are held, its votes added in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, row_keys, saved, without

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Most nodes of a shard that is not cut again.
TREE_NODES = 20_000
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; null, empty and blank texts give zero."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero of none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, column: str = "fp") -> DataFrame:
    """docs plus the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def signed(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), dtype="int64")

    return docs.withColumn(column, signed(F.col("text")))


# --- BK-trees ---------------------------------------------------------------------------------------


def build_tree(values: list[int]) -> tuple[list[int], list[dict[int, int]]]:
    """Distinct unsigned fingerprints as a BK-tree: node values and, per node, {distance to it: child}."""
    nodes, children = [], []
    for v in values:
        if nodes:
            at = 0
            while True:
                d = (nodes[at] ^ v).bit_count()
                if d == 0:
                    break
                step = children[at].get(d)
                if step is None:
                    children[at][d] = len(nodes)
                    nodes.append(v)
                    children.append({})
                    break
                at = step
        else:
            nodes.append(v)
            children.append({})
    return nodes, children


def search_tree(tree: tuple[list[int], list[dict[int, int]]], queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, indexes of the queries within the radius): all queries descend together and follow only
    edges whose distance lies within the radius of their own distance to the parent."""
    nodes, children = tree
    stack = [(0, np.arange(len(queries)))] if nodes else []
    while stack:
        at, who = stack.pop()
        d = np.bitwise_count(queries[who] ^ np.uint64(nodes[at]))
        near = who[d <= radius]
        if len(near):
            yield at, near
        for edge, child in children[at].items():
            go = who[(d >= edge - radius) & (d <= edge + radius)]
            if len(go):
                stack.append((child, go))


def spanning_edges(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct values of a shard, as (value, smallest value of its class)."""
    parent = np.arange(len(values))

    def roots(i):
        r = parent[i]
        while not np.array_equal(nxt := parent[r], r):
            r = nxt
        parent[i] = r
        return r

    for node, near in search_tree(build_tree(values.tolist()), values, radius):
        r = roots(np.append(near, node))
        parent[r] = r.min()
    roots(np.arange(len(values)))
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return values[linked], values[parent[linked]]


def _shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp) sorted by both → spanning edges; a shard is handled when its last row has come."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(parts):
        key, fp = (np.concatenate(c) for c in zip(*parts))
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        found = [spanning_edges(np.unique(fp[a:b]), radius) for a, b in zip([0, *cut], [*cut, len(key)]) if b - a > 1]
        if found:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found)], names=["u", "v"])

    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        change = np.flatnonzero(key[1:] != key[:-1])
        last = int(change[-1]) + 1 if len(change) else 0
        if held and (last or held[-1][0][-1] != key[0]):
            if (out := flush([*held, (key[:last], fp[:last])])) is not None:
                yield out
            held = []
        elif last and (out := flush([(key[:last], fp[:last])])) is not None:
            yield out
        held.append((key[last:], fp[last:]))
    if held and (out := flush(held)) is not None:
        yield out


def _pair_keys(head: list, bits, size: int, parts: int):
    """Keys of what fingerprints share if they agree on two of so many parts of a value of size bits."""
    width = size // parts
    cut = [F.shiftrightunsigned(bits, i * width).bitwiseAND((1 << (width if i < parts - 1 else size - width * (parts - 1))) - 1) for i in range(parts)]
    return F.array(*[F.xxhash64(*head, F.lit(i * parts + j), cut[i], cut[j]) for i, j in combinations(range(parts), 2)])


def near_edges(nodes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Spanning links (u, v) among the distinct fingerprints in nodes.fp, at distance <= radius."""
    bands = radius + 2
    width = BITS // bands
    spread = nodes.select("fp", F.posexplode(_pair_keys([], F.col("fp"), BITS, bands)).alias("pair", "key"))
    counted = spread.join(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
    shards = counted.filter(F.col("n") <= tree_nodes).select("key", "fp")
    if radius:
        # The bits outside the two shared bands (a last, wider band is cut to the common width), side by side.
        rests = []
        for i, j in combinations(range(bands), 2):
            free = [b for b in range(bands) if b not in (i, j)]
            parts = [F.shiftleft(F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1), k * width) for k, b in enumerate(free)]
            rests.append(reduce(lambda a, b: a.bitwiseOR(b), parts))
        hot = counted.filter(F.col("n") > tree_nodes).withColumn("rest", F.element_at(F.array(*rests), F.col("pair") + 1))
        again = _pair_keys([F.col("key")], F.col("rest"), radius * width, bands)
        shards = shards.unionByName(hot.select(F.explode(again).alias("key"), "fp"))
    ordered = shards.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(lambda it: _shards(it, radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with links; alternating large
    and small stars, one written table a round, until nothing changes."""

    def measure(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    seen = measure(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = saved(small.select("e.u", F.col("e.m").alias("v")).filter("u != v").distinct())
        was, seen = seen, measure(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(fingerprints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, component_id): for each distinct fp of (doc_id, fp) rows the smallest doc_id of its component."""
    nodes = saved(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_edges(nodes, radius, tree_nodes))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null and blank texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id
    each keep their row. Null ids take part with their text and get the smallest id that is not null, or
    null if their component has none. Very long texts count whole. Other columns are ignored; an empty table gives
    no rows.
    """
    prints = saved(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    found = classes(prints, radius, tree_nodes)
    return prints.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def lost_rows(marks: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(k1, k2) of all but one row of each component of marks (doc_id, k1, k2, fp): the row with the smallest doc_id
    (null ids last, then by k1 and k2) stays."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("k1").alias("c"), F.col("k2").alias("d"))
    nodes = saved(marks.groupBy("fp").agg(F.min(order).alias("best")))
    roots = components(near_edges(nodes, radius, tree_nodes))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("best", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.c").alias("k1"), F.col("best.d").alias("k2"))
    return marks.select("k1", "k2").join(kept, ["k1", "k2"], "left_anti").distinct()


def repeats(marks: DataFrame) -> DataFrame:
    """(k1, k2) of rows that repeat both doc_id and text."""
    return saved(marks.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2"))


def first_of_repeats(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with one row of those that repeat both doc_id and text, given by again. Other rows are not shuffled."""
    if again.isEmpty():
        return docs
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *row_keys())
    single = packed.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("r").alias("r"))
    return without(docs, again).unionByName(single.select("r.*"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """docs without all but one row of each component: the row with the smallest doc_id (null ids last) stays, and one of
    rows that repeat it whole. Null and blank texts are one component. An empty table gives no rows; columns may have
    any names. Decisions are made on fingerprints and row keys alone; texts move once, to leave the lost rows out."""
    marks = saved(with_fingerprint(docs.select("doc_id", *row_keys(), "text"), shingle).select("doc_id", "k1", "k2", "fp"))
    return without(first_of_repeats(docs, repeats(marks)), saved(lost_rows(marks, radius, tree_nodes)).hint("merge"))
