"""The near-duplicate stage of the pipeline: SimHash groups, then near copies of five-word Jaccard 0.8 or more.

SimHash over five-word shingles, linked through BK-trees, collapses copies that hardly differ. A radius on SimHash
fingerprints bounds no Jaccard likeness, though: at a likeness of 0.8 two 64-bit fingerprints differ in about ten bits,
and no exact search by bands or trees prunes at such a radius. So what is left is compared by the likeness itself, on
candidates from MinHash: HASHES minima of a text's shingle digests in BANDS bands; texts that agree on a whole band
share a bucket. A pair of likeness 0.8 shares none with probability (1 - 0.8 ** ROWS) ** BANDS = 2e-5. Every pair acted
on is verified on all its shingles, by digests of 32 bits.

Scale: fingerprint, bands and digests come from one pass over the texts; decisions move row keys and digests only.
Buckets are not turned into pairs: each text links to the first of its bucket, and the components of these links, which
no near copy leaves, are compared as wholes in one task each, by postings of shingles. A component of more than
MOST_SHINGLES is no task's: its buckets are gone through in rounds. In a round the first texts of a bucket (one, then two,
four, ...) meet the others, what is found to be a copy leaves all buckets, and the first texts, now compared, leave this
one; a group of n copies so costs n pairs a bucket, and a first text with many pairs is dealt into slots. Counts and first
texts of a bucket are found in two levels, so a bucket with many texts is not one task's. Texts are compared whole,
whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import LOWER, row_keys, saved, without

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 6, 36
HASHES = ROWS * BANDS
#: Shingles of the texts of a component that one task compares, at most.
MOST_SHINGLES = 2_000_000
#: Pairs that one copy of a first text is shipped for, at most.
SLOT = 256
#: Parts in which the first texts of a bucket are looked for.
PARTS = 64
SEED = 42
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Digests of the word shingles in order; a shorter text is one shingle, a blank one has none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """One digest for each band of the MinHash signature of digests."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 1024):  # 1.4 MB at a time
        low = np.minimum(low, (found[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(low.reshape(BANDS, ROWS))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k1, k2, text) → (doc_id, k1, k2, fp, n: distinct digests, bands, digests: sorted, four bytes each)."""
    for b in batches:
        prints, sizes, keys, kept = [], [], [], []
        for t in b.column(3):
            found = shingles(t.as_py())
            prints.append(simhash.majority(found))
            short = np.unique((found >> np.uint64(32)).astype("<u4"))
            sizes.append(len(short))
            keys.append(np.array(bands(short), np.uint64).view(np.int64) if len(short) else [])
            kept.append(short.tobytes())
        cols = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["doc_id", "k1", "k2", "fp", "n", "bands", "digests"])


def leaders(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """Whether each set stays: it does if its likeness to every set before it that stays is below least. Overlaps are
    counted over postings of the sets that stay."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(at, np.cumsum([len(s) for s in sets])[:-1])
    shared = np.bincount(at, minlength=len(values)) > 1  # digests that one set alone has overlap with nothing
    postings: dict[int, list[int]] = {}
    stays, sizes = np.zeros(len(sets), bool), np.array([len(s) for s in sets])
    for k, part in enumerate(parts):
        own = part[shared[part]].tolist()
        held = [p for v in own if (p := postings.get(v))]
        if held:
            both = np.bincount(np.concatenate(held), minlength=k)
            if (both >= least * (sizes[:k] + sizes[k] - both)).any():
                continue
        stays[k] = True
        for v in own:
            postings.setdefault(v, []).append(k)
    return stays


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, k1, k2, digests) in order of component and text → the keys of those that go."""
    root, held = None, []

    def gone():
        stays = leaders([np.frombuffer(d, "<u4") for _, _, d in held])
        lost = [r for r, s in zip(held, stays) if not s]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in lost], pa.int64()) for i in (0, 1)], names=["k1", "k2"])

    for b in batches:
        for r, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if r != root and held:
                yield gone()
                held = []
            root = r
            held.append(row)
    if held:
        yield gone()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = ([np.frombuffer(d.as_buffer(), "<u4") for d in b.column(i)] for i in (0, 1))
        keep = pa.array([likeness(p, q) >= LEAST for p, q in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (2, 3)], names=["k1", "k2"])


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose bucket holds another one, written."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return saved(rows.join(counts, "key", "left_semi"))


def _order():
    return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), "k1", "k2")


def near_rows(rows: DataFrame, gone: DataFrame | None = None, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(k1, k2) of rows that go: they are near copies of a row before them, by doc_id (null ids last), k1, k2.
    rows: doc_id, k1, k2, n, bands, digests; those in gone (k1, k2) take no part, and rows that repeat are one. No two near
    copies are left, and each that goes has a chain of near copies to one that stays. Texts without words are in no bucket
    and stay.

    What is joined here grows with the corpus, so it is shuffled at every size; digests move only to where their component
    is compared."""
    live = rows.filter("n > 0").select("k1", "k2", "bands")
    if gone is not None:
        live = live.join(gone.hint("merge"), ["k1", "k2"], "left_anti")
    spread = saved(live.select("k1", "bands")).select(F.explode("bands").alias("key"), "k1")
    firsts = spread.groupBy("key").agg(F.min("k1").alias("v"), F.max("k1").alias("w")).filter("v <> w").select("key", "v")
    links = spread.join(firsts.hint("merge"), "key").filter("k1 <> v").select(F.col("k1").alias("u"), "v").distinct()
    rooted = simhash.components(links).withColumnRenamed("node", "k1")
    rooted = saved(rooted.unionByName(rooted.select(F.col("root").alias("k1"), "root").distinct()))
    placed = rows.select("doc_id", "k1", "k2", "n", "digests").join(rooted.hint("merge"), "k1")
    placed = saved(placed.dropDuplicates(["k1", "k2"]))
    large = saved(placed.groupBy("root").agg(F.sum("n").alias("size")).filter(F.col("size") > most_shingles).select("root"))
    small = placed.join(large, "root", "left_anti").withColumn("o", _order())
    ordered = small.repartition("root").sortWithinPartitions("root", "o").select("root", "k1", "k2", "digests")
    lost = saved(ordered.mapInArrow(_compared, "k1 long, k2 long"))
    if large.isEmpty():
        return lost
    held = placed.join(large, "root", "left_semi")
    return lost.unionByName(_in_rounds(held.join(rows.select("k1", "k2", "bands").dropDuplicates(["k1", "k2"]), ["k1", "k2"])))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """near_rows for components that are no task's."""
    now = _shared(rows.select(F.explode("bands").alias("key"), "k1", "k2", _order().alias("o"), "n"))
    texts = saved(rows.select(F.struct("k1", "k2").alias("k"), "digests"))
    lost, most = rows.select("k1", "k2").limit(0), 1
    while not now.isEmpty():
        part = Window.partitionBy("key", F.pmod("k1", F.lit(PARTS))).orderBy("o")
        heads = now.withColumn("p", F.row_number().over(part)).filter(F.col("p") <= most)
        heads = heads.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy("o"))).filter(F.col("p") <= most)
        heads = saved(heads.select("key", F.struct("k1", "k2").alias("a"), F.col("o").alias("ao"), F.col("n").alias("m")))
        met = now.join(heads, "key").filter((F.col("ao") < F.col("o")) & (F.least("n", "m") >= LEAST * F.greatest("n", "m")))
        pairs = saved(met.select("a", F.struct("k1", "k2").alias("b")).distinct())
        slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots"))
        dealt = slots.join(texts.select(F.col("k").alias("a"), F.col("digests").alias("x")), "a")
        dealt = dealt.select("a", "x", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        others = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int")).drop("slots")
        others = others.join(texts.select(F.col("k").alias("b"), F.col("digests").alias("y")), "b")
        ready = others.join(dealt, ["a", "slot"]).select("x", "y", "b.k1", "b.k2")
        gone = saved(ready.mapInArrow(_alike, "k1 long, k2 long").distinct())
        lost = lost.unionByName(gone)
        now = _shared(now.join(heads.select("key", "a.k1", "a.k2"), ["key", "k1", "k2"], "left_anti").join(gone, ["k1", "k2"], "left_anti"))
        most *= 2
    return lost


def deduplicated(docs: DataFrame, radius: int = simhash.RADIUS, tree_nodes: int = simhash.TREE_NODES) -> DataFrame:
    """docs without all but the first row of each SimHash group (five-word shingles), and without near copies of a row
    before them among what is left. First is the smallest doc_id; null ids come last, then by a hash.

    Of null and blank texts one stays; rows that repeat go but for one; an empty table gives no rows; columns may have
    any names and pass through."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 long, k2 long, fp long, n int, bands array<long>, digests binary"
    marks = saved(docs.select("doc_id", *row_keys(), "text").mapInArrow(_marked, schema))
    alike = saved(simhash.lost_rows(marks.select("doc_id", "k1", "k2", "fp"), radius, tree_nodes))
    lost = alike.unionByName(near_rows(marks, alike))
    return without(simhash.first_of_repeats(docs, simhash.repeats(marks)), saved(lost.distinct()).hint("merge"))
