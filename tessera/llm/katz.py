"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

With h the words before w, up to order - 1 of them or to the document's start, and h' the same without the first:
P(w | h) = d(c) c(h w) / c(h) where the gram was seen, else a(h) P(w | h'); P(w) = d(c) c(w) / N where the word was
seen, else the mass that is left, given to one unknown word. d is Good-Turing's discount for counts up to 5, one set a
level; a(h) makes the probabilities after h sum to one over the vocabulary and the unknown word, and is 1 where h was
not seen.

Counting and scoring work by messages between blocks of documents and buckets of words or grams, all of them numpy
arrays in Parquet rows in the shared folder:

  1. blocks    a block of whole documents becomes local word numbers and a local vocabulary with training counts
  2. words     buckets by word hash sum counts and number the words: the unigram table, and an answer to each block
  3. grams     for each level from 2 on, blocks send distinct grams to buckets by context, which sum them: the level's
               counts, what each context needs for its weight, and each block's counts in answer. Contexts are named by
               the number the level below gave them; only grams whose context and whose end were seen are sent
  4. weights   for each level, what the buckets know of a context is summed in the bucket that holds it: the backoff
               weight, sent to blocks
  5. scores    a block looks up each token's longest gram, backs off level by level where it must, sums by document

A word or gram that only one block mentions is alone: the bucket says so, and the block keeps the grams that follow it or
end in it to itself, since no other block can have them. It counts them, adds them to the counts of counts and finds the
weights of lone contexts on its own. Of a gram that is alone by its end, after a shared context, it sends what that
context's weight needs, the two counts, and no word, and is sent nothing back. Other grams after shared contexts are sent.

What the words after a context weigh one level lower travels as whole numbers: how many of them have which count there.
Whoever finds a weight has the discounts and the divisor, so sums are exact whatever their order.

The blocks are a table bucketed by key, so that each step deals out the answers alone and reads blocks where they lie.

Scale: a block pre-aggregates its counts, so a word or bigram that a third of all tokens have is one entry per
block; a context with many tokens is dealt to several buckets by its next word, and the weights step adds them
up. Blocks and buckets are of bounded size, their numbers follow the corpus, and so do the partitions they are
dealt to, so a task's input does not grow. Messages are one row for a block and a bucket: their bytes follow the
corpus, their number its square, which bounds the corpus that blocks and buckets of a given size suit; larger
corpora need larger ones (both are parameters). The driver sees only counts of counts and totals.

A text of any length is read whole; one longer than a block is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, id_bucket, saved

FOLD, HELD_OUT = 5, 1
#: Words of the longest grams.
ORDER = 3
#: Largest count that is discounted.
CUT = 5
#: Tokens of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1_500_000
#: Words that blocks name, and grams of a level that blocks send, of one bucket, about.
BUCKET_WORDS, BUCKET_GRAMS = 400_000, 1_200_000
#: Tokens of a context from which on it is dealt to one more bucket.
HOT_CONTEXT = 1_000_000
#: Tokens up to which contexts are dealt to buckets by stripes of so many bits of their names: at most 65,536 tokens each.
RARE, STRIPE = 64, 10
END, START = b"\n", b"\t"  # no word holds white space

ROW = "key long, sub long, kind int, a binary, b binary, c binary"
ROWS = pa.schema([("key", pa.int64()), ("sub", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed text: per array its type and size, then its bytes, those of equal significance together,
    since the high ones are mostly zero."""
    head = ";".join(f"{x.dtype.str}{x.size}" for x in arrays).encode()
    planes = (np.ascontiguousarray(x).view("u1").reshape(-1, x.dtype.itemsize).T.tobytes() if x.size else b"" for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def _get(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    size = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + size
    for part in raw[4:at].decode().split(";"):
        kind, n = np.dtype(part[:3]), int(part[3:])
        planes = np.frombuffer(raw, "u1", n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text, and their number; a text without words has one empty word, which does not count."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.list_element(lists, 0), "").to_numpy(zero_copy_only=False)
    return lists, np.where(blank, 0, sizes)


def _listed(words: pa.Array) -> list[bytes]:
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1].tolist(), words.buffers()[2]
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(offsets, offsets[1:])]


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for bits, t in ((8, "u1"), (16, "<u2"), (32, "<u4"), (64, "<u8")) if most < 1 << bits))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ROWS)], schema=ROWS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of batches sorted by key."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def _per_key(df: DataFrame, work: Callable, n: int) -> DataFrame:
    """work(key, rows) → output rows, for the rows of each key together, ordered by kind and sub."""

    def run(batches):
        for key, rows in _groups(batches):
            for out in work(key, rows):
                yield _batch([out])

    return df.repartition(n, "key").sortWithinPartitions("key", "kind", "sub").mapInArrow(run, ROW)


# --- blocks -----------------------------------------------------------------------------------------


def _block(key: int, held: list[tuple[int | None, bool, int]], texts: list[pa.Array]) -> tuple:
    """One row: a: token numbers and document lengths, b: the local vocabulary and its training counts, c: ids, whether each
    is for training, whether its id is null, whether held-out documents have the word, what deals the word to a bucket.
    held: id, whether for training and number of words of each document; texts: their words."""
    flat = [x.filter(pc.not_equal(x, "")) for x in (x.flatten() for x in texts)]
    coded = pa.chunked_array(flat).dictionary_encode()
    number = [START, END, *(_listed(coded.chunks[-1].dictionary) if coded.num_chunks else [])]
    lens = np.array([n + 1 for _, _, n in held], np.int64)
    word = np.ones(lens.sum(), bool)
    word[np.cumsum(lens) - 1] = False
    ids = np.ones(len(word), np.int64)
    ids[word] = np.concatenate([np.zeros(0, np.int64), *(x.indices.to_numpy() for x in coded.chunks)]) + 2
    train = np.array([t for _, t, _ in held], bool)
    counts = np.bincount(ids[np.repeat(train, lens)], minlength=len(number))
    counts[0] = train.sum()  # the start is a context, not a token
    other = np.bincount(ids[~np.repeat(train, lens)], minlength=len(number)) > 0
    other[0] = not train.all()
    docs = np.array([d or 0 for d, _, _ in held], np.int64)
    null = np.array([d is None for d, _, _ in held], "<u1")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)).astype("<u2")
    vocabulary, packed = zlib.compress(b" ".join(number), 1), _put(_narrow(counts))
    return key, 0, 0, _put(_narrow(ids), _narrow(lens)), len(packed).to_bytes(4, "little") + packed + vocabulary, _put(docs, train.astype("<u1"), null, other.astype("<u1"), hashes)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    import uuid

    held, texts, size = [], [], 0
    for b in batches:
        lists, sizes = _words(b.column(2))
        start = 0
        for i, (doc, train, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sizes.tolist())):
            if held and size + n >= most:
                yield _batch([_block(uuid.uuid4().int >> 65, held, [*texts, lists[start:i]])])
                held, texts, size, start = [], [], 0, i
                pa.default_memory_pool().release_unused()  # a worker lives on
            held.append((doc, train, n))
            size += n + 1
        texts.append(lists[start:])
    if held:
        yield _batch([_block(uuid.uuid4().int >> 65, held, texts)])
        del held, texts
        pa.default_memory_pool().release_unused()


# --- words ------------------------------------------------------------------------------------------


def _send_words(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per block and word bucket: key the bucket, sub the block, a which of them held-out documents have, b the words, c their counts."""
    for b in batches:
        for key, _, _, _, vocabulary, c in zip(*(x.to_pylist() for x in b.columns)):
            cut = 4 + int.from_bytes(vocabulary[:4], "little")
            words = zlib.decompress(vocabulary[cut:]).split(b" ")
            (counts,) = _get(vocabulary[4:cut])
            _, _, _, other, hashes = _get(c)
            where = hashes.astype(np.int64) % n
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(n + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                mine = order[edges[k] : edges[k + 1]]
                rows.append((int(k), key, 0, _put(np.packbits(other[mine])), zlib.compress(b" ".join([words[i] for i in mine.tolist()]), 1), _put(counts[mine])))
            if rows:
                yield _batch(rows)


def _sum_words(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    """kind 1: the bucket's words and counts, most frequent first; kind 2: for each block the counts and numbers in the
    bucket of its words that are not alone, and which are, and what the block says of held-out documents, for the weights."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    asked = []
    for _, block, _, other, words, c in rows:
        ws = zlib.decompress(words).split(b" ")
        asked.append((block, other, np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), _get(c)[0].astype(np.int64)))
    total, blocks = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for _, _, ids, counts in asked:  # a block names a word once
        total[ids] += counts
        blocks[ids] += 1
    order = np.argsort(-total, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    listed = list(number)
    listed = [listed[i] for i in order.tolist()]
    special = np.array([w == START for w in listed], "<u1")
    yield bucket, 0, 1, b"", zlib.compress(b" ".join(listed), 1), _put(_narrow(total[order]), special)
    for block, other, ids, _ in asked:
        alone = blocks[ids] == 1
        yield block, bucket, 2, other, b"", _put(_narrow(total[ids[~alone]]), _narrow(back[ids[~alone]]), np.packbits(alone))


# --- discounts --------------------------------------------------------------------------------------


def discounts(counts_of_counts: list[int], cut: int = CUT) -> np.ndarray:
    """Good-Turing discounts for counts 1 to cut (the first number is that of count 1; cut + 1 numbers). Where the counts
    of counts don't allow them (a discount not between 0 and 1), the cut is lowered; with none left nothing is discounted."""
    n = [0, *counts_of_counts]
    for k in range(cut, 0, -1):
        if any(n[r] <= 0 for r in range(1, k + 2)):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else -1.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array(d + [1.0] * (cut - k))
    return np.ones(cut)


class Unigrams:
    """P(w) by a word's count, and the unknown word's probability."""

    def __init__(self, counts_of_counts: list[int], total: int):
        self.total, d = total, discounts(counts_of_counts)
        lost = sum((1 - x) * r * n for r, (x, n) in enumerate(zip(d, counts_of_counts), 1))
        self.scale = 1.0 / total if lost > 0 else 1.0 / (total + 1)
        self.unknown = lost / total if lost > 0 else 1.0 / (total + 1)
        self.discount = d

    def probability(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.int64)
        factor = np.concatenate(([0.0], self.discount))[np.minimum(c, len(self.discount))]
        return np.where(c == 0, self.unknown, np.where(c > len(self.discount), 1.0, factor) * c * self.scale)


# --- grams ------------------------------------------------------------------------------------------


class Plan:
    """What every block and bucket must know: the numbers of buckets, and what is known of each level so far."""

    def __init__(self, words: int, buckets: list[int], hot: int):
        self.words, self.buckets, self.hot, self.order = words, buckets, hot, len(buckets) - 1
        self.unigrams, self.discounts = Unigrams([0] * (CUT + 1), 0), {}

    def direct(self, level: int, counts: np.ndarray, divisors: np.ndarray) -> np.ndarray:
        """The probability of grams of a level (2 or more) that were seen."""
        factor = np.concatenate(([0.0], self.discounts[level], [1.0]))[np.minimum(counts, CUT + 1)]
        return factor * counts / np.maximum(divisors, 1)

    def home(self, level: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that hold contexts of grams of a level, and their numbers there. Words are named so that frequent
        ones come first whatever their bucket, which makes steps between them short."""
        return (names % self.words, names // self.words) if level == 2 else (names >> 36, names & ((1 << 36) - 1))

    def mass(self, level: int, lower: np.ndarray) -> np.ndarray:
        """What the words after contexts of a level weigh one level lower, before it is divided by that level's divisor (at
        level 2 by all): lower[r - 1] of them have the count r there, those with larger counts the counts in the last row."""
        discount = self.unigrams.discount if level == 2 else self.discounts[level - 1]
        return np.append(discount * np.arange(1, CUT + 1), 1.0) @ lower


def _answer(level: int) -> int:
    """The kind of a bucket's answers to blocks; one more is that of weights of its contexts."""
    return 5 + 10 * (level - 2)


class Units:
    """The distinct grams of one level in a block: global counts, names and, as contexts, weights; whether no other block
    has them; and for each token the place of the gram that ends there, -1 where there is none or it cannot have been seen."""

    def __init__(self, n: int, place: np.ndarray, other: np.ndarray, contexts: bool = True):
        self.other = other  # held-out documents have the gram: only there does a context need its weight
        self.place, self.count, self.alone = place, np.zeros(n, np.int64), np.zeros(n, bool)
        if contexts:  # the longest grams are none
            self.name = np.arange(n) + (1 << 60)  # lone ones keep this, which follows all others
            self.weight, self.plus = np.ones(n), np.zeros(n, "u1")


class Opened:
    """A block with what it has been answered. rows: kind 0 the block, kind 2 the answers of word buckets, and of each
    level up to `level` the answers of its buckets and the weights of its contexts, where there are any yet."""

    def __init__(self, rows: list[tuple], plan: Plan, level: int):
        (own,) = [r for r in rows if r[2] == 0]
        self.plan, self.held = plan, {}
        for r in rows:
            self.held.setdefault(r[2], []).append(r)
        ids, self.lens = (x.astype(np.int64) for x in _get(own[3]))
        self.docs, train, null, other, hashes = _get(own[5])
        self.train, self.null = train.astype(bool), null.astype(bool)
        self.first = np.concatenate(([0], np.cumsum(self.lens)[:-1]))
        self.trained = np.repeat(self.train, self.lens)
        where = hashes.astype(np.int64) % plan.words
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(plan.words + 1))
        unit = Units(len(hashes), ids, other.astype(bool))
        unit.count = np.bincount(ids[self.trained], minlength=len(hashes))
        unit.count[0] = self.train.sum()
        for _, bucket, _, _, _, c in self.held.get(2, []):
            mine = order[edges[bucket] : edges[bucket + 1]]
            counts, index, alone = _get(c)
            unit.alone[mine] = np.unpackbits(alone, count=len(mine))
            mine = mine[~unit.alone[mine]]
            unit.count[mine], unit.name[mine] = counts, index.astype(np.int64) * plan.words + bucket
        self._weigh(unit, order, edges, 2)
        # From here on words are numbered in the order of their names.
        order = np.argsort(unit.name)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        for x in ("other", "name", "count", "weight", "plus", "alone"):
            setattr(unit, x, getattr(unit, x)[order])
        self.ids = unit.place = back[ids].astype(np.int32)
        self.start = back[0]
        self.units = {1: unit}
        self.sent = {}
        for k in range(2, level + 1):
            self._level(k)
        del self.held

    def _weigh(self, unit: Units, order: np.ndarray, edges: np.ndarray, k: int) -> None:
        """The weights of shared contexts of the grams of level k, from what their buckets know of them."""
        for _, bucket, _, _, _, c in self.held.get(_answer(k) + 1, []):
            mine = order[edges[bucket] : edges[bucket + 1]]
            mine = mine[(unit.count[mine] > 0) & ~unit.alone[mine]]
            *known, unit.plus[mine] = _get(c)
            mine = mine[unit.other[mine]]
            known = np.stack(known)
            mass = self.plan.mass(k, known[CUT:])
            if k == 2:
                mass = mass * self.plan.unigrams.scale
            else:
                shorter, e = self.units[k - 2], self.sent[k - 1][2][mine]
                mass = mass / (shorter.count[e] + shorter.plus[e])
            unit.weight[mine], _ = weights(unit.count[mine], known[:CUT], mass, self.plan.discounts[k])

    def before(self, level: int) -> np.ndarray:
        """For each token the place of the gram of a level that ends before it, -1 where there is none."""
        out = np.empty_like(self.ids)
        out[1:] = self.units[level].place[:-1]
        out[self.first] = self.start if level == 1 else -1
        return out

    def _level(self, k: int) -> None:
        """Distinct grams of level k, ordered by bucket, context and word, those that are alone by context or end last: those whose
        context and whose end, both of level k - 1, were seen in training; no other can have been. Places of level k - 1
        rise with the names that buckets gave, so the order of places is that of names."""
        below = self.units[k - 1]
        context, end = self.before(k - 1), below.place
        able = np.ones(len(end), bool) if k == 2 else (context >= 0) & (end >= 0)
        if k > 2:
            able[able] = (below.count[context[able]] > 0) & (below.count[end[able]] > 0)
        at = np.flatnonzero(able)
        size = len(self.units[1].name)
        key, by = _sorted(context[at].astype(np.int64) * size + self.ids[at])
        del context
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        place = np.empty(len(by), np.int32)
        place[by] = np.cumsum(new) - 1
        distinct = key[first]
        v = distinct // size
        w = (distinct - v * size).astype(np.int32)
        v = v.astype(np.int32)
        e = w if k == 2 else end[at[by[first]]]
        c = np.bincount(place[self.trained[at]], minlength=len(distinct))
        other = np.diff(np.append(first, len(key))) > c
        del key, by, new, first
        # Contexts are dealt by name, rare ones in stripes of names, so that steps between those of a message stay short
        # however many buckets there are; those with many tokens by their next words too; lone ones to none.
        buckets, word = self.plan.buckets[k], self.units[1].name
        striped = np.where(below.count <= RARE, below.name >> STRIPE << STRIPE, below.name)
        mixed, spread = _mix(striped.astype(np.uint64)), below.count // self.plan.hot + 1
        to = (mixed % np.uint64(buckets)).astype("<u2" if buckets < 1 << 16 else "<i8")
        to[below.alone] = buckets
        dealt = to[v]
        hot = np.flatnonzero((~below.alone & (spread > 1))[v])
        dealt[hot] = (_mix(_mix(word[w[hot]].astype(np.uint64)) % spread[v[hot]].astype(np.uint64)) + mixed[v[hot]]) % np.uint64(buckets)
        bucket = np.where(below.alone[e], dealt.dtype.type(buckets), dealt)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        tokens = np.full(len(end), -1, np.int32)
        tokens[at] = back[place]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        unit = self.units[k] = Units(len(order), tokens, other[order], k < self.plan.order)
        c = c[order]
        self.sent[k] = v[order], w[order], e[order], c, edges
        self.dealt = dealt, back
        unit.alone[edges[buckets] :] = True
        unit.count = c.copy()
        for _, b, _, _, _, packed in self.held.get(_answer(k), []):
            counts, alone, *steps = _get(packed)
            mine = slice(edges[b], edges[b + 1])
            unit.alone[mine] = np.unpackbits(alone, count=edges[b + 1] - edges[b])
            mine = edges[b] + np.flatnonzero(~unit.alone[mine])
            unit.count[mine] = counts
            if steps:
                unit.name[mine] = (b << 36) + np.cumsum(steps[0].astype(np.int64))
        if k < self.plan.order:
            self._weigh(unit, np.arange(len(order)), edges, k + 1)
        if k in self.plan.discounts:
            self._weigh_alone(k)

    def _weigh_alone(self, k: int) -> None:
        """The weights of this block's lone contexts of the grams of level k."""
        below, (v, _, e, _, edges) = self.units[k - 1], self.sent[k]
        count = self.units[k].count
        at = np.arange(edges[-1], len(count))
        at = at[(count[at] > 0) & below.alone[v[at]]]
        n, c, v, e = len(below.count), count[at], v[at], e[at]
        lower = self.plan.unigrams.probability(below.count[e]) if k == 2 else self.plan.direct(k - 1, below.count[e], self.divisors(k - 1, e))
        mass = np.bincount(v, lower, minlength=n)
        mine = np.flatnonzero(below.alone & (below.count > 0))
        low = np.stack([np.bincount(v[c == r], minlength=n)[mine] for r in range(1, CUT + 1)])
        weight, divisor = weights(below.count[mine], low, mass[mine], self.plan.discounts[k])
        below.weight[mine], below.plus[mine] = weight, divisor - below.count[mine]

    def divisors(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What the counts of the grams of level k at these places are divided by."""
        below, v = self.units[k - 1], self.sent[k][0][at]
        return below.count[v] + below.plus[v]

    def probability(self, k: int, at: np.ndarray) -> np.ndarray:
        """The probabilities of tokens, by their places in the block, after up to k - 1 words, backing off level by level."""
        unit = self.units[k]
        if k == 1:
            return self.plan.unigrams.probability(unit.count)[self.ids[at]]
        found = unit.place[at]
        hit = found >= 0
        hit[hit] = unit.count[found[hit]] > 0
        out = np.empty(len(at))
        out[hit] = self.plan.direct(k, unit.count, self.divisors(k))[found[hit]]
        rest = at[~hit]
        lower, context = self.probability(k - 1, rest), self.before(k - 1)[rest]
        known = context >= 0
        lower[known] *= self.units[k - 1].weight[context[known]]
        out[~hit] = lower
        return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in order, and where each stood: sorted with their places in their low bits, where those fit."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) >> (62 - bits):
        by = np.argsort(key)
        return key[by], by
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tally(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].astype(np.int64)


def _send_grams(plan: Plan, k: int) -> Callable:
    """A row per block and bucket of level k: a: contexts, how many words each has here, which of these make grams that are
    alone by their end, and below the longest grams which others held-out documents have; b: the words that occur, and of each
    gram not alone its word's number among these; c: training counts and the words' counts one level lower (at level 2 of
    the words that occur), and both for lone grams that training documents have. And a row of kind 1 with the counts of
    counts of the grams that the block keeps."""

    def work(block: int, rows: list[tuple]) -> Iterator[tuple]:
        o = Opened(rows, plan, k)
        rows.clear()
        v, w, e, c, edges = o.sent[k]
        below, word = o.units[k - 1], o.units[1].name
        dealt, back = o.dealt
        order = np.argsort(dealt, kind="stable")
        cuts = np.searchsorted(dealt[order], np.arange(plan.buckets[k] + 1))
        at = back[order[: cuts[-1]]]
        lone = at >= edges[-1]
        told = ~lone | (c[at] > 0)
        at, lone, cuts = at[told], lone[told], np.concatenate(([0], np.cumsum(told)))[cuts]
        number, occurs = np.empty(len(word), np.int64), np.zeros(len(word), bool)
        for b in np.flatnonzero(np.diff(cuts)):
            part, apart = at[cuts[b] : cuts[b + 1]], lone[cuts[b] : cuts[b + 1]]
            nv, plain, rest = below.name[v[part]], slice(edges[b], edges[b + 1]), part[apart]
            cut = np.flatnonzero(np.concatenate(([True], nv[1:] != nv[:-1])))
            sizes = np.diff(np.append(cut, len(nv)))
            local, ends = w[plain], e[plain]
            occurs[local] = True
            words = np.flatnonzero(occurs)
            occurs[words], number[words] = False, np.arange(len(words))
            # Numbers are stored as steps within their context, so they compress.
            nw, first = number[local], _firsts(v[plain])
            step = np.diff(nw, prepend=0)
            step[first] = nw[first]
            other = [np.packbits(o.units[k].other[plain])] if k < plan.order else []
            numbers = c[plain], below.count[words if k == 2 else ends], c[rest], below.count[e[rest]]
            yield int(b), block, 0, _put(_narrow(np.diff(nv[cut], prepend=0)), _narrow(sizes), np.packbits(apart), *other), _put(_narrow(np.diff(word[words], prepend=0)), _narrow(step)), _put(*map(_narrow, numbers))
        yield block % plan.buckets[k], block, 1, b"", _put(_tally(c[edges[-1] :])), b""

    return work


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _open_grams(row: tuple, k: int) -> list[np.ndarray]:
    """Contexts; of grams not alone the place of their context among these, the word, both counts; of lone ones all but the word."""
    contexts, sizes, apart, *_ = _get(row[3])
    words, step = _get(row[4])
    c, lower, rest, rest_lower = (x.astype(np.int64) for x in _get(row[5]))
    v = np.repeat(np.arange(len(sizes)), sizes)
    apart = np.unpackbits(apart, count=len(v)).astype(bool)
    v, rest_v = v[~apart], v[apart]
    total, first = np.cumsum(step.astype(np.int64)), _firsts(v)
    number = total - np.repeat(total[first] - step[first], np.diff(np.append(first, len(v))))
    return [np.cumsum(contexts.astype(np.int64)), v, np.cumsum(words.astype(np.int64))[number], c, lower[number] if k == 2 else lower, rest_v, rest, rest_lower]


def _by_gram(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the order by context and word; where in it another gram begins."""
    span = int(w.max()) + 1 if len(w) else 1
    if len(w) and (int(v.max()) + 1) * span >= 1 << 63:
        order = np.lexsort((w, v))
        same = (v[order][1:] == v[order][:-1]) & (w[order][1:] == w[order][:-1])
    else:
        key, order = _sorted(v * span + w)
        same = key[1:] == key[:-1]
    return order, np.concatenate((np.ones(min(1, len(w)), bool), ~same))


def _sum_grams(plan: Plan, k: int) -> Callable:
    """kind 3: the counts of the bucket's grams that are not alone; kind 9: its counts of counts; kind 4: for each bucket of
    contexts what its contexts need; and answers to blocks: counts of grams that are not alone, which are, and below the top
    level the numbers of those that are not, and a: which of them held-out documents have."""
    top = k == plan.order

    def work(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
        tally = sum((_get(r[4])[0] for r in rows if r[2] == 1), np.zeros(CUT + 1, np.int64))
        rows = [r for r in rows if r[2] == 0]
        if not rows:
            yield bucket, 0, 9, b"", _put(tally), b""
            return
        opened = [_open_grams(r, k) for r in rows]
        ends = np.cumsum([len(x[2]) for x in opened])[:-1]
        start = 0
        for x in opened:
            x[1], x[5], start = x[1] + start, x[5] + start, start + len(x[0])
        contexts, v, w, c, lower, rest_v, rest, rest_lower = (np.concatenate(x) for x in zip(*opened))
        del opened
        contexts, back = np.unique(contexts, return_inverse=True)
        v = back[v]
        order, new = _by_gram(v, w)
        place = np.empty(len(v), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, c, minlength=int(new.sum())).astype(np.int64)
        alone = np.bincount(place, minlength=len(total)) == 1  # a block names a gram once
        seen = total > 0
        known = seen & ~alone
        number = np.maximum(np.cumsum(known) - 1, 0)  # rises with place, so steps are stored
        for row, mine in zip(rows, np.split(place, ends)):
            if len(mine):
                by_own, shared = alone[mine], mine[~alone[mine]]
                other = b"" if top else _put(np.packbits(np.unpackbits(_get(row[3])[3], count=len(mine))[~by_own]))
                yield row[1], bucket, _answer(k), other, b"", _put(_narrow(total[shared]), np.packbits(by_own), *([] if top else [_narrow(np.diff(number[shared], prepend=0))]))
        yield bucket, 0, 9, b"", _put(tally + _tally(total)), b""
        if not top and known.any():
            yield bucket, 0, 3, b"", b"", _put(_narrow(total[known]))
        keep = order[new][seen]
        owner, counts, lower = np.concatenate((v[keep], back[rest_v])), np.concatenate((total[seen], rest)), np.concatenate((lower[keep], rest_lower))
        found = np.bincount(owner, minlength=len(contexts)) > 0
        large = lower > CUT
        needs = [np.bincount(owner[x == r], minlength=len(contexts)) for x in (counts, lower) for r in range(1, CUT + 1)]
        needs.append(np.bincount(owner[large], lower[large], minlength=len(contexts)).astype(np.int64))
        home, index = plan.home(k, contexts)
        order = np.argsort(home, kind="stable")
        order = order[found[order]]
        for mine in np.split(order, _firsts(home[order])[1:]):
            if len(mine):
                yield int(home[mine[0]]), bucket, 4, _put(_narrow(np.diff(index[mine], prepend=0))), _put(*[_narrow(x[mine]) for x in needs]), b""

    return work


# --- weights ----------------------------------------------------------------------------------------


def weights(count: np.ndarray, low: np.ndarray, mass: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, what to divide counts by) of contexts: low[r - 1] words were seen r times after it, mass is their
    unigram probability. Where discounts free nothing, the divisor is one more than the count, which frees that one."""
    freed = ((1 - discount)[:, None] * np.arange(1, len(discount) + 1)[:, None] * low).sum(axis=0)
    none = freed <= 1e-9
    divisor = count + none
    left = np.where(none, 1.0, freed) / np.maximum(divisor, 1)
    weight = np.where(count > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    return weight, divisor.astype(np.int64)


def _weigh(discount: np.ndarray, level: int) -> Callable:
    """Rows of a bucket of contexts (kind 1 or 3 what it holds, 2 who asked, 4 parts) → for each block that asked what the
    weights need, of contexts that its held-out documents have (all that training documents hold was seen), and what to add
    to the counts of contexts seen in training to divide by, lone ones left out. level: that of the grams they are contexts of."""

    def work(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
        held = [_get(r[5])[0] for r in rows if r[2] in (1, 3)]
        if not held:
            return
        count = held[0].astype(np.int64)
        needs = np.zeros((2 * CUT + 1, len(count)), np.int64)
        for r in rows:
            if r[2] == 4:
                at = np.cumsum(_get(r[3])[0].astype(np.int64))
                for k, x in enumerate(_get(r[4])):
                    needs[k, at] += x.astype(np.int64)
        _, divisor = weights(count, needs[:CUT], np.zeros(len(count)), discount)
        plus = (divisor - count).astype("u1")
        for r in rows:
            if r[2] == 2:
                counts, *more = _get(r[5])
                other = np.unpackbits(_get(r[3])[0])
                if level == 2:  # a block speaks of all its words, of grams only of those that are not alone
                    ids, other = more[0].astype(np.int64), other[np.unpackbits(more[1]) == 0]
                else:
                    ids = np.cumsum(more[1].astype(np.int64))
                other = other[: len(ids)].astype(bool)
                seen = counts > 0
                yield r[1], bucket, _answer(level) + 1, b"", b"", _put(*[_narrow(x[ids[seen & other]]) for x in needs], plus[ids[seen]])

    return work


# --- scores -----------------------------------------------------------------------------------------

SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(plan: Plan, order: int, types: int) -> Callable:
    def work(rows: list[tuple]) -> pa.Table:
        o = Opened(rows, plan, order)
        count = o.units[1].count
        logs = np.log10(o.probability(order, np.arange(len(o.ids))))
        base = np.log10((count + 0.5) / (plan.unigrams.total + 0.5 * (types + 1)))
        sums = [np.add.reduceat(x, o.first) for x in ((count[o.ids] > 0).astype(np.int64), base[o.ids], logs)]
        cols = [pa.array(o.docs, mask=o.null), *map(pa.array, (~o.train, o.lens, *sums))]
        return pa.Table.from_arrays(cols, schema=SCORES)

    return work


def tidy(spark) -> None:
    """Lets go of shuffle files of steps that are over: their results are tables by now. Spark's threads hold on to the last
    query until another has run, so an empty one does."""
    import gc

    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Model:
    """A fitted model and the blocks it was fitted on. unigram_rows: the words and their counts (kind 1), by buckets;
    answers: what blocks have been told of their words and grams. Driver-side there are only totals, discounts and bucket
    numbers."""

    def __init__(self, rows: DataFrame, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_words: int = BUCKET_WORDS, bucket_grams: int = BUCKET_GRAMS, hot: int = HOT_CONTEXT):
        """rows: doc_id (long), train (boolean), text."""
        if order < 2:
            raise ValueError("order must be two or more")
        spark = rows.sparkSession
        self.order = order
        # Two partitions a block, at about six bytes a token, so that few blocks share a task.
        volume = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        parts = 2 * (volume // (6 * block_tokens) + 1)
        blocks = bucketed(rows.select("doc_id", "train", "text").mapInArrow(lambda it: _blocks(it, block_tokens), ROW), parts, "key", "uncompressed")
        sizes = blocks.select(F.octet_length("b").cast("bigint").alias("b"), F.octet_length("a").cast("bigint").alias("a")).agg(F.sum("b"), F.sum("a")).first()
        # A compressed vocabulary takes about four bytes a word, token numbers about two a token.
        words = min(1 << 16, int((sizes[0] or 0) / 4 / bucket_words) + 1)
        tokens = (sizes[1] or 0) / 2
        # Distinct grams after shared words or grams, which alone are sent, are under half of the tokens at any level.
        self.plan = plan = Plan(words, [0, 0, *[int(tokens * 0.5 / bucket_grams) + 1 for _ in range(2, order + 1)]], hot)
        sent = blocks.mapInArrow(lambda it: _send_words(it, words), ROW)
        self.unigram_rows = saved(_per_key(sent, _sum_words, 2 * words), "uncompressed")
        n, total, types = self._unigram_totals()
        tidy(spark)
        self.types = types
        if total:
            plan.unigrams = Unigrams(n, total)
        asked = self.unigram_rows.filter("kind = 2")
        answer = ["key", "sub", "kind", F.lit(b"").alias("a"), "b", "c"]  # what a block said itself need not go back
        held, contexts = self.unigram_rows.filter("kind = 1"), words
        self.blocks = blocks.select("key", "sub", "kind", "a", F.lit(b"").alias("b"), "c")  # the vocabulary has been sent
        self.answers = asked.select(*answer)
        for k in range(2, order + 1):
            buckets = plan.buckets[k]
            out = self._per_block(_send_grams(plan, k))
            rows_ = saved(_per_key(out, _sum_grams(plan, k), 2 * buckets), "uncompressed")
            plan.discounts[k] = discounts(self._tally(rows_))
            tidy(spark)
            # Buckets of contexts get their own table, who asked (turned round), and the contexts' parts.
            turned = asked.select(F.col("sub").alias("key"), F.col("key").alias("sub"), F.lit(2).alias("kind"), "a", "b", "c")
            counts = held.select("key", "sub", "kind", F.lit(b"").alias("a"), F.lit(b"").alias("b"), "c")
            gathered = counts.unionByName(turned).unionByName(rows_.filter("kind = 4"))
            weighed = saved(_per_key(gathered, _weigh(plan.discounts[k], k), 2 * contexts), "uncompressed")
            tidy(spark)
            asked = rows_.filter(F.col("kind") == _answer(k))
            held, contexts = rows_.filter("kind = 3"), buckets
            self.answers = self.answers.unionByName(asked.select(*answer)).unionByName(weighed)

    def _with_answers(self, work: Callable[[list[tuple]], pa.Table], schema: str) -> DataFrame:
        """work(rows) of each block: its own row and all it has been answered."""

        def run(own: pa.Table, answers: pa.Table) -> pa.Table:
            return work([r for t in (own, answers) for r in zip(*(c.to_pylist() for c in t.columns))])

        return self.blocks.groupBy("key").cogroup(self.answers.groupBy("key")).applyInArrow(run, schema)

    def _per_block(self, work: Callable) -> DataFrame:
        return self._with_answers(lambda rows: pa.Table.from_batches([_batch([x]) for x in work(rows[0][0], rows)], ROWS), ROW)

    def _unigram_totals(self) -> tuple[list[int], int, int]:
        def run(batches):
            for b in batches:
                for c in b.column(0).to_pylist():
                    count, special = _get(c)
                    count = count[special == 0].astype(np.int64)
                    tally = np.bincount(np.minimum(count, CUT + 2), minlength=CUT + 3)
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*tally[1 : CUT + 2], count.sum(), (count > 0).sum())], names=names)

        names = [f"n{r}" for r in range(1, CUT + 2)] + ["total", "types"]
        found = self.unigram_rows.filter("kind = 1").select("c").mapInArrow(run, ", ".join(f"{x} long" for x in names)).agg(*[F.sum(x) for x in names]).first()
        got = [int(x or 0) for x in found]
        return got[: CUT + 1], got[-2], got[-1]

    def _tally(self, rows: DataFrame) -> list[int]:
        def run(batches):
            for b in batches:
                for x in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in _get(x)[0]], names=names)

        names = [f"n{r}" for r in range(1, CUT + 2)]
        found = rows.filter("kind = 9").select("b").mapInArrow(run, ", ".join(f"{x} long" for x in names)).agg(*[F.sum(x) for x in names]).first()
        return [int(x or 0) for x in found]

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, base_score, score) of the documents of the blocks."""
        return self._with_answers(_score(self.plan, self.order, self.types), SCORES_SQL)


def scored(docs: DataFrame, order: int = ORDER, **sizes: int) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null, empty or blank text is its end alone. Without training rows every probability is that of the one unknown
    word, 1. Null ids count as the empty text for the fold; rows that repeat keep a row each, and count as often; very
    long texts count whole; other columns are ignored; an empty table gives no rows.
    """
    train = id_bucket(F.col("doc_id"), FOLD) != HELD_OUT
    model = Model(docs.select(F.col("doc_id").cast("long"), train.alias("train"), "text"), order, **sizes)
    return model.scores().withColumn("train_tokens", F.lit(model.plan.unigrams.total).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
