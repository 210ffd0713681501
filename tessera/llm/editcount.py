"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold the length and the token count of runs of
text that the tokenizer never joins, inner nodes their sums. An edit finds the leaves it touches by
descending on lengths, cuts the text once more over these leaves and one on either side (the boundary
context that decides where the tokenizer splits), encodes only that, and updates sums on the paths above.

Trees are kept as a table: a row's text with the lengths and counts of its leaves, from which the inner nodes
are sums. with_trees makes it, apply_edits takes it with a batch of edits and gives it back edited, so a later
batch again encodes no more than what it touches.

Scale: each document is handled where it is read; nothing is shuffled. A tree has a leaf per pre-token run,
so it is a fraction of its text. A document of any length is one tree in one task; a text without certain
splits (no single spaces) is one leaf, which each of its edits encodes again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import BYTE_BPE, default_path, encoder

#: Code points of a leaf, about: a run ends at the first certain split from there on.
LEAF = 64
#: A certain split stands before a single space between two characters that aren't white space.
_SPLIT = re.compile(r"(?<=\S)(?= \S)")


def cut(text: str, least: int = LEAF) -> list[str]:
    """text as runs that end at certain splits, each of least code points or more but for the last one."""
    out, start = [], 0
    while len(text) - start > least:
        m = _SPLIT.search(text, start + least)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    if start < len(text):
        out.append(text[start:])
    return out


class CountTree:
    """A segment tree of (length, tokens) over the runs of a text; count() is the root's sum."""

    def __init__(self, text: str, count, least: int = LEAF, leaves: tuple[list[int], list[int]] | None = None):
        """leaves: the lengths and counts of a kept tree; without them the text is cut and encoded."""
        self._count, self._least = count, least
        self.encoded = 0  # code points encoded so far
        if leaves is None:
            self._build(cut(text, least))
        else:
            ends = np.cumsum(leaves[0]).tolist()
            self._build([text[a:z] for a, z in zip([0, *ends], ends)], leaves[1])

    def leaves(self) -> tuple[list[int], list[int]]:
        """The lengths and counts of the leaves, to be kept."""
        at = slice(self.size, self.size + len(self.runs))
        return self.chars[at].tolist(), self.sums[at].tolist()

    def _tokens(self, run: str) -> int:
        self.encoded += len(run)
        return self._count(run)

    def _build(self, runs: list[str], tokens: list[int] | None = None) -> None:
        self.runs = runs
        n = max(1, len(runs))
        self.size = 1 << (n - 1).bit_length()
        self.chars, self.sums = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(runs)] = [len(r) for r in runs]
        self.sums[self.size : self.size + len(runs)] = tokens if tokens is not None else [self._tokens(r) for r in runs]
        width = self.size
        while width > 1:
            half = width // 2
            for a in (self.chars, self.sums):
                a[half:width] = a[width : 2 * width : 2] + a[width + 1 : 2 * width : 2]
            width = half

    def count(self) -> int:
        return int(self.sums[1])

    def __len__(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.runs)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(the leaf that holds position at, where it begins)."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.size, max(0, len(self.runs) - 1)), before

    def replace(self, start: int, end: int, new: str) -> None:
        """Replaces code points start to end (clamped to the text); only touched runs and one on either side are encoded."""
        start = max(0, min(start, len(self)))
        end = max(start, min(end, len(self)))
        if not self.runs:
            return self._build(cut(new, self._least))
        if start == len(self):  # at the very end: the last run is touched
            first = len(self.runs) - 1
            begin = len(self) - len(self.runs[first])
        else:
            first, begin = self._leaf(start)
        last = first if end <= begin + len(self.runs[first]) else min(self._leaf(end - 1)[0], len(self.runs) - 1)
        low, high = max(0, first - 1), min(len(self.runs), last + 2)
        begin -= len(self.runs[low]) if low < first else 0
        body = "".join(self.runs[low:high])
        runs = cut(body[: start - begin] + new + body[end - begin :], self._least)
        while high < len(self.runs) and not (runs and _SPLIT.match(runs[-1][-1:] + self.runs[high][:2], 1)):
            runs = cut("".join(runs) + self.runs[high], self._least)  # the next run's split no longer stands
            high += 1
        while low > 0 and not (runs and _SPLIT.match(self.runs[low - 1][-1:] + "".join(runs)[:2], 1)):
            low -= 1
            runs = cut(self.runs[low] + "".join(runs), self._least)
        tokens = [self._tokens(r) for r in runs]
        if len(runs) == high - low:  # the same leaves: update the sums on their paths
            self.runs[low:high] = runs
            touched = set()
            for k, (r, t) in enumerate(zip(runs, tokens), start=low + self.size):
                self.chars[k], self.sums[k] = len(r), t
                touched.add(k // 2)
            while touched and touched != {0}:
                for k in touched:
                    self.chars[k], self.sums[k] = self.chars[2 * k : 2 * k + 2].sum(), self.sums[2 * k : 2 * k + 2].sum()
                touched = {k // 2 for k in touched if k > 1}
        else:  # leaves came or went: stored counts are kept, nothing else is encoded
            kept = self.sums[self.size : self.size + len(self.runs)].tolist()
            self._build(self.runs[:low] + runs + self.runs[high:], kept[:low] + tokens + kept[high:])


TREE_SQL = "doc_id long, text string, lens array<int>, counts array<int>"
TREE = [("doc_id", pa.int64()), ("text", pa.string()), ("lens", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
DONE = [(c, pa.int64()) for c in ("n_tokens", "edited_tokens", "edited_chars", "n_chars", "reencoded_chars")]
DONE_SQL = f"{TREE_SQL}, n_tokens long, edited_tokens long, edited_chars long, n_chars long, reencoded_chars long"


def _counter(path: str):
    enc = encoder(path)
    width = enc.dtype.itemsize
    return lambda run: len(enc.encode(run)) // width


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def _planted(batches: Iterator[pa.RecordBatch], path: str, least: int) -> Iterator[pa.RecordBatch]:
    count, schema = _counter(path), pa.schema(TREE)
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows.append((doc, text or "", *CountTree(text or "", count, least).leaves()))
        yield _batch(rows, schema)


def _edited(batches: Iterator[pa.RecordBatch], path: str, least: int) -> Iterator[pa.RecordBatch]:
    count, schema = _counter(path), pa.schema(TREE + DONE)
    for b in batches:
        rows = []
        for doc, text, lens, counts, edits in zip(*(b.column(i).to_pylist() for i in range(5))):
            tree = CountTree(text, count, least, (lens, counts))
            n, size = tree.count(), len(tree)
            for e in edits or []:
                if e is not None:
                    tree.replace(e["start"] or 0, (e["start"] or 0) + max(0, e["length"] or 0), e["text"] or "")
            rows.append((doc, tree.text(), *tree.leaves(), n, tree.count(), len(tree), size, tree.encoded))
        yield _batch(rows, schema)


def with_trees(docs: DataFrame, path: str | None = None, least: int = LEAF) -> DataFrame:
    """The trees of docs (doc_id, text), a row per row: doc_id, text (null: empty), lens and counts of the leaves."""
    path = path or default_path(BYTE_BPE)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _planted(it, path, least), TREE_SQL)


def apply_edits(trees: DataFrame, edits: str = "edits", path: str | None = None, least: int = LEAF) -> DataFrame:
    """Kept trees after the edits in a column of theirs (array<struct<start, length, text>>, applied in order): the trees'
    columns, to be kept again, and n_tokens before the edits, edited_tokens and edited_chars after them, n_chars,
    reencoded_chars (code points encoded for the edits: touched runs and one on either side, nothing else)."""
    path = path or default_path(BYTE_BPE)
    kind = "array<struct<start:long,length:long,text:string>>"
    slim = trees.select("doc_id", "text", "lens", "counts", F.col(edits).cast(kind))
    return slim.mapInArrow(lambda it: _edited(it, path, least), DONE_SQL)


def edit_counts(docs: DataFrame, edits: str = "edits", path: str | None = None, least: int = LEAF) -> DataFrame:
    """One row per row of docs (doc_id, text, edits: array<struct<start, length, text>>, applied in order): doc_id,
    n_tokens before the edits, edited_tokens and edited_chars after them, n_chars, reencoded_chars. The trees are written
    to the shared folder before the edits come.

    Null texts are empty; null edits, or null parts of one, change nothing; positions beyond the text are clamped to
    it. Rows that repeat, and null ids, keep a row each; other columns are ignored; an empty table gives no rows.
    """
    path = path or default_path(BYTE_BPE)
    kind = "array<struct<start:long,length:long,text:string>>"
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.col(edits).cast(kind).alias("edits"))
    trees = saved(slim.mapInArrow(lambda it: _planted_beside(it, path, least), f"{TREE_SQL}, edits {kind}"))
    return apply_edits(trees, "edits", path, least).select("doc_id", "n_tokens", "edited_tokens", "edited_chars", "n_chars", "reencoded_chars")


def _planted_beside(batches: Iterator[pa.RecordBatch], path: str, least: int) -> Iterator[pa.RecordBatch]:
    """_planted with the third column, the edits, kept beside the trees."""
    for b in batches:
        for made in _planted(iter([b]), path, least):
            yield pa.RecordBatch.from_arrays([*made.columns, b.column(2)], names=[*made.schema.names, "edits"])


def standard_edits(text: str = "text"):
    """The edits of the registered query: ten code points in the middle replaced, a word put in at the first quarter,
    and the text's first twenty code points put at its end."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.length(body).cast("long")
    return F.array(
        F.struct(F.floor(n / 2).alias("start"), F.lit(10).cast("long").alias("length"), F.lit("edited words here").alias("text")),
        F.struct(F.floor(n / 4).alias("start"), F.lit(0).cast("long").alias("length"), F.lit(" inserted ").alias("text")),
        F.struct((n + 1000).alias("start"), F.lit(0).cast("long").alias("length"), F.substring(body, 1, 20).alias("text")),
    )
