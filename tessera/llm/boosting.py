"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics of a whole text (character classes, repetition of words and lines, word shapes) are binned at
quantiles of a bounded training sample; trees of fixed depth grow on gradient histograms for the logistic
loss. The fitted forest is flattened into arrays (feature, threshold, left, right, value), and a batch of
documents walks all trees at once in numpy, one array step per level.

Scale: scoring is one pass over the texts without a shuffle; the model is a few kilobytes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket
from .labelled import MAX_ROWS, training_sample

FOLD, HELD_OUT = 4, 2
CUT = 0.7
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 120, 4, 64, 0.12, 8, 1.0

_CODE = np.arange(256)
#: Character classes over bytes: lower case, upper case, digits, spaces, line feeds, sentence points, other ASCII, beyond.
CLASSES = np.array(
    [
        (_CODE >= 97) & (_CODE <= 122), (_CODE >= 65) & (_CODE <= 90), (_CODE >= 48) & (_CODE <= 57), _CODE == 32, _CODE == 10,
        np.isin(_CODE, list(b".,;:?'\"")), (_CODE > 32) & (_CODE < 127) & ~np.isin(_CODE, list(b".,;:?'\"")) & ~(((_CODE | 32) >= 97) & ((_CODE | 32) <= 122)) & ~((_CODE >= 48) & (_CODE <= 57)),
        _CODE >= 128,
    ],
    dtype=np.float64,
).T
NAMES = (
    "lower upper digit space line point symbol beyond log_bytes log_words mean_word sd_word long_word distinct_words repeats top_word top_pair"
    " distinct_lines log_lines mean_line symbol_words upper_words digit_words point_words entropy max_run"
).split()


def statistics(text: str | None) -> np.ndarray:
    """The statistics named in NAMES; zeros for a null or empty text."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    if not words:
        return np.zeros(len(NAMES))
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256).astype(np.float64)
    n, m = len(b), len(words)
    shares = counts @ CLASSES / n
    lens = np.fromiter(map(len, words), np.float64, m)
    tally = Counter(words)
    same = np.fromiter((a == z for a, z in zip(words, words[1:])), bool, m - 1)
    run = longest = 1
    if same.any():
        for s in same.tolist():
            run = run + 1 if s else 1
            longest = max(longest, run)
    pairs = Counter(zip(words, words[1:])).most_common(1)[0][1] if m > 1 else 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    last = [w[-1:] for w in words]
    odd = sum(1 for c in last if not c.isalnum() and c < b"\x80" and c not in (b".", b","))
    return np.array(
        [
            *shares, np.log1p(n), np.log1p(m), lens.mean(), lens.std(), lens.max() if m < 50 else np.partition(lens, -m // 50)[-m // 50],
            len(tally) / m, same.sum() / m, tally.most_common(1)[0][1] / m, pairs / m, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
            odd / m, sum(map(bytes.isupper, words)) / m, sum(map(bytes.isdigit, words)) / m, sum(1 for c in last if c in (b".", b",")) / m,
            float(-(p * np.log2(p)).sum()), np.log1p(longest),
        ]
    )


@dataclass
class Forest:
    """Trees as arrays; a leaf points to itself. roots: the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest for the logistic loss; its base is moved from the sample's share of label 1 to share."""
    none = np.zeros(1)
    if not len(y) or len(set(y.tolist())) < 2:
        # One label only, or none: the score is near that label, or 0.5.
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Forest(none.astype(int), none, none.astype(int), none.astype(int), none, np.zeros(1, int), 1, base)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        queue = [(np.arange(n), 0)]
        start = len(feature)
        slots = [start]
        for lst, v in ((feature, 0), (threshold, 0.0), (left, start), (right, start), (value, 0.0)):
            lst.append(v)
        while queue:
            who, level = queue.pop(0)
            at = slots.pop(0)
            gs, hs = g[who].sum(), h[who].sum()
            best = (1e-6, None, None)
            if level < depth and len(who) >= 2 * LEAST:
                for j in range(d):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    bj = bins[who, j]
                    cg, ch, cn = (np.cumsum(np.bincount(bj, w, size))[:-1] for w in (g[who], h[who], np.ones(len(who))))
                    ok = (cn >= LEAST) & (len(who) - cn >= LEAST)
                    gain = np.where(ok, cg**2 / (ch + RIDGE) + (gs - cg) ** 2 / (hs - ch + RIDGE) - gs**2 / (hs + RIDGE), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] is None:
                value[at] = -RATE * gs / (hs + RIDGE)
                raw[who] += value[at]
                continue
            _, j, k = best
            feature[at], threshold[at] = j, float(edges[j][k])
            go = bins[who, j] <= k
            for side, part in ((left, who[go]), (right, who[~go])):
                side[at] = new = len(feature)
                for lst, v in ((feature, 0), (threshold, 0.0), (left, new), (right, new), (value, 0.0)):
                    lst.append(v)
                slots.append(new)
                queue.append((part, level + 1))
    if share:
        base += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    as_int = [np.array(v, np.int64) for v in (feature, left, right, roots)]
    return Forest(as_int[0], np.array(threshold), as_int[1], as_int[2], np.array(value), as_int[3], depth, base)


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """A forest of the sample's statistics, which are made where the texts are: no text reaches the driver."""
    texts, of, share = training_sample(docs, labels, "quality", FOLD, HELD_OUT, max_rows)

    @F.pandas_udf("array<double>")
    def measured(found):
        import pandas as pd

        return pd.Series([statistics(t).tolist() for t in found])

    rows = {r[0]: r[1] for r in texts.select("doc_id", measured("text")).collect()} if of else {}
    x = np.array([rows[i] for i in sorted(rows)]).reshape(-1, len(NAMES))
    return fit(x, np.array([of[i] for i in sorted(rows)], float), share)


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null, empty and blank texts have zero statistics and the score of these. Labels that are null, not 0 or 1, or
    without an id are not used; of repeated labels the larger counts. Without labelled rows every score is 0.5; with
    one label only, near that label. Null ids count as the empty text for the fold. Rows that repeat keep a row each;
    very long texts count whole; other columns are ignored; an empty table gives no rows.
    """
    forest = trained(docs, labels, max_rows)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))
        return pd.Series(forest.score(x), dtype="float64")

    return docs.select("doc_id", scored(F.col("text")).alias("score")).select(
        "doc_id",
        (id_bucket(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
