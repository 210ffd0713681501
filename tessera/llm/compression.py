"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. The toxic dictionary's
training text is what sets toxic text apart: the words whose document frequency in toxic text is higher by
a log-likelihood ratio test. A text is cut into windows; each is compressed against the ordinary dictionary
and against the ordinary dictionary preceded by the toxic one, so text that both know costs the same and
the difference in compressed length is what the toxic dictionary alone explains. The differences are
compared with thresholds. Marks whose every letter run the ordinary dictionary knows as well leave no difference, which
hides toxic words of the rarer languages, so the marks a text holds are also weighed by their log odds. A logistic curve
fitted on other labelled rows turns the counts and weights into a score.

Scale: fitting uses a bounded sample of whole texts (labelled.MAX_ROWS); scoring is one pass over the whole
texts without a shuffle, its model (two dictionaries, at most 0.5 MB) goes along with the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket
from .labelled import MAX_ROWS, training_sample

FOLD, HELD_OUT = 3, 1
CUT = 0.7
#: Bytes of a window and from one window's start to the next one's.
WINDOW, STEP = 320, 296
#: Bytes of the ordinary and of the toxic dictionary, at most.
ORDINARY_BYTES, TOXIC_BYTES = 400_000, 32_768
#: The least log-likelihood ratio at which a word sets toxic text apart.
LEAST_RATIO = 16.0
THRESHOLDS = (2, 3, 4, 6)
#: Bytes of the smallest dictionary that zstandard trains.
LEAST_DICTIONARY = 4096
#: A mark is weighed if so many toxic texts hold it and its log odds exceed LEAST_ODDS.
LEAST_TEXTS, LEAST_ODDS = 4, 2.0
#: A-Z becomes a-z; what is neither a letter nor beyond ASCII becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").translate(LETTERS).split())


def cut(b: bytes, window: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows that cover b; one window for a short or empty text."""
    return [b[i : i + window] for i in range(0, max(1, len(b) - (window - step)), step)]


def _marks(b: bytes) -> set[bytes]:
    """The words of a text and the beginnings of its words, both with the space before them."""
    words = set(b.split())
    return {b" " + w + b" " for w in words} | {b" " + w[:k] for w in words for k in (4, 5, 6) if len(w) > k}


def _distinctive(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words and word beginnings that set toxic text apart, the strongest first; none that another one contains."""
    t, n = Counter(), Counter()
    for b in toxic:
        t.update(_marks(b))
    for b in ordinary:
        n.update(_marks(b))
    nt, nn = len(toxic), len(ordinary)

    def part(k, m, q):
        q = min(max(q, 1e-12), 1 - 1e-12)
        return k * math.log(q) + (m - k) * math.log(1 - q)

    def ratio(w):
        a, b = t[w], n[w]
        q = (a + b) / (nt + nn)
        return 2 * (part(a, nt, a / nt) + part(b, nn, b / nn) - part(a, nt, q) - part(b, nn, q))

    scored = sorted(((ratio(w), w) for w in t if t[w] > 3 and t[w] / nt > 4 * n[w] / nn), reverse=True)
    kept: list[bytes] = []
    for r, w in scored:
        if r <= LEAST_RATIO:
            break
        if not any(w in k for k in kept):
            kept.append(w)
    return kept


def _weights(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """The log odds of the marks that are weighed."""
    t, n = Counter(), Counter()
    for b in toxic:
        t.update(_marks(b))
    for b in ordinary:
        n.update(_marks(b))
    odds = {w: math.log((k + 0.5) / (len(toxic) + 1)) - math.log((n[w] + 0.5) / (len(ordinary) + 1)) for w, k in t.items() if k >= LEAST_TEXTS}
    return {w: v for w, v in odds.items() if v > LEAST_ODDS}


def _evidence(b: bytes, weights: dict[bytes, float]) -> list[float]:
    """The weighed marks of a text: their sum, their sum and number against all marks, the largest."""
    marks = _marks(b)
    found = sorted(weights[w] for w in marks if w in weights)
    return [math.log1p(sum(found)), sum(found) / math.sqrt(1 + len(marks)), len(found) / (1 + len(marks)), found[-1] if found else 0.0]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, filled up to size with samples as they are. Few, short or all equal samples are nothing that
    zstandard can train on; then the samples themselves are the dictionary."""
    total = sum(map(len, samples))
    size = min(size, total // 2)
    try:
        content = zstd.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 and size >= LEAST_DICTIONARY else b""
    except zstd.ZstdError:
        content = b""
    rest = size - len(content)
    return (b"".join(samples)[:rest] if rest > 0 else b"") + content


def _training_windows(texts: list[bytes], most: int) -> list[bytes]:
    """Windows of up to most bytes in all, the same share of each text."""
    cut_all = [cut(b, 200, 200) for b in texts]
    keep = max(1, math.ceil(sum(map(len, cut_all)) * 200 / most)) if texts else 1
    return [w for ws in cut_all for w in ws[::keep] if len(w) > 7]


def _compressors(model: dict):
    def one(content: bytes):
        params = zstd.ZstdCompressionParameters.from_level(
            5, min_match=4, strategy=zstd.STRATEGY_LAZY, hash_log=17, chain_log=17, search_log=4, window_log=20,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        if len(content) < 8:
            return zstd.ZstdCompressor(compression_params=params).compress
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=d, compression_params=params).compress

    return one(model["ordinary"]), one(model["toxic"] + model["ordinary"])


@lru_cache(maxsize=2)
def _opened(ordinary: bytes, toxic: bytes):
    return _compressors({"ordinary": ordinary, "toxic": toxic})


def measure(text: str | None, plain, marked, weights: dict[bytes, float]) -> np.ndarray:
    """Features of a text: shares of windows whose difference reaches each threshold, their mean, the largest ones, and
    the weighed marks."""
    b = normal(text)
    d = np.array([len(plain(w)) - len(marked(w)) for w in cut(b)], float)
    n, top = len(d), np.sort(d)[::-1]
    shares = [float((d >= t).mean()) for t in THRESHOLDS]
    counts = [math.log1p(float((d >= t).sum())) for t in THRESHOLDS[1:]]
    return np.array([*shares, *counts, float(np.clip(d, 0, 12).mean()), min(float(top[0]), 16.0), min(float(top[: max(3, n // 8)].mean()), 16.0), math.log(n), *_evidence(b, weights)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pen * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _runs(b: bytes, marks: list[bytes]) -> list[bytes]:
    """The toxic marks of a text with their surroundings of eight bytes, once each."""
    found = ((b.find(m), len(m)) for m in marks[:200])
    return [b[max(0, i - 8) : i + n + 8] for i, n in found if i >= 0]


def fit(sample: list[tuple[str, int]], share: float | None = None) -> dict:
    """Dictionaries from two thirds of the sample, the curve from the rest, its intercept moved from the sample's share
    of toxic rows to share. Without both classes every score is 0."""
    texts = [(normal(t), t, y) for t, y in sample]
    build = [x for k, x in enumerate(texts) if k % 3] or texts
    tune = [x for k, x in enumerate(texts) if k % 3 == 0]
    toxic, ordinary = [b for b, _, y in build if y == 1], [b for b, _, y in build if y == 0]
    if not toxic or not ordinary or len({y for *_, y in tune}) < 2:
        return {"ordinary": b"", "toxic": b"", "odds": {}, "weights": None}
    words = _distinctive(toxic, ordinary)
    listed = b"".join(reversed(words)) + b" "
    runs = [found for b in toxic for found in _runs(b" " + b + b" ", words)]
    trained = _dictionary(runs, TOXIC_BYTES // 4) if runs else b""
    model = {
        "ordinary": _dictionary(_training_windows(ordinary, 8_000_000), ORDINARY_BYTES),
        "toxic": (trained + listed)[-TOXIC_BYTES:] if words else b"",
        "odds": _weights(toxic, ordinary),
    }
    plain, marked = _compressors(model)
    x = np.array([measure(t, plain, marked, model["odds"]) for _, t, _ in tune])
    mean, sd = x.mean(0), x.std(0) + 1e-6
    y = np.array([y for *_, y in tune], float)
    w = logistic((x - mean) / sd, y)
    if share:
        w[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return model | {"weights": w, "mean": mean, "sd": sd}


def score(text: str | None, model: dict) -> float:
    if model["weights"] is None:
        return 0.0
    x = (measure(text, *_opened(model["ordinary"], model["toxic"]), model["odds"]) - model["mean"]) / model["sd"]
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ model["weights"][:-1] + model["weights"][-1]))))))


def with_score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series([score(t, model) for t in texts], dtype="float64")

    return docs.withColumn(column, scored(F.col("text")))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    texts, of, share = training_sample(docs, labels, "toxic", FOLD, HELD_OUT, max_rows)
    return fit([(t, of[i]) for i, t in sorted(map(tuple, texts.collect()))] if of else [], share)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored as one empty window. Labels that are null, not 0 or 1, or without an id are not
    used; of repeated labels the larger counts. Without labelled rows of both classes every score is 0. Null ids
    count as the empty text for the fold. Rows that repeat keep a row each; very long texts count whole, all their
    windows; other columns are ignored; an empty table gives no rows.
    """
    out = with_score(docs.select("doc_id", "text"), trained(docs, labels, max_rows))
    return out.select(
        "doc_id",
        (id_bucket(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the rows scored at CUT or more. Null and empty texts are scored as one empty window; without labelled
    rows of both classes every row stays; rows that repeat stay or go together; columns may have any names; an empty table
    gives no rows."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "text")
    return with_score(packed, trained(docs, labels, max_rows)).filter(F.col("score") < CUT).select("r.*")
