"""The pipeline's near-duplicate stage against brute force: SimHash groups, then five-word Jaccard."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import nearcopies, simhash
from tests.llm.test_bruteforce import brute_classes, brute_print

SF = "/root/testdata/sf0.01"


def brute_pairs(texts):
    """{(smaller id, larger id)}: five-word Jaccard of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, out = defaultdict(list), set()
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        out |= {(j, i) for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    return out


def check(texts, kept, known=lambda i: i):
    """No near copies are left, and what went is of a SimHash group with, or a near copy of, one with a smaller id."""
    groups = brute_classes({i: brute_print(t, nearcopies.SHINGLE) for i, t in texts.items()}, simhash.RADIUS)
    left = {i: t for i, t in texts.items() if groups[i] == i}
    pairs = brute_pairs(left)
    assert kept <= set(left)
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    assert set(left) - kept <= {b for _, b in pairs}
    return pairs


def test_stage(prepared):
    docs = prepared.read.parquet(f"{SF}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](prepared, docs, SF)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert check({r["doc_id"]: r["text"] for r in docs.collect()}, set(kept))  # SimHash alone leaves some


def test_groups_short_and_odd_texts(prepared):
    words = [f"w{k}" for k in range(64)]
    edit = lambda k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(5, " ".join(words)), *[(10 + k, edit(k)) for k in (0, 1, 2, 62, 63)], (30, edit(30)), (None, edit(61)), (40, "a b"), (41, "A  b"), (42, ""), (43, None), (44, " \n"), (45, "a b"), (45, "a b")]
    got = [99 if r["doc_id"] is None else r["doc_id"] for r in nearcopies.deduplicated(prepared.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got))
    assert check({99 if i is None else i: t for i, t in rows}, set(got))
    assert {40, 42} <= set(got) and not {41, 43, 44, 45} & set(got)


def test_large_bucket(prepared):
    """Many texts of one bucket that are no near copies of each other, and a chain of near copies."""
    rng = np.random.default_rng(2)
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"x{k}{j}" for j, w in enumerate(base))) for k in range(60)]
    got = {r["doc_id"] for r in nearcopies.deduplicated(prepared.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(dict(rows), got)


@pytest.mark.parametrize("most", [1, 8_000_000])
def test_rounds_and_wholes_leave_no_near_copies(prepared, most):
    """Texts of a group compared in one task, or in rounds where it is too large for one."""
    rng = np.random.default_rng(4)
    base = [f"v{k}" for k in range(150)]
    texts = {k: " ".join(w if rng.random() > 0.012 else f"x{k}{j}" for j, w in enumerate(base)) for k in range(40)}
    rows = [(k, k, 1, s) for k, t in texts.items() for s in [np.unique((nearcopies.shingles(t) >> np.uint64(32)).astype("<u4"))]]
    table = [(k, k1, k2, len(s), [int(x) for x in np.array(nearcopies.bands(s), np.uint64).view(np.int64)], s.tobytes()) for k, k1, k2, s in rows]
    df = prepared.createDataFrame(table, "doc_id long, k1 long, k2 long, n int, bands array<long>, digests binary")
    gone = {r["k1"] for r in nearcopies.near_rows(df, None, most).collect()}
    pairs = brute_pairs(texts)
    assert gone and gone <= {b for _, b in pairs} and not [p for p in pairs if not set(p) & gone]


def test_odd_and_empty(odd, empty):
    out = nearcopies.deduplicated(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "4", "4", "6", "None"]
    assert nearcopies.deduplicated(empty).count() == 0


@pytest.mark.parametrize("size", [1, 4, 100])
def test_majority(size):
    rng = np.random.default_rng(size)
    h = rng.integers(0, 1 << 63, size, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > size)
    assert simhash.majority(h) == want
