"""The pipeline's stages against brute force, each on what its predecessor kept."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from tessera.llm import positional, secretscan, tokens
from tests.llm.test_bruteforce import brute_contamination, whole
from tests.llm.test_nearcopies import check

SF = "/root/testdata/sf0.01"


def test_stages(prepared):
    docs = prepared.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(prepared, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
    before, after = kept["near_dedup"]
    check(before, set(after))
    before, after = kept["decontamination"]
    items = [tuple(r) for r in prepared.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {i for i, _, hit, *_ in brute_contamination(before.items(), items) if not hit}
    before, after = kept["secrets"]
    rules = secretscan.BASE + secretscan.ADDED
    assert set(after) == set(before)
    for i, t in before.items():
        spans = secretscan.reference_spans(t, rules)
        assert (after[i] == t) == (not spans)
        assert not spans or all(t[a:z] not in after[i] for a, _, z in spans)
    before, after = kept["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in prepared.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = set(before) - set(after)
    assert lost and sum(labels.get(i, 1) == 0 for i in lost) <= 2  # what goes is toxic as far as labels tell
    assert positional.WINDOW == 10


def test_run(prepared):
    out = corpus_pipeline.run(prepared, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def tables(tmp_path, docs, labels, items):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_run_on_odd_and_empty_tables(prepared, odd, empty, labels, tmp_path):
    """Nulls, repeats, clashing columns, long texts: each kept document's ids once, in order, without gaps, within sequences."""
    items = prepared.createDataFrame([(7, "Some text here. And a second line."), (8, None)], "item_id long, text string")
    out = corpus_pipeline.run(prepared, tables(tmp_path / "odd", odd, labels, items)).collect()
    # Of nulls and blanks the first stays, of repeats one; document 1 has a benchmark item's words.
    assert sorted({str(r["doc_id"]) for r in out}) == ["2", "4", "6", "None"]
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["doc_tokens"] for r in out if r["start"] == 0) == sum(r["length"] for r in out)
    none = corpus_pipeline.run(prepared, tables(tmp_path / "none", empty, labels.limit(0), items.limit(0)))
    assert none.collect() == []


def test_run_packs_what_the_stages_kept(prepared):
    """The last stage against brute force: every id of every kept document, in order."""
    sf = "/root/testdata/sf0.001"
    docs = prepared.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(prepared, docs, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    encode = whole(tokens.WORD_BPE)
    got = defaultdict(list)
    for r in corpus_pipeline.run(prepared, sf).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*encode(t), 1], "<u4"), 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
