"""Recall and precision of the toxicity operator and of the pipeline's stage on held-out rows, by language."""

from collections import Counter

import corpus_pipeline
from tessera.llm import compression

SF = "/root/testdata/sf0.1"


def test_recall_on_held_out_rows(prepared):
    docs, labels = (prepared.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scored = compression.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = scored.selectExpr("doc_id", "predicted", "toxic", "lang", "length(text) AS n").collect()
    tally = Counter()
    for r in rows:
        size = next(name for most, name in ((500, "under 500"), (2000, "to 2000"), (8000, "to 8000"), (1 << 40, "longer")) if (r["n"] or 0) < most)
        for group in ("all", r["lang"], size, *["not en"] * (r["lang"] != "en")):
            tally[group, r["toxic"], r["predicted"]] += 1
    for g in sorted({str(k[0]) for k in tally}):
        print(g, "recall", tally[g, 1, 1], "of", tally[g, 1, 1] + tally[g, 1, 0], "false", tally[g, 0, 1], "of", tally[g, 0, 1] + tally[g, 0, 0])
    share = lambda g, y: tally[g, y, 1] / (tally[g, y, 1] + tally[g, y, 0])
    assert share("all", 1) >= 0.7 and share("all", 0) <= 0.005
    assert share("en", 1) >= 0.85 and share("not en", 1) >= 0.5
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["toxicity"](prepared, docs, SF).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows if not r["predicted"]} <= kept  # the stage holds the operator's level
    assert not kept & {r["doc_id"] for r in rows if r["predicted"]}
