import math

import pytest
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions.folding import tokens
from tessera.operators import chunking, rank
from tessera.plans import retrieval


def chunk(spark, rows):
    base = {"file_id": "f", "repository_id": "r", "project_ids": [], "start": 0, "end": 0, "text": "", "header": "", "parent_id": "", "kind": "type", "split": False, "fallback": False, "representations": []}
    return spark.createDataFrame([base | r for r in rows], tables.CHUNK)


def test_tokens(spark):
    got = spark.range(1).select(tokens(F.lit("getPaymentService x2 ΣΑΣ")).alias("t")).first()["t"]
    assert sorted(got) == sorted(["getpaymentservice", "get", "paymentservice", "getpayment", "service", "x2", "σασ"])


def test_bm25_scope_and_camel(spark):
    c = chunk(spark, [{"id": "payment", "text": "type PaymentService struct{}", "project_ids": ["billing"]}, {"id": "service", "text": "type Service struct{}", "project_ids": ["other"]}])
    got = rank.bm25(c, "payment service", projects=["billing"]).collect()
    assert [(r["id"], r["rank"]) for r in got] == [("payment", 1)]
    assert rank.bm25(c, "nothing").count() == 0
    once, twice = (rank.bm25(c, x).filter("id = 'payment'").first()["score"] for x in ("payment", "payment payment"))
    assert twice == pytest.approx(2 * once)
    for bad in ({"k1": math.inf}, {"b": 2}, {"projects": [str(i) for i in range(129)]}):
        with pytest.raises(ValueError):
            rank.bm25(c, "x", **bad)


def test_fusion(spark):
    one = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    two = spark.createDataFrame([("y", 1), ("x", 2), ("x", 3)], "id string, rank int")
    got = {r["id"]: r for r in rank.fuse({"a": one, "b": two}).collect()}
    assert got["x"]["score"] == pytest.approx(1 / 61 + 1 / 62) and len(got["x"]["provenance"]) == 2


def test_cosine(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("s", [1.0]), ("n", [float("nan"), 1.0])], "id string, vector array<float>")
    got = [(r["id"], round(r["score"], 5)) for r in rank.cosine_top(v, [1.0, 0.0], 5).collect()]
    assert got == [("a", 1.0), ("b", 0.70711)]


def test_rerank_needs_one_score_each(spark):
    found = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2)], "id string, score double, rank int")
    good = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "id string, score double")
    assert [r["id"] for r in rank.rerank(found, good).orderBy("rank").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="finite score"):
        rank.rerank(found, good.limit(1)).collect()
    bad = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("c", 1.0)], "id string, score double")
    assert {r["id"]: r["problem"] for r in rank.validated_rerank(found, bad).collect()} == {"a": "repeated", "b": "missing", "c": "unknown"}


def test_structural(spark):
    c = chunk(spark, [{"id": "a", "text": "return 1"}, {"id": "b", "text": "return  22"}, {"id": "c", "text": "return x"}])
    assert [tuple(r)[1:] for r in rank.structural_groups(c).collect()] == [(2, "a")]
    found, _ = retrieval.retrieve(c, "return 7", "structural")
    assert sorted(r["id"] for r in found.collect()) == ["a", "b"]


def test_hybrid_without_vectors_says_so(spark):
    c = chunk(spark, [{"id": "a", "text": "alpha", "representations": [{"kind": "symbol", "text": "symbol: alpha"}]}])
    found, notes = retrieval.retrieve(c, "alpha", "hybrid")
    assert notes and [r["id"] for r in found.collect()] == ["a"]
    with pytest.raises(ValueError):
        retrieval.retrieve(c, "alpha", "other")


def context(spark, rows, **options):
    c = chunk(spark, rows)
    got = chunking.context(c, c.filter("id = 'root'"), **options).orderBy("position").collect()
    return [(r["id"], r["outcome"]) for r in got]


def test_context(spark):
    rows = [
        {"id": "root", "start": 0, "end": 20, "project_ids": ["p"]}, {"id": "child", "text": "child", "start": 0, "end": 5, "parent_id": "root", "project_ids": ["p"]},
        {"id": "other", "text": "other", "start": 6, "end": 9, "parent_id": "root", "project_ids": ["q"]}, {"id": "over", "text": "over", "start": 3, "end": 8, "parent_id": "root", "project_ids": ["p"]},
    ]
    assert context(spark, rows) == [("root", "taken"), ("child", "taken"), ("over", "duplicate_range"), ("other", "project_scope")]


def test_context_skips_what_does_not_fit(spark):
    rows = [{"id": "root", "parent_id": "big", "text": "x", "start": 0, "end": 1}, {"id": "big", "text": "y" * 7990, "start": 10, "end": 8000}, {"id": "kid", "text": "z", "start": 2, "end": 3, "parent_id": "root"}]
    assert context(spark, rows) == [("root", "taken"), ("big", "budget"), ("kid", "taken")]


@pytest.mark.parametrize("text", ["", "short", "é" * 3000, "line\n" * 900, "x" * 5000 + "\n" + "y" * 100])
def test_split(text):
    ranges = chunking.cut_bytes(text, 1024)
    b = text.encode()
    assert ranges[0][0] == 0 and ranges[-1][1] == len(b) and all(a[1] == z[0] for a, z in zip(ranges, ranges[1:]))
    assert all(z - a <= 1024 and b[a:z].decode() is not None for a, z in ranges)


def test_split_files(spark):
    f = spark.createDataFrame([("a", "p.txt", "word\n" * 500, [" p ", "p"], "r", "s", "text", False, False, [])], tables.FILE)
    got = chunking.split_files(f, 1024).orderBy("start").collect()
    assert "".join(r["text"] for r in got) == "word\n" * 500 and all(r["text"].endswith("\n") for r in got)
    assert got[0]["project_ids"] == ["p"] and got[0]["kind"] == "fallback" and "split=fallback" in got[0]["header"]


def test_representations(spark):
    reps = chunking.representations(F.lit("x error; panic(1); fmt.Errorf(2)"), F.lit("h"), F.lit("Run"), F.lit("doc"))
    got = spark.range(1).select(reps.alias("r")).first()["r"]
    assert [r["kind"] for r in got] == ["code", "symbol", "documentation", "context", "error", "api"]
    assert got[4]["text"] == "errors: Errorf, error, panic"


def test_declaration_problems(spark):
    rows = [("f", "a", "", 0, 10), ("f", "b", "a", 5, 12), ("f", "c", "zz", 1, 2), ("f", "d", "", 8, 20), ("f", "d", "", 30, 31)]
    d = spark.createDataFrame(rows, "file_id string, id string, parent_id string, start bigint, end bigint")
    got = {(r["id"], r["problem"]) for r in chunking.declaration_problems(d).collect()}
    assert got >= {("b", "outside parent"), ("c", "unknown parent"), ("d", "repeated"), ("d", "overlap")}
