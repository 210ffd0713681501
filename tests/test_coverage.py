"""Registered queries against their SQL on the smallest tables, and what must raise."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, embeddings, graphs, policy, rank, search
from tessera.plans import catalog, coverage, ingest, retrieval
from tessera.sources import files as sources
from tessera.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MINE = sorted(k for k, f in catalog.QUERIES.items() if f.__module__ == coverage.__name__)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None else round(float(v), 6) if isinstance(v, (float, Decimal)) else v if isinstance(v, str) else str(v)


@pytest.mark.parametrize("name", MINE)
def test_agrees_with_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    found = sql.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda rs, at: sorted(tuple(str(plain(r[i])) for i in at) for r in rs)
    assert rows(got.select(*names).collect(), range(len(names))) == rows(found.fetchall(), range(len(names)))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_literal_across_a_block_edge(spark):
    f = spark.createDataFrame([("a", "x" * 62 + "needle" + "y" * 62), ("b", "need le")], "id string, content string")
    assert [r["id"] for r in search.candidates(search.trigram_index(f, 64), "needle").collect()] == ["a"]


def test_semantic_scope_comes_before_the_cut(spark):
    rows = [(str(k), [1.0, k / 1000.0]) for k in range(160)]
    vectors = spark.createDataFrame(rows, "id string, vector array<float>")
    c = spark.createDataFrame([(str(k), ["far" if k >= 150 else "near"], "r", "t", "") for k in range(160)], "id string, project_ids array<string>, repository_id string, text string, header string")
    found, _ = retrieval.retrieve(c, "q", "semantic", 20, projects=["far"], vectors=vectors, query_vector=[1.0, 0.0])
    assert [(r["id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(str(k), k - 149) for k in range(150, 160)]


def test_bm25_reads_the_text_once(spark):
    plan = rank.bm25(catalog.chunks(spark, SF), "the nation", limit=5)
    plan.collect()
    text = plan._jdf.queryExecution().toString()
    assert "ReusedExchange" in text


def test_first_shard_wins(spark):
    s = spark.createDataFrame([("a", "two", 2), ("a", "one", 1), ("b", "same", 1), ("b", "same", 2)], "id string, name string, shard int")
    one, conflicts = graphs.merge(s)
    assert sorted(map(tuple, one.collect())) == [("a", "one"), ("b", "same")] and [r["id"] for r in conflicts.collect()] == ["a"]


def test_caps_say_so(spark):
    e = spark.createDataFrame([(f"e{k}", "contains", "a", f"x{k}", "exact", ["p"]) for k in range(5)] + [("z", "contains", "x0", "y", "exact", ["p"])], "id string, kind string, source_id string, target_id string, resolution string, project_ids array<string>")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["cut"] for r in graphs.descendants(e, roots, 1).collect()} == {"a": False, "x0": True, **{f"x{k}": False for k in range(1, 5)}}
    assert [tuple(r) for r in graphs.paths(e, "a", "y", 3, 1).collect()] == [("a>x0>y", 2, False)]
    n = spark.createDataFrame([(str(k), "s") for k in range(4)], "id string, name string")
    assert [r["truncated"] for r in graphs.by_name(n, "s", 3).collect()] == [True] * 3
    assert [r["truncated"] for r in graphs.by_name(n, "s", 4).collect()] == [False] * 4


def test_answer_without_a_projection(spark):
    none = spark.createDataFrame([], "id string, resolution string")
    f = spark.createDataFrame([("f",)], "id string")
    r = graphs.answer(none, f, f.withColumn("complete", F.lit(True)), supported=False).first()
    assert tuple(r) == ("unsupported", 0, ["UNSUPPORTED_VIEW"])
    assert tuple(graphs.answer(none, f, f.withColumn("complete", F.lit(True))).first()) == ("complete", 0, [])


def test_views_are_published_whole_and_once(spark, tmp_path):
    base = f"file://{tmp_path}/views"
    a, b = (spark.createDataFrame([(k, "x")], "id int, text string") for k in (1, 2))
    sources.publish(spark, base, "v1", {"files": a}, None)
    sources.publish(spark, base, "v1", {"files": a}, "v1")  # the same again
    with pytest.raises(RuntimeError, match="other rows"):
        sources.publish(spark, base, "v1", {"files": b}, "v1")
    sources.publish(spark, base, "v2", {"files": b}, "v1")
    with pytest.raises(RuntimeError, match="moved"):
        sources.publish(spark, base, "v3", {"files": a}, "v1")
    assert sources.head(spark, base) == "v2"
    assert [r["id"] for r in sources.artifacts(spark, base, "files", "v1").collect()] == [1]
    assert not list(tmp_path.glob("views/_staging/*"))


def test_two_outcomes_leave_one_job(spark):
    j = spark.createDataFrame([("a", "running", 0, "w", 1, 1, 100)], "id string, status string, available_at long, owner string, fence long, attempts long, lease_until long")
    o = spark.createDataFrame([("a", "w", 1, "fail"), ("a", "w", 1, "complete"), ("a", "w", 2, "cancel"), ("a", "w", 1, "odd")], "id string, owner string, fence long, outcome string")
    assert [r["status"] for r in jobs.apply_outcome(j, o, 50).collect()] == ["succeeded"]


def raises(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_incomplete_reads_raise(spark):
    e = spark.createDataFrame([(str(k), "w", "v", "p") for k in range(3)], "id string, workspace_id string, view_id string, profile string")
    assert embeddings.scan(e, "w", "v", "p", 3).count() == 3
    raises(embeddings.scan(e, "w", "v", "p", 2), "more records")
    raises(sources.get(e, "id", "9"), "not exactly one row")
    raises(search.file(e, "9"), "not exactly one row")
    bundles = spark.createDataFrame([("x", "{}")], "id string, payload string")
    raises(sources.load_bundle(bundles, "x"), "digest")
    with pytest.raises(ValueError):
        sources.upsert(e, e.limit(1), "id", create=True)


def test_chunk_load_is_whole_or_not_at_all(spark):
    c = spark.createDataFrame([("c1", "f", "r", ["p"], 0, 4, "text", "h"), ("c2", "f", "r", ["p"], 4, 8, "more", "h")], "id string, file_id string, repository_id string, project_ids array<string>, start long, end long, text string, header string")
    f = spark.createDataFrame([("f", "r", ["p"], 8)], "id string, repository_id string, project_ids array<string>, size long")
    assert chunking.load(c, f, ["p"]).count() == 2 and chunking.load(c, f, ["q"]).count() == 0
    raises(chunking.load(c, f, max_chunks=1), "too large")
    raises(chunking.load(c, f, max_bytes=9), "too large")
    raises(chunking.load(c, f.withColumn("size", F.lit(7))), "invalid chunks")


def test_ingest_refuses_what_capture_would(spark):
    kind = "path string, content string, size int, language string, blob_id string"
    good = spark.createDataFrame([("a.txt", "x", 1, "text", None)], kind).withColumn("blob_id", F.sha2("content", 256))
    assert ingest.checked(good).count() == 1
    raises(ingest.checked(good.withColumn("path", F.lit("../a"))), "invalid snapshot")
    raises(ingest.checked(good, max_files=0), "too large")
    assert [tuple(r) for r in policy.revalidated(good.withColumn("blob_id", F.lit("0"))).collect()] == [("a.txt", "digest")]


def test_records_must_fit_the_query(spark):
    r = spark.createDataFrame([("a", "v", "p", 2, "cosine", "ready", [1.0, 0.0]), ("b", "v", "p", 3, "cosine", "pending", [1.0])], "id string, view_id string, profile string, dimension int, distance string, completeness string, vector array<float>")
    assert [x["id"] for x in rank.record_rank(r, [1.0, 0.0], "v", "p").collect()] == ["a"]
    raises(rank.record_rank(r, [1.0, 0.0, 0.0], "v", "p"), "does not fit")


def test_ranges_of_repeated_ids_and_wide_characters(spark):
    kind = "id string, path string, content string, project_ids array<string>, repository_id string, language string, test boolean, generated boolean, symbols array<struct<name:string,kind:string,start:bigint,end:bigint>>"
    rows = [("a", "p", "é\U0001f600 one ONE", [], "r", "en", False, False, []), ("a", "q", "one", [], "r", "en", False, False, [])]
    got = search.with_ranges(spark.createDataFrame(rows, kind), "one", most=1).collect()
    assert sorted((r["path"], [tuple(x) for x in r["ranges"]], r["ranges_truncated"]) for r in got) == [("p", [(7, 10)], True), ("q", [(0, 3)], False)]


def test_deep_json_has_all_keys(spark):
    from tessera.operators import projects

    deep = '{"k":' * 12 + "1" + "}" * 12
    found = projects.json_keys(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j")
    assert max(len(r["name"].split(".")) for r in found.collect()) == 12
