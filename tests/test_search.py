import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import tables
from tessera.functions import querylang as q
from tessera.functions.folding import fold_text
from tessera.operators import search


def files(spark, *texts, **extra):
    rows = []
    for k, t in enumerate(texts):
        row = {"id": chr(97 + k), "path": f"p{k}.go", "content": t, "project_ids": ["p"], "repository_id": "r", "snapshot_id": "s", "language": "go", "test": False, "generated": False, "symbols": []}
        rows.append(row | {n: v[k] for n, v in extra.items()})
    return spark.createDataFrame(rows, tables.FILE)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "text, want",
    [
        ("alpha beta", "a"), ("alpha NOT beta", "b"), ("alpha OR gamma AND NOT beta", "abc"), ("(alpha OR gamma) AND NOT beta", "bc"), ("NOT (alpha OR gamma)", "d"),
        ("ALPHA", "ab"), ('"alpha gamma"', "b"), ("/^alpha/", "ab"), ("lang:GO file:p2.go", "c"), ("path:p1", "b"), ("project:P repo:r alpha", "ab"), ("test:true", ""), ("NOT generated:true", "abcd"),
    ],
)
def test_boolean(spark, text, want):
    assert ids(search.matching(files(spark, "alpha\nbeta", "alpha gamma", "gamma", "beta"), text)) == list(want)


@pytest.mark.parametrize("text", ["", "alpha AND", "OR alpha", "()", "owner:me", "test:maybe", r'"bad\q"', '"x"y', "(alpha", "alpha)", "'open", "/(/", "/a(?=b)/", "NOT"])
def test_parse_errors(text):
    with pytest.raises(q.QueryError):
        q.parse(text)


def test_regex(spark):
    f = files(spark, "needle", "other", "prefixYYend", "end")
    assert ids(search.matching(f, "/needle|other/")) == ["a", "b"]
    assert ids(search.matching(f, "/(prefix.*)?end/")) == ["c", "d"]
    assert ids(search.matching(f, "NOT /needle|other/")) == ["c", "d"]
    assert ids(search.matching(f, "/end$/")) == ["c", "d"]


def test_folding_and_byte_ranges(spark):
    f = files(spark, "\U0001f600 Kelvin σςΣ")
    got = search.with_ranges(f, '"kelvin ΣΣΣ"').first()
    assert [(r["start"], r["end"]) for r in got["ranges"]] == [(5, 5 + 8 + 1 + 6)]
    assert ids(search.matching(f, "kelvin", case_sensitive=True)) == []
    assert fold_text("ıİ") == "ıİ"


def test_scope_and_page(spark):
    f = files(spark, "x", "x", "x", project_ids=[["p", "private"], ["p"], ["private"]])
    page, total = search.search(f, "x", projects=["p"], offset=1, limit=1)
    assert total.first()["total"] == 2
    assert [(r["id"], r["visible"]) for r in page.collect()] == [("b", ["p"])]


def test_budgets(spark):
    f = files(spark, "xx", "yyy", "z")
    assert ids(search.within_budget(f, max_files=1)) == ["a"]
    assert ids(search.within_budget(f, max_bytes=5)) == ["a", "b"]
    assert ids(search.within_budget(f, max_bytes=1)) == []


def test_range_cap(spark):
    got = search.with_ranges(files(spark, "a" * 1001), "a").first()
    assert len(got["ranges"]) == 1000 and got["ranges_truncated"]


def test_modes(spark):
    f = files(spark, "Alpha", "Alpha Beta")
    assert ids(search.matching(f, "alpha", mode="exact")) == ["a"]
    assert ids(search.matching(f, "^Alpha$", mode="regex")) == ["a"]


def test_symbols(spark):
    f = files(spark, "func Run() {}", symbols=[[("Run", "function", 5, 8)]])
    got = search.with_ranges(f, "symbol:run kind:function content:func").first()
    assert [(r["start"], r["end"]) for r in got["ranges"]] == [(0, 4), (5, 8)]


def test_trigram_candidates_hold_every_match(spark):
    f = files(spark, "xxneedlexx", "need le", "NEEDLE", "")
    index = search.trigram_index(f, 4)
    assert set(ids(search.matching(f, "needle"))) <= set(ids(search.candidates(search.trigram_index(f, 64), "needle")))
    assert {r["trigram"] for r in index.filter("id = 'a'").collect()} >= {fold_text("nee"), fold_text("edl"), fold_text("dle")}


def test_trigram_candidates_across_a_block_edge(spark):
    body = "x" * (search.BLOCK_CHARS - 3) + "stupid" + "y" * 9
    rows = [("edge", body), ("none", "x" * (search.BLOCK_CHARS + 9)), *[(f"at{k}", "z" * k + "stupid") for k in range(9)]]
    f = spark.createDataFrame(rows, "id string, content string")
    assert {r["id"] for r in search.candidates(search.trigram_index(f.filter("id IN ('edge', 'none')")), "stupid").collect()} == {"edge"}
    small = search.candidates(search.trigram_index(f.filter("id LIKE 'at%'"), 4), "STUPID")
    assert {r["id"] for r in small.collect()} == {f"at{k}" for k in range(9)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcABC ſKkσς", min_size=3, max_size=12))
def test_literal_trigrams_are_in_the_text(s):
    assert all(g in fold_text("xx" + s + "yy") for g in search.literal_trigrams(s))


def test_required_literal():
    assert search.required_literal("foo(bar)?bazqux") == "bazqux"
    assert search.required_literal("a|b") == ""


def test_lines_and_positions(spark):
    f = files(spark, "é\nab\n")
    got = [(r["line"], r["start"], r["end"], r["text"]) for r in search.lines(f).orderBy("line").collect()]
    assert got == [(0, 0, 2, "é"), (1, 3, 5, "ab"), (2, 6, 6, "")]
    at = spark.createDataFrame([("a", 4)], "id string, offset bigint")
    assert [tuple(r) for r in search.positions(f, at).collect()] == [("a", 4, 1, 1)]
