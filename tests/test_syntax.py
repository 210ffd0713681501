from tessera import tables
from tessera.operators import chunking, graphs, syntax

SOURCE = '''import os
from a.b import c

class Étage:
    def up(self, n: int) -> int:
        return helper(n)

    async def _down(self):
        x = self.up(1)
        return x


def helper(n):
    return os.path.join(n)
'''


def files(spark, *sources, projects=None):
    rows = [(str(k), f"p{k}.py", s, projects[k] if projects else ["p"], "r", "s", "python", False, False, []) for k, s in enumerate(sources)]
    return spark.createDataFrame(rows, tables.FILE)


def test_outline():
    got = syntax.outline(SOURCE)
    b = SOURCE.encode()
    assert [(s["name"], s["kind"], s["visibility"]) for s in got["symbols"]] == [("Étage", "class", "public"), ("up", "method", "public"), ("_down", "method", "private"), ("helper", "function", "public")]
    assert all(b[s["start"] : s["end"]].decode().startswith(("class Étage", "def ", "async def ")) for s in got["symbols"])
    assert [i["path"] for i in got["imports"]] == ["os", "a.b"]
    assert {r["name"] for r in got["references"] if r["kind"] == "call"} == {"helper", "up", "join"}
    bad = syntax.outline("def x(:\n")
    assert not bad["valid"] and bad["diagnostics"] and not bad["symbols"]


def test_reports_and_queries(spark):
    f = files(spark, SOURCE, "x = 1\n", "def broken(:\n")
    reports = syntax.python_reports(f).cache()
    assert {r["file_id"]: r["valid"] for r in reports.collect()} == {"0": True, "1": True, "2": False}
    got = syntax.query(reports, "Étage").collect()
    assert len(got) == 1 and [s["name"] for s in got[0]["symbols"]] == ["Étage", "up", "_down"]
    sizes = f.selectExpr("id as file_id", "octet_length(content) as size")
    assert syntax.report_problems(reports, sizes).count() == 0
    assert syntax.report_problems(reports, sizes.selectExpr("file_id", "1 as size")).count() == 1
    assert syntax.search_symbols(reports).filter("file_id = '0'").first()["symbols"][0]["name"] == "Étage"
    t = syntax.type_descriptors(f, reports).collect()
    assert [(x["name"], x["methods"], x["member_count"], x["qualified_name"]) for x in t] == [("Étage", ["_down", "up"], 2, "p0.py#Étage")]


def test_structure_graph(spark):
    f = files(spark, SOURCE)
    nodes, edges = syntax.structure_graph(f, syntax.python_reports(f))
    count = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    assert count["file"] == 1 and count["declaration"] == 4 and count["parameter"] == 4 and count["import"] == 2 and count["call"] == 3
    kinds = {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()}
    assert kinds["declares"] == 4 and kinds["has_parameter"] == 4 and kinds["imports"] == 2 and kinds["contains"] == nodes.count() - 1
    exact = edges.filter("resolution = 'exact'")
    assert all(r["n"] == 0 for r in graphs.problems(nodes, exact).collect())


def test_chunks_cover_the_file(spark):
    f = files(spark, SOURCE, "x = 1\n" * 30)
    for most in (64, 4096):
        got = syntax.syntax_chunks(f, syntax.python_reports(f), most).orderBy("file_id", "number").collect()
        for i, source in enumerate((SOURCE, "x = 1\n" * 30)):
            b = source.encode()
            held = [False] * len(b)
            for c in got:
                if c["file_id"] == str(i) and c["text"]:
                    assert c["text"].encode() == b[c["start"] : c["end"]] and len(c["text"].encode()) <= most
                    held[c["start"] : c["end"]] = [True] * (c["end"] - c["start"])
            assert all(held)
    whole = [c for c in got if c["file_id"] == "0" and c["declaration"]]
    assert [c["declaration"] for c in whole] == ["Étage", "up(self, n: int) -> int", "_down(self)", "helper(n)"] and whole[1]["parent"] == whole[0]["number"]
    assert chunking.CHUNK_KIND["class"] == "type"


def test_code_graph(spark):
    f = files(spark, SOURCE, "def other():\n    helper(1)\n    up()\n", "def up():\n    pass\n", projects=[["p"], ["p"], ["q"]])
    nodes, edges = syntax.code_graph(f, syntax.python_reports(f))
    calls = {(r["kind"], r["resolution"], tuple(r["project_ids"])) for r in edges.filter("kind = 'calls'").collect()}
    assert ("calls", "exact", ("p",)) in calls and ("calls", "unresolved", ("p",)) in calls
    name = {r["id"]: r["name"] for r in nodes.collect()}
    other = next(i for i, n in name.items() if n == "other")
    found = {name[r["callee_id"]] for r in graphs.callees(nodes, edges, other).filter("resolution = 'exact'").collect()}
    assert found == {"helper", "up"}  # up of project p; the one in q is in another group
    assert edges.filter("kind = 'member_of'").count() == 2
