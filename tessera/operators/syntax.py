"""Parsed source: reports of declarations, references and imports; structure graphs, chunks, types and code graphs from them.

A report is one row per file with nested arrays. Reports of other languages come from whatever parser made them; Python
source is parsed here by the standard library.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .chunking import CHUNK_KIND, DEFAULT_BYTES, cut_bytes, digest_id, normal_projects

PARAMETER = "struct<name:string,type:string,start:bigint,end:bigint>"
DECLARATION = (
    "struct<id:string,name:string,kind:string,parent_id:string,start:bigint,end:bigint,type:string,visibility:string,"
    f"modifiers:array<string>,attributes:array<string>,parameters:array<{PARAMETER}>>"
)
REFERENCE = "struct<name:string,kind:string,start:bigint,end:bigint>"
IMPORT = "struct<path:string,kind:string,start:bigint,end:bigint>"
REPORT = f"file_id string, valid boolean, symbols array<{DECLARATION}>, references array<{REFERENCE}>, imports array<{IMPORT}>, diagnostics array<{REFERENCE}>"


def outline(source: str) -> dict:
    """The report of one Python file; ranges are UTF-8 bytes. Source that does not parse has a diagnostic and no facts."""
    lines = source.encode().split(b"\n")
    before = [0]
    for line in lines:
        before.append(before[-1] + len(line) + 1)

    def span(node) -> tuple[int, int]:
        return before[node.lineno - 1] + node.col_offset, before[node.end_lineno - 1] + node.end_col_offset

    out = {"valid": True, "symbols": [], "references": [], "imports": [], "diagnostics": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        at = before[min(len(before) - 1, max(0, (getattr(e, "lineno", 1) or 1) - 1))]
        return out | {"valid": False, "diagnostics": [{"name": "syntax error", "kind": "error", "start": at, "end": at}]}

    def walk(node, parent: str, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            start, end = span(child) if hasattr(child, "lineno") else (0, 0)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                params, returns = [], None
                if not is_class:
                    a = child.args
                    params = [{"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None, "start": span(p)[0], "end": span(p)[1]} for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
                    returns = ast.unparse(child.returns) if child.returns else None
                name = f"{parent}/{len(out['symbols'])}"
                out["symbols"].append(
                    {
                        "id": name, "name": child.name, "kind": "class" if is_class else "method" if inside_class else "function", "parent_id": parent, "start": start, "end": end, "type": returns,
                        "visibility": "private" if child.name.startswith("_") else "public", "modifiers": ["async"] if isinstance(child, ast.AsyncFunctionDef) else [],
                        "attributes": [ast.unparse(d) for d in child.decorator_list], "parameters": params,
                    }
                )
                walk(child, name, is_class)
                continue
            if isinstance(child, ast.Import):
                out["imports"] += [{"path": a.name, "kind": "import", "start": start, "end": end} for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append({"path": "." * child.level + (child.module or ""), "kind": "from", "start": start, "end": end})
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    out["references"].append({"name": name, "kind": "call", "start": start, "end": end})
            elif isinstance(child, ast.Name):
                out["references"].append({"name": child.id, "kind": "write" if isinstance(child.ctx, ast.Store) else "read", "start": start, "end": end})
            walk(child, parent, inside_class and not isinstance(child, ast.Lambda))

    walk(tree, "", False)
    return out


def python_reports(files: DataFrame) -> DataFrame:
    """The reports of the Python files among files (id, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [{"file_id": i} | outline(c or "") for i, c in zip(df["id"], df["content"])]
            yield pd.DataFrame(rows, columns=["file_id", "valid", "symbols", "references", "imports", "diagnostics"])

    return importable(files).filter("language = 'python'").select("id", "content").mapInPandas(run, REPORT)


def search_symbols(reports: DataFrame) -> DataFrame:
    """(file_id, symbols) in the shape that boolean search filters on."""
    return reports.select("file_id", F.transform("symbols", lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("symbols"))


def report_problems(reports: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, problem): ranges outside the file (file_id, size) or turned round, and declarations without a name or id."""
    def bad(array: str) -> Column:
        return F.exists(array, lambda x: (x["start"] < 0) | (x["end"] < x["start"]) | (x["end"] > F.col("size")))

    ranged = reports.join(sizes, "file_id")
    unnamed = F.exists("symbols", lambda s: (F.coalesce(s["id"], F.lit("")) == "") | (F.coalesce(s["name"], F.lit("")) == ""))
    problem = F.when(bad("symbols") | bad("references") | bad("imports"), "range").when(unnamed, "name")
    return ranged.select("file_id", problem.alias("problem")).filter("problem is not null")


def report_agreement(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(file_id, problem): reports (file_id, language, digest) without a file (id, language, content), of another language,
    or of other content, and files without a report."""
    f = files.select(F.col("id").alias("file_id"), F.col("language").alias("l"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("d"))
    j = f.join(reports.select("file_id", "language", "digest"), "file_id", "full")
    problem = F.when(F.col("d").isNull(), "no file").when(F.col("digest").isNull(), "no report").when(F.col("l") != F.col("language"), "language").when(F.col("d") != F.col("digest"), "content")
    return j.select("file_id", problem.alias("problem")).filter("problem is not null")


def type_expression(text: Column) -> Column:
    """struct(kind, element) of a type expression's text: pointer, slice, array, map, channel, struct, interface, function,
    variadic, instantiation or named; element is what is pointed to, held, sent or repeated, null for the others.
    Parentheses around the whole are passed over."""
    t = F.trim(F.regexp_replace(F.trim(text), r"^\((.*)\)$", "$1"))
    rules = [
        ("pointer", r"^\*\s*(.+)$"), ("variadic", r"^\.\.\.\s*(.+)$"), ("slice", r"^\[\s*\]\s*(.+)$"), ("array", r"^\[[^\[\]]+\]\s*(.+)$"), ("channel", r"^(?:<-\s*)?chan\b(?:\s*<-)?\s*(.+)$"),
    ]
    whole = [("map", r"^map\s*\["), ("struct", r"^struct\b"), ("interface", r"^interface\b"), ("function", r"^func\b"), ("instantiation", r"^[\p{L}_][\p{L}\p{Nd}_.]*\s*\[.+\]$")]
    kind, element = F.lit("named"), F.lit(None).cast("string")
    for name, pattern in reversed(whole):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    for name, pattern in reversed(rules):
        kind, element = F.when(t.rlike(pattern), name).otherwise(kind), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(element)
    return F.struct(kind.alias("kind"), element.alias("element"))


def members(reports: DataFrame) -> DataFrame:
    """(file_id, type_id, id, kind, name, visibility, parameters, attributes) of the declarations directly in a class-like
    one: field, property, method, constructor or enum_member, whatever a parser's own name for it is."""
    s = reports.select("file_id", F.explode("symbols").alias("s"))
    owners = s.filter(F.col("s.kind").isin([k for k, v in CHUNK_KIND.items() if v == "type"])).select("file_id", F.col("s.id").alias("type_id"), F.col("s.kind").alias("owner"))
    s = s.withColumn("type_id", F.col("s.parent_id"))
    given = F.col("s.kind")
    kind = (
        F.when(given.isin("constructor") | F.col("s.name").isin("__init__", "constructor"), "constructor").when(given.isin("method", "function"), "method").when(given.isin("property", "accessor"), "property")
        .when(given.isin("enum_member", "enumerator") | ((F.col("owner") == "enum") & given.isin("constant", "field", "variable")), "enum_member").when(given.isin("field", "variable", "attribute", "constant"), "field")
    )
    sight = F.when(F.col("s.visibility").isin("public", "protected", "private", "internal"), F.col("s.visibility")).when(F.startswith(F.col("s.name"), F.lit("_")), "private").otherwise("unknown")
    out = s.join(owners, ["file_id", "type_id"]).select(
        "file_id", "type_id", F.col("s.id").alias("id"), kind.alias("kind"), F.col("s.name").alias("name"), sight.alias("visibility"), F.size("s.parameters").alias("parameters"), F.size("s.attributes").alias("attributes")
    )
    return out.filter("kind is not null")


def query(reports: DataFrame, name: str, passes: int = 32) -> DataFrame:
    """Reports with the declarations of that name and all below them, and the references that have the name, which is no
    claim that they resolve to it; files without such a declaration are left out."""
    first = F.transform(F.filter("symbols", lambda s: s["name"] == name), lambda s: s["id"])
    grow = f"aggregate(sequence(1, {passes}), picked, (a, i) -> array_union(a, transform(filter(symbols, s -> array_contains(a, s.parent_id)), s -> s.id)))"
    out = reports.withColumn("picked", first).filter(F.size("picked") > 0).withColumn("picked", F.expr(grow))
    return out.withColumns({"symbols": F.filter("symbols", lambda s: F.array_contains(F.col("picked"), s["id"])), "references": F.filter("references", lambda r: r["name"] == name)}).drop("picked")


def structure_graph(files: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of what reports observe: files contain declarations, parameters, imports and references; a file or a
    declaration declares the declarations directly in it; imports have no resolved target."""
    f = files.select(F.col("id").alias("file_id"), "path", "repository_id", normal_projects(F.col("project_ids")).alias("project_ids"), F.octet_length("content").cast("bigint").alias("size"))
    r = reports.join(f, "file_id")
    owner = ["file_id", "repository_id", "project_ids"]
    file_node = digest_id(F.lit("file"), F.col("file_id"))

    def nodes(df: DataFrame, kind: Column, name: Column, local: Column, start: Column, end: Column) -> DataFrame:
        return df.select(digest_id(kind, F.col("file_id"), local).alias("id"), kind.alias("kind"), name.alias("name"), *owner, start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    own = r.select(file_node.alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), *owner, F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    s = r.select(*owner, F.explode("symbols").alias("s"))
    p = s.select(*owner, "s", F.posexplode("s.parameters").alias("n", "p"))
    i = r.select(*owner, F.posexplode("imports").alias("n", "i"))
    x = r.select(*owner, F.posexplode("references").alias("n", "x"))
    parameter = F.concat_ws("/", "s.id", F.lit("parameter"), "n")
    reference = F.when(F.col("x.kind") == "call", "call").otherwise("reference")
    parts = [
        nodes(s, F.lit("declaration"), F.col("s.name"), F.col("s.id"), F.col("s.start"), F.col("s.end")),
        nodes(p, F.lit("parameter"), F.col("p.name"), parameter, F.col("p.start"), F.col("p.end")),
        nodes(i, F.lit("import"), F.col("i.path"), F.col("n"), F.col("i.start"), F.col("i.end")),
        nodes(x, reference, F.col("x.name"), F.col("n"), F.col("x.start"), F.col("x.end")),
    ]
    inner = parts[0]
    for q in parts[1:]:
        inner = inner.unionByName(q)
    declared = digest_id(F.lit("declaration"), F.col("file_id"), F.col("s.id"))
    above = F.when(F.col("s.parent_id") == "", file_node).otherwise(digest_id(F.lit("declaration"), F.col("file_id"), F.col("s.parent_id")))

    def edges(df: DataFrame, kind: str, source: Column, target: Column, resolution: str = "exact") -> DataFrame:
        return df.select(digest_id(F.lit(kind), source, target).alias("id"), F.lit(kind).alias("kind"), source.alias("source_id"), target.alias("target_id"), F.lit(resolution).alias("resolution"), "project_ids")

    links = edges(inner, "contains", digest_id(F.lit("file"), F.col("file_id")), F.col("id"))
    links = links.unionByName(edges(s, "declares", above, declared))
    links = links.unionByName(edges(p, "has_parameter", declared, digest_id(F.lit("parameter"), F.col("file_id"), parameter)))
    links = links.unionByName(edges(i, "imports", digest_id(F.lit("import"), F.col("file_id"), F.col("n")), F.lit(""), "unresolved"))
    return own.unionByName(inner), links


def signature(d: dict) -> str:
    out = d["name"]
    if len(d["parameters"]):
        out += "(" + ", ".join(p["name"] + (f": {p['type']}" if p["type"] else "") for p in d["parameters"]) + ")"
    return out + (f" -> {d['type']}" if d["type"] and d["kind"] in ("function", "method") else "")


def cut_declarations(content: str, symbols: list[dict], most: int) -> list[dict]:
    """Chunks that cover a file: root declarations and the gaps around them. A declaration above the bound keeps its range
    without text, and its children and the gaps between them follow as chunks of their own."""
    b, children = content.encode(), {}
    for s in sorted(symbols, key=lambda s: (s["start"], s["end"])):
        children.setdefault(s["parent_id"], []).append(s)
    out: list[dict] = []

    def gap(start: int, end: int, label: str, parent: int | None, split: bool) -> None:
        if start < end:
            ranges = cut_bytes(b[start:end].decode(), most)
            for a, z in ranges:
                out.append({"start": start + a, "end": start + z, "label": label, "parent": parent, "split": split or len(ranges) > 1, "fallback": True, "declaration": "", "kind": "fallback", "text": True})

    def emit(d: dict, parent: int | None) -> None:
        whole = d["end"] - d["start"] <= most
        me = len(out)
        out.append({"start": d["start"], "end": d["end"], "label": d["kind"], "parent": parent, "split": not whole, "fallback": False, "declaration": signature(d), "kind": CHUNK_KIND.get(d["kind"], "statement"), "text": whole})
        at = d["start"]
        for c in children.get(d["id"], []):
            if not whole:
                gap(at, c["start"], "syntax-gap", me, True)
            emit(c, me)
            at = c["end"]
        if not whole:
            gap(at, d["end"], "syntax-gap", me, True)

    roots = children.get("", [])
    if not roots:
        gap(0, len(b), "syntax-file", None, False)
        return out
    at = 0
    for d in roots:
        gap(at, d["start"], "syntax-gap", None, False)
        emit(d, None)
        at = d["end"]
    gap(at, len(b), "syntax-gap", None, False)
    return out


def syntax_chunks(files: DataFrame, reports: DataFrame, most: int = DEFAULT_BYTES) -> DataFrame:
    """(file_id, number, parent, start, end, kind, label, declaration, split, fallback, text) of files that have a report."""
    schema = "file_id string, number int, parent int, start bigint, end bigint, kind string, label string, declaration string, split boolean, fallback boolean, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for i, content, symbols in zip(df["file_id"], df["content"], df["symbols"]):
                b = (content or "").encode()
                for n, c in enumerate(cut_declarations(content or "", list(symbols), most)):
                    text = b[c["start"] : c["end"]].decode() if c["text"] else ""
                    rows.append((i, n, c["parent"], c["start"], c["end"], c["kind"], c["label"], c["declaration"], c["split"], c["fallback"], text))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            yield out.astype({"parent": "Int32"})

    joined = files.select(F.col("id").alias("file_id"), "content").join(reports.select("file_id", "symbols"), "file_id")
    return importable(joined).mapInPandas(run, schema)


def type_descriptors(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, file_id, name, qualified_name, kind, visibility, methods, member_count) of the class-like declarations."""
    s = reports.select("file_id", F.explode("symbols").alias("s"))
    types = s.filter(F.col("s.kind").isin([k for k, v in CHUNK_KIND.items() if v == "type"]))
    members = s.groupBy("file_id", F.col("s.parent_id").alias("owner")).agg(
        F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_list(F.when(F.col("s.kind") == "method", F.col("s.name")))).alias("methods")
    )
    out = types.join(members.withColumnRenamed("file_id", "m_file"), (F.col("file_id") == F.col("m_file")) & (F.col("s.id") == F.col("owner")), "left")
    out = out.join(files.select(F.col("id").alias("file_id"), "path", "repository_id"), "file_id")
    return out.select(
        digest_id(F.col("repository_id"), F.concat_ws("#", "file_id", "s.id")).alias("id"), "file_id", F.col("s.name").alias("name"), F.concat_ws("#", "path", "s.name").alias("qualified_name"), F.col("s.kind").alias("kind"),
        F.col("s.visibility").alias("visibility"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), F.coalesce("member_count", F.lit(0)).alias("member_count"),
    )


def code_graph(files: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of definitions and what refers to them. Files group by repository and project, and a file in several
    projects is in several groups; a name with one definition in the group is an exact target, with several a candidate
    one, without any unresolved. Calls hang from the innermost declaration around them."""
    from .graphs import contained_sites

    f = files.select(F.col("id").alias("file_id"), "repository_id", normal_projects(F.col("project_ids")).alias("project_ids"))
    r = reports.join(f, "file_id").withColumn("project", F.explode_outer("project_ids")).withColumn("project", F.coalesce("project", F.lit("")))
    s = r.select("file_id", "repository_id", "project", F.explode("symbols").alias("s"))
    x = r.select("file_id", "repository_id", "project", F.posexplode("references").alias("n", "x"))
    symbol = lambda local: digest_id(F.lit("symbol"), F.col("repository_id"), F.col("file_id"), local)
    nodes = s.select(symbol(F.col("s.id")).alias("id"), F.lit("symbol").alias("kind"), F.col("s.name").alias("name"), "file_id", "repository_id", "project")
    site = digest_id(F.lit("site"), F.col("repository_id"), F.col("file_id"), F.col("n"))
    sites = x.select(site.alias("id"), F.when(F.col("x.kind") == "call", "call_site").otherwise("reference").alias("kind"), F.col("x.name").alias("name"), "file_id", "repository_id", "project")
    nodes = nodes.unionByName(sites).groupBy("id", "kind", "name", "file_id", "repository_id").agg(F.array_sort(F.collect_set("project")).alias("project_ids"))
    targets = s.groupBy("repository_id", "project", F.col("s.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(symbol(F.col("s.id"))).alias("target_id"))
    used = x.select(site.alias("source_id"), F.col("x.name").alias("name"), F.col("x.kind").alias("use"), "repository_id", "project").join(targets, ["repository_id", "project", "name"], "left")
    kind = F.when(F.col("use") == "call", "calls").when(F.col("use") == "write", "writes").when(F.col("use") == "read", "reads").otherwise("references")
    resolution = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "exact").otherwise("candidate")
    target = F.when(F.col("n") == 1, F.col("target_id")).otherwise(F.lit(""))
    edges = used.select(kind.alias("kind"), "source_id", target.alias("target_id"), resolution.alias("resolution"), "project")
    nested = s.filter("s.parent_id <> ''").select(F.lit("member_of").alias("kind"), symbol(F.col("s.id")).alias("source_id"), symbol(F.col("s.parent_id")).alias("target_id"), F.lit("exact").alias("resolution"), "project")
    ranges = s.select(F.concat_ws("|", "project", "file_id").alias("file_id"), symbol(F.col("s.id")).alias("id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    calls = x.filter("x.kind = 'call'").select(F.concat_ws("|", "project", "file_id").alias("file_id"), site.alias("id"), F.col("x.start").alias("at"), "project")
    held = contained_sites(ranges, calls).join(calls.select(F.col("id").alias("site_id"), "project").distinct(), "site_id")
    inside = held.select(F.lit("contains").alias("kind"), F.col("owner_id").alias("source_id"), F.col("site_id").alias("target_id"), F.lit("exact").alias("resolution"), "project")
    every = edges.unionByName(nested).unionByName(inside).groupBy("kind", "source_id", "target_id", "resolution").agg(F.array_sort(F.collect_set("project")).alias("project_ids"))
    return nodes, every.withColumn("id", digest_id(F.col("kind"), F.col("source_id"), F.col("target_id"), F.col("resolution")))
