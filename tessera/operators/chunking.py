"""Chunks: byte-bounded splitting, gaps, headers, representations; and context around a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import importable

MIN_BYTES, MAX_BYTES, DEFAULT_BYTES = 64, 65536, 4096
LOOKBACK = 512
CONTEXT_BYTES = 8000
CHUNK_KIND = {"class": "type", "interface": "type", "enum": "type", "struct": "type", "record": "type", "union": "type", "typedef": "type",
              "function": "function", "constructor": "method", "method": "method"}


def digest_id(*parts: Column) -> Column:
    """The first 16 bytes, in hex, of the SHA-256 of the parts with a zero byte between them."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), p.cast("string"))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def cut_bytes(content: str, most: int) -> list[tuple[int, int]]:
    """Byte ranges of at most `most` bytes that cover the text, never inside a code point, and, where a line ends within
    the last 512 bytes of a window, after it."""
    b = content.encode()
    if len(b) <= most:
        return [(0, len(b))]
    out, at = [], 0
    while at < len(b):
        end = at + most
        if end >= len(b):
            end = len(b)
        else:
            while end > at and b[end] & 0xC0 == 0x80:
                end -= 1
            line = b.rfind(b"\n", 0, end)
            if line >= 0 and line + 1 > end - LOOKBACK and line + 1 > at:
                end = line + 1
        out.append((at, end))
        at = end
    return out


def split_files(files: DataFrame, most: int = DEFAULT_BYTES) -> DataFrame:
    """One row per fallback chunk of a file: id, file_id, repository_id, project_ids, start, end, text, header, kind,
    split, fallback. A file within the bound is one chunk of kind file_fallback."""
    if not MIN_BYTES <= most <= MAX_BYTES:
        raise ValueError("chunk size out of bounds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for file_id, content in zip(df["id"], df["content"]):
                b = (content or "").encode()
                ranges = cut_bytes(content or "", most)
                out += [(file_id, a, z, b[a:z].decode(), len(ranges) > 1) for a, z in ranges]
            yield pd.DataFrame(out, columns=["file_id", "start", "end", "text", "split"])

    parts = importable(files).select("id", "content").mapInPandas(run, "file_id string, start bigint, end bigint, text string, split boolean")
    about = files.select(F.col("id").alias("file_id"), "repository_id", "project_ids", "language", "path")
    kind = F.when(F.col("split"), "fallback").otherwise("file_fallback")
    out = parts.join(about, "file_id").withColumn("kind", kind).withColumn("fallback", F.col("split"))
    out = out.withColumn("project_ids", normal_projects(F.col("project_ids")))
    out = out.withColumn("header", header(F.col("language"), F.col("path"), F.lit("file"), fallback=F.col("fallback"), split=F.col("split")))
    return out.withColumn("id", digest_id(F.col("repository_id"), F.col("file_id"), F.col("start"), F.col("end"), F.col("kind"), F.lit(""))).drop("language", "path")


def normal_projects(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda p: F.trim(p)), lambda p: p != "")))


def header(language: Column, path: Column, label: Column, declaration: Column | None = None, parent: Column | None = None, fallback: Column | None = None, split: Column | None = None) -> Column:
    def part(name: str, c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))

    cut = F.lit(None).cast("string") if fallback is None else F.when(fallback, "split=fallback").when(split, "split=syntax")
    return F.concat_ws(
        "; ", F.concat(F.lit("language="), language), F.concat(F.lit("path="), path), F.concat(F.lit("kind="), label),
        part("declaration=", declaration), part("parent=", parent), cut,
    )


def exported(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"^\p{Lu}")


def error_facts(text: Column) -> Column:
    """Distinct, sorted error words of a text: error, panic calls, Error/Errorf/New selectors."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(error\b|panic(?=\s*\()|(?<=\.)(?:Errorf|Error|New)\b)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def representations(text: Column, head: Column, declaration: Column, doc: Column) -> Column:
    """code, symbol, documentation, context, error, api: each only where its input is not empty, in this order."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    facts = error_facts(text)

    def rep(kind: str, body: Column, when: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(when, body).alias("text"))

    reps = F.array(
        rep("code", text, has(text)),
        rep("symbol", F.concat(F.lit("symbol: "), declaration, F.lit("\n"), head), has(declaration)),
        rep("documentation", doc, has(doc)),
        rep("context", head, has(head)),
        rep("error", F.concat(F.lit("errors: "), F.array_join(facts, ", ")), F.size(facts) > 0),
        rep("api", F.concat(F.lit("api: "), declaration, F.lit("\n"), head), has(declaration) & exported(declaration)),
    )
    return F.filter(reps, lambda r: r["text"].isNotNull())


def gaps(declarations: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file_id, start, end): the ranges of a file that its root declarations (file_id, start, end) leave uncovered."""
    w = Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ends = sizes.select("file_id", F.col("size").alias("start"), F.col("size").alias("end"))
    marks = declarations.select("file_id", "start", "end").unionByName(ends)
    return marks.select("file_id", F.coalesce(F.max("end").over(w), F.lit(0)).alias("from"), F.col("start").alias("to")).filter(F.col("from") < F.col("to")).select("file_id", F.col("from").alias("start"), F.col("to").alias("end"))


def declaration_problems(declarations: DataFrame) -> DataFrame:
    """(file_id, id, problem) of declarations (file_id, id, parent_id, start, end): repeated ids, unknown parents, a
    child outside its parent, partial overlap of siblings."""
    d = declarations
    repeated = d.groupBy("file_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file_id", "id", F.lit("repeated").alias("problem"))
    p = d.select("file_id", F.col("id").alias("parent_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    child = d.filter("parent_id <> ''")
    unknown = child.join(p, ["file_id", "parent_id"], "left_anti").select("file_id", "id", F.lit("unknown parent").alias("problem"))
    outside = child.join(p, ["file_id", "parent_id"]).filter("start < ps or end > pe").select("file_id", "id", F.lit("outside parent").alias("problem"))
    w = Window.partitionBy("file_id", "parent_id").orderBy("start", "end", "id").rowsBetween(Window.unboundedPreceding, -1)
    overlap = d.withColumn("before", F.max("end").over(w)).filter("before > start").select("file_id", "id", F.lit("overlap").alias("problem"))
    return repeated.unionByName(unknown).unionByName(outside).unionByName(overlap)


def declaration_depths(declarations: DataFrame) -> DataFrame:
    """(file_id, id, depth) of declarations (file_id, id, parent_id): 0 for a root, null for one that hangs from no root,
    as in a cycle or below one, or under an unknown parent. Level by level until one finds nothing."""
    links = declarations.select("file_id", "id", "parent_id")
    now = links.filter("parent_id = ''").select("file_id", "id", F.lit(0).alias("depth"))
    every, level = now, 0
    while not now.isEmpty():
        level += 1
        above = now.select("file_id", F.col("id").alias("parent_id"))
        now = links.join(above, ["file_id", "parent_id"]).select("file_id", "id", F.lit(level).alias("depth"))
        every = every.unionByName(now)
    return links.select("file_id", "id").join(every, ["file_id", "id"], "left")


def chunk_problems(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) of chunks against the files of a view (id, repository_id, project_ids, size): identity, repeats,
    membership that is not the file's, ranges outside the file or unlike the text."""
    f = files.select(F.col("id").alias("file_id"), F.col("repository_id").alias("r"), F.col("project_ids").alias("p"), "size")
    j = chunks.join(f, "file_id", "left")
    same = (F.col("repository_id") == F.col("r")) & (F.col("project_ids") == F.col("p"))
    text = F.octet_length(F.coalesce("text", F.lit("")))
    ranged = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("size")) & ((text == 0) | (text == F.col("end") - F.col("start")))
    problem = F.when(F.coalesce("id", F.lit("")) == "", "identity").when(F.col("r").isNull(), "unknown file").when(~same, "membership").when(~ranged, "range")
    twice = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id <> ''").select("id", F.lit("repeated").alias("problem"))
    return j.select("id", problem.alias("problem")).filter("problem is not null").unionByName(twice)


def load(chunks: DataFrame, files: DataFrame, projects: list[str] | None = None, max_chunks: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """The chunks of a scope, whole or not at all: problems of any chunk, and a scope above either budget, raise when the
    plan runs. The check is one row beside the chunks, so nothing is collected."""
    scope = chunks.filter(F.arrays_overlap("project_ids", F.array(*map(F.lit, projects)))) if projects else chunks
    bad = chunk_problems(chunks, files).agg(F.count(F.lit(1)).alias("bad"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce("header", F.lit("")))
    sums = scope.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).crossJoin(bad)
    reason = F.when(F.col("bad") > 0, "invalid chunks").when((F.col("n") > max_chunks) | (F.col("bytes") > max_bytes), "scope too large")
    ok = sums.select(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")).alias("__ok"))
    return scope.crossJoin(F.broadcast(ok)).filter("__ok").drop("__ok")


def by_file(chunks: DataFrame) -> DataFrame:
    """(file_id, n, chunk_ids) in order of start, end and id: what a view keeps for a file. Ids only, no texts."""
    return chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "id"))), lambda c: c["id"]).alias("chunk_ids"))


def item_bytes() -> Column:
    fields = ["id", "file_id", "parent_id", "header", "text"]
    return sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in fields[1:]), F.octet_length(fields[0]))


def context(chunks: DataFrame, roots: DataFrame, budget: int = CONTEXT_BYTES, projects: list[str] | None = None, profile: str = "") -> DataFrame:
    """Per root id and candidate (the root, its parent, its direct children by start and id): taken, or omitted for
    project_scope, duplicate_range or budget. Candidates that don't fit are skipped and later ones still tried.

    Three equi-joins gather the candidates; the greedy choice is a fold over one root's candidates.
    """
    if not 1 <= budget <= CONTEXT_BYTES:
        raise ValueError("budget out of bounds")
    cols = ["id", "file_id", "repository_id", "project_ids", "start", "end", "text", "header", "parent_id"]
    c = chunks.select(*cols)
    root = roots.select(F.col("id").alias("root_id")).distinct().join(c, F.col("root_id") == F.col("id")).select("root_id", F.struct(*cols).alias("r"))
    as_struct = c.select(F.struct(*cols).alias("c"))
    itself = root.select("root_id", "r", F.lit(0).alias("place"), F.col("r").alias("c"))
    parent = root.join(as_struct, F.col("r.parent_id") == F.col("c.id")).select("root_id", "r", F.lit(1).alias("place"), "c")
    children = root.join(as_struct, F.col("r.id") == F.col("c.parent_id")).select("root_id", "r", F.lit(2).alias("place"), "c")
    allowed = F.col("r.project_ids") if not projects else F.array_intersect("r.project_ids", F.array(*map(F.lit, projects)))
    overlap = F.when(F.size(F.col("r.project_ids") if not projects else F.array(*map(F.lit, projects))) == 0, F.size("c.project_ids") == 0).otherwise(F.arrays_overlap("c.project_ids", allowed))
    same = (F.col("c.file_id") == F.col("r.file_id")) & (F.col("c.repository_id") == F.col("r.repository_id")) & overlap
    size = sum((F.octet_length(F.coalesce(F.col(f"c.{x}"), F.lit(""))) for x in ("file_id", "parent_id", "header", "text")), F.octet_length("c.id")) + len(profile.encode())
    every = itself.unionByName(parent).unionByName(children)
    item = F.struct("place", F.col("c.start").alias("start"), F.col("c.id").alias("id"), F.col("c.end").alias("end"), (F.coalesce(F.col("c.text"), F.lit("")) != "").alias("has"), size.cast("bigint").alias("size"), F.coalesce(same, F.lit(False)).alias("same"))
    gathered = every.select("root_id", item.alias("i")).groupBy("root_id").agg(F.array_sort(F.collect_list("i")).alias("items"))
    fold = f"""aggregate(items,
        cast(struct(0L as used, array() as ranges, array() as seen, array() as out)
             as struct<used:bigint,ranges:array<struct<start:bigint,end:bigint>>,seen:array<string>,out:array<struct<id:string,size:bigint,outcome:string>>>),
        (a, i) -> if(array_contains(a.seen, i.id), a,
          named_struct(
            'used', a.used + if(i.same and not (i.has and exists(a.ranges, r -> i.start < r.end and r.start < i.end)) and a.used + i.size <= {budget}, i.size, 0L),
            'ranges', if(i.has and i.same and not exists(a.ranges, r -> i.start < r.end and r.start < i.end) and a.used + i.size <= {budget},
                         concat(a.ranges, array(named_struct('start', i.start, 'end', i.end))), a.ranges),
            'seen', concat(a.seen, array(i.id)),
            'out', concat(a.out, array(named_struct('id', i.id, 'size', i.size, 'outcome',
                    case when not i.same then 'project_scope'
                         when i.has and exists(a.ranges, r -> i.start < r.end and r.start < i.end) then 'duplicate_range'
                         when a.used + i.size > {budget} then 'budget' else 'taken' end))))),
        a -> a.out)"""
    return gathered.select("root_id", F.posexplode(F.expr(fold)).alias("position", "o")).select("root_id", "position", F.col("o.id").alias("id"), F.col("o.size").alias("size"), F.col("o.outcome").alias("outcome"))
