"""Verified boolean search over files, spans of matches, and the trigram candidate index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import querylang as q
from ..functions.folding import fold, fold_text
from ..session import importable
from ..sources.files import get

MAX_QUERY_BYTES, MAX_LIMIT, DEFAULT_LIMIT, MAX_PROJECTS = 8192, 1000, 100, 128
MAX_RANGES = 1000
BLOCK_CHARS = 16 * 1024
ORDER = ["repository_id", "snapshot_id", "path", "id"]


def in_scope(projects: list[str] | None = None, repositories: list[str] | None = None, snapshots: list[str] | None = None) -> Column:
    """Membership of any project, one of the repositories, one of the snapshots; no list, no restriction."""
    out = F.lit(True)
    if projects:
        out = out & F.arrays_overlap("project_ids", F.array(*map(F.lit, projects)))
    if repositories:
        out = out & F.col("repository_id").isin(repositories)
    if snapshots:
        out = out & F.col("snapshot_id").isin(snapshots)
    return out


def visible_projects(projects: list[str] | None) -> Column:
    ids = F.col("project_ids") if not projects else F.array_intersect("project_ids", F.array(*map(F.lit, projects)))
    return F.array_sort(F.array_distinct(ids))


def matching(files: DataFrame, text: str, case_sensitive: bool = False, mode: str | None = None, **scope) -> DataFrame:
    """Every file that satisfies the query, in scope; unordered."""
    return files.filter(in_scope(**scope)).filter(q.predicate(q.parse(text), case_sensitive, mode))


def search(
    files: DataFrame, text: str, *, case_sensitive: bool = False, mode: str | None = None, offset: int = 0, limit: int = DEFAULT_LIMIT, **scope
) -> tuple[DataFrame, DataFrame]:
    """(one page of verified files in order, a one-row table with the exact total)."""
    if len(text.encode()) > MAX_QUERY_BYTES or not 1 <= limit <= MAX_LIMIT or offset < 0 or len(scope.get("projects") or ()) > MAX_PROJECTS:
        raise q.QueryError("query, limit, offset or scope out of bounds")
    found = matching(files, text, case_sensitive, mode, **scope)
    page = found.orderBy(*ORDER).offset(offset).limit(limit)
    return page.withColumn("visible", visible_projects(scope.get("projects"))), found.agg(F.count(F.lit(1)).alias("total"))


def within_budget(files: DataFrame, max_files: int = 100_000, max_bytes: int = 256 << 20) -> DataFrame:
    """The files of a scan in order up to the first one that would exceed either budget. The count bound is applied
    first as a top-n, so the running sum sees at most max_files + 1 rows."""
    first = files.select(*ORDER, F.octet_length("content").cast("bigint").alias("bytes")).orderBy(*ORDER).limit(max_files)
    so_far = F.sum("bytes").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes)


# --- spans ------------------------------------------------------------------------------------------


def _term_ranges(t: q.Term, text: str, case_sensitive: bool, mode: str | None) -> list[tuple[int, int]]:
    if t.mode == "regex" or mode == "regex":
        return [m.span() for m in re.finditer(t.value, text, 0 if case_sensitive else re.IGNORECASE)]
    body, value = (text, t.value) if case_sensitive else (fold_text(text), fold_text(t.value))
    if mode == "exact":
        return [(0, len(body))] if body == value else []
    out, at = [], body.find(value)
    while at >= 0:
        out.append((at, at + len(value)))
        at = body.find(value, at + len(value))
    return out


def _evaluate(tree, row: dict, case_sensitive: bool, mode: str | None) -> tuple[bool, list[tuple[int, int]]]:
    """Truth and spans: a negation has none, a disjunction those of its true sides, a conjunction both sides'."""
    if isinstance(tree, q.Not):
        return not _evaluate(tree.of, row, case_sensitive, mode)[0], []
    if isinstance(tree, (q.And, q.Or)):
        a, sa = _evaluate(tree.left, row, case_sensitive, mode)
        if isinstance(tree, q.And) and not a:
            return False, []
        b, sb = _evaluate(tree.right, row, case_sensitive, mode)
        if isinstance(tree, q.And):
            return b, sa + sb if b else []
        return a or b, (sa if a else []) + (sb if b else [])
    if tree.field == "content":
        spans = _term_ranges(tree, row["content"] or "", case_sensitive, mode)
        return bool(spans), spans
    name = {"repo": "repository_id", "lang": "language", "path": "path", "file": "path"}.get(tree.field)
    fits = lambda v: bool(_term_ranges(tree, v or "", case_sensitive, "regex" if tree.mode == "regex" else mode if tree.field in q.PARTIAL else "exact"))
    if tree.field in ("test", "generated"):
        return bool(row[tree.field]) == (tree.value.lower() == "true"), []
    if tree.field == "project":
        return any(map(fits, row["project_ids"])), []
    if tree.field in ("symbol", "kind"):
        hit = [s for s in row["symbols"] if fits(s["name" if tree.field == "symbol" else "kind"])]
        return bool(hit), [(-1 - s["start"], -1 - s["end"]) for s in hit]  # byte ranges as they are, marked
    value = row[name]
    return fits(value.rsplit("/", 1)[-1] if tree.field == "file" else value), []


def _byte_places(body: str):
    """code point offset → UTF-8 byte offset of a text, by one pass over it."""
    if body.isascii():
        return lambda i: i
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))).tolist()
    return ends.__getitem__


def with_ranges(files: DataFrame, text: str, case_sensitive: bool = False, mode: str | None = None, most: int = MAX_RANGES) -> DataFrame:
    """Matched files plus ranges (UTF-8 byte offsets, sorted, distinct, the first `most`) and ranges_truncated. One engine
    decides both what matches and where; a file's columns pass through beside its ranges, so files that share an id stay
    apart."""
    tree = q.parse(text)
    names = ["id", "path", "content", "project_ids", "repository_id", "language", "test", "generated", "symbols"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, ranges, cut = [], [], []
            for row in batch.select(names).to_pylist():
                ok, found = _evaluate(tree, row, case_sensitive, mode)
                hits.append(ok)
                if not ok:
                    continue
                size = _byte_places(row["content"] or "")
                every = sorted({(-1 - a, -1 - z) if a < 0 else (size(a), size(z)) for a, z in found})
                ranges.append([{"start": a, "end": z} for a, z in every[:most]])
                cut.append(len(every) > most)
            kept = batch.filter(pa.array(hits, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ranges, kind), pa.array(cut, pa.bool_())], names=[*batch.schema.names, "ranges", "ranges_truncated"])

    schema = StructType([*files.schema.fields, *spark_fields("ranges array<struct<start:bigint,end:bigint>>, ranges_truncated boolean")])
    return importable(files).mapInArrow(spans, schema)


def spark_fields(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def file(files: DataFrame, file_id: str) -> DataFrame:
    """One file of a view; an id that is not there raises when the plan runs."""
    return get(files, "id", file_id)


def scan_complete(files: DataFrame, max_files: int = 100_000, max_bytes: int = 256 << 20) -> DataFrame:
    """One row (files, bytes, complete): whether a scan within the budgets sees all files; sums alone, without an order."""
    sums = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length(F.coalesce("content", F.lit("")))), F.lit(0)).alias("bytes"))
    return sums.withColumn("complete", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))


def highlights(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, line, from, to): byte ranges (id, start, end) cut to the lines they touch, as offsets within the line; ranges
    of no width and line feeds mark nothing."""
    l, r = lines(files).alias("l"), ranges.alias("r")
    hit = (F.col("r.id") == F.col("l.id")) & (F.col("r.start") < F.col("l.end")) & (F.col("r.end") > F.col("l.start"))
    low, high = F.greatest("r.start", "l.start") - F.col("l.start"), F.least("r.end", "l.end") - F.col("l.start")
    return r.join(l, hit).select("l.id", "l.line", low.alias("from"), high.alias("to")).distinct()


# --- trigrams ---------------------------------------------------------------------------------------


def trigram_index(files: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """(id, block, trigram): distinct folded trigrams of each block of a file; blocks overlap by two characters."""
    body = fold(F.coalesce("content", F.lit("")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("body"), F.lit(1)), F.lit(block))
    cut = files.select("id", body.alias("body")).select("id", F.posexplode(F.transform(starts, lambda s: F.substr("body", s, F.lit(block + 2)))).alias("block", "part"))
    # A lookahead captures three characters at every step of one, so trigrams overlap; shorter parts have none.
    grams = F.array_distinct(F.regexp_extract_all("part", F.lit(r"(?s)(?=(...))."), F.lit(1)))
    return cut.select("id", "block", F.explode(grams).alias("trigram"))


def literal_trigrams(literal: str) -> list[str]:
    f = fold_text(literal)
    return sorted({f[i : i + 3] for i in range(len(f) - 2)})


def candidates(index: DataFrame, literal: str) -> DataFrame:
    """Ids of files whose blocks together hold all trigrams of the literal: a superset of the files containing it."""
    grams = literal_trigrams(literal)
    if not grams:
        return index.select("id").distinct()
    return index.filter(F.col("trigram").isin(grams)).groupBy("id").agg(F.countDistinct("trigram").alias("n")).filter(F.col("n") == len(grams)).select("id").distinct()


def regex_candidates(index: DataFrame, pattern: str) -> DataFrame:
    """Ids of files that a regular expression may match, by the longest text that its matches must contain."""
    return candidates(index, required_literal(pattern))


def required_literal(pattern: str) -> str:
    """The longest text every match of a regular expression contains; empty where there is none."""
    import re._constants as rc
    import re._parser as rp

    best, run = "", ""

    def walk(parsed) -> None:
        nonlocal best, run
        for op, arg in parsed:
            if op is rc.LITERAL:
                run += chr(arg)
            elif op is rc.SUBPATTERN:
                walk(arg[3])
                continue
            else:
                best, run = max(best, run, key=len), ""
                if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
                    walk(arg[2])
                    best, run = max(best, run, key=len), ""
        best = max(best, run, key=len)

    walk(rp.parse(pattern))
    return max(best, run, key=len)


def lines(files: DataFrame) -> DataFrame:
    """(id, line, start, end, text): each line of a file with its byte range, line feeds not included."""
    split = files.select("id", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("parts"))
    sizes = F.transform("parts", lambda p: F.octet_length(p).cast("bigint") + 1)
    out = split.withColumn("sizes", sizes).select("id", F.posexplode(F.arrays_zip("parts", "sizes")).alias("line", "p"))
    before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("p.sizes").over(before), F.lit(0))
    return out.select("id", "line", start.alias("start"), (start + F.col("p.sizes") - 1).alias("end"), F.col("p.parts").alias("text"))


def positions(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(id, offset, line, character): byte offsets as zero-based line and byte within it."""
    l = lines(files).alias("l")
    o = offsets.alias("o")
    hit = (F.col("o.id") == F.col("l.id")) & (F.col("o.offset") >= F.col("l.start")) & (F.col("o.offset") <= F.col("l.end"))
    return o.join(l, hit).select("o.id", "o.offset", F.col("l.line").alias("line"), (F.col("o.offset") - F.col("l.start")).alias("character"))
