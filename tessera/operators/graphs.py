"""Graph tables: merging, scope, validation, one-hop queries, traversal, paths, descendants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DEPTH, DEFAULT_DEPTH, MAX_NODES, MAX_EDGES, MAX_PATHS, MAX_TARGETS = 12, 4, 2000, 5000, 100, 1000
#: The edge kinds of the one-hop modes.
INCOMING = {"references": "references", "callers": "calls", "reads": "reads", "writes": "writes"}


def merge(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per id, that of the first shard; ids that shards disagree on) of rows that repeat an id."""
    rest = [c for c in shards.columns if c not in ("id", "shard")]
    seen = shards.select("id", "shard", F.struct(*rest).alias("row"), F.xxhash64(*rest).alias("payload"))
    one = seen.groupBy("id").agg(F.min_by("row", F.struct("shard", "payload")).alias("row"), F.min("payload").alias("a"), F.max("payload").alias("b"))
    return one.select("id", "row.*").select(*[c for c in shards.columns if c != "shard"]), one.filter("a <> b").select("id")


def capped(df: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` rows in the order given, each with truncated: whether there were more."""
    w = Window.orderBy(*order)  # over limit + 1 rows
    top = df.orderBy(*order).limit(limit + 1).withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy()))
    return top.filter(F.col("__n") <= limit).withColumn("truncated", F.col("__all") > limit).drop("__n", "__all")


def scope(nodes: DataFrame, edges: DataFrame, projects: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Nodes of any of the projects, and edges of any of them with both ends kept."""
    if projects:
        wanted = F.array(*map(F.lit, projects))
        nodes, edges = nodes.filter(F.arrays_overlap("project_ids", wanted)), edges.filter(F.arrays_overlap("project_ids", wanted))
    ids = nodes.select("id")
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return nodes, edges


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): repeated node ids, repeated edge ids, edges without a source or a target."""
    ids = nodes.select("id")

    def repeated(df, name):
        return df.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")

    def missing(end):
        lost = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"no {end}").alias("problem"), "n")

    out = repeated(nodes, "repeated node").unionByName(repeated(edges, "repeated edge"))
    return out.unionByName(missing("source_id")).unionByName(missing("target_id"))


def by_name(nodes: DataFrame, name: str, limit: int = MAX_TARGETS) -> DataFrame:
    """The nodes of a name, the first `limit` by id, with truncated."""
    return capped(nodes.filter(F.col("name") == name), limit, "id")


def incoming(nodes: DataFrame, edges: DataFrame, target: str, mode: str = "references", limit: int = MAX_EDGES) -> DataFrame:
    """Edges of the mode's kind into the target, with the names of where they come from; the first by id, with truncated."""
    hit = edges.filter((F.col("target_id") == target) & (F.col("kind") == INCOMING[mode]))
    return hit.join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").transform(capped, limit, "id")


def outgoing(nodes: DataFrame, edges: DataFrame, source: str, kinds: list[str], limit: int = MAX_EDGES) -> DataFrame:
    """Edges of the kinds out of the source, with the names of where they lead; the first by id, with truncated."""
    hit = edges.filter((F.col("source_id") == source) & F.col("kind").isin(kinds))
    return hit.join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target_name")), "target_id").transform(capped, limit, "id")


def callees(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """(site_id, callee_id, resolution): calls made at the call sites that a symbol contains."""
    sites = edges.filter((F.col("source_id") == symbol) & (F.col("kind") == "contains")).select(F.col("target_id").alias("site_id"))
    sites = sites.join(nodes.filter("kind = 'call_site'").select(F.col("id").alias("site_id")), "site_id", "left_semi")
    calls = edges.filter("kind = 'calls'").select(F.col("source_id").alias("site_id"), F.col("target_id").alias("callee_id"), "resolution")
    return sites.join(calls, "site_id")


def neighbours(edges: DataFrame, start: str, depth: int = DEFAULT_DEPTH, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """(id, depth) reached from start over edges in either direction, nearest max_nodes (None: all); depth as given, at most 12.

    Level by level: a level joins the edges with the frontier, and what was seen is removed by an anti-join. Under a node
    budget the frontier can't outgrow it, so each level is a broadcast join; without one, levels are shuffle joins and
    nothing comes to the driver.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth out of bounds")
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(start, 0)], "id string, depth int")
    if max_nodes is None:
        links = edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"))
        links = links.unionByName(links.select(F.col("to").alias("from"), F.col("from").alias("to")))
        for level in range(1, depth + 1):
            found = frontier.join(links, F.col("id") == F.col("from")).select(F.col("to").alias("id")).distinct()
            frontier = found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level))
            seen = seen.unionByName(frontier)
        return seen
    total = 1
    for level in range(1, depth + 1):
        ids = F.broadcast(frontier.select(F.col("id").alias("from")))
        forth = edges.join(ids, F.col("source_id") == F.col("from")).select(F.col("target_id").alias("id"))
        back = edges.join(ids, F.col("target_id") == F.col("from")).select(F.col("source_id").alias("id"))
        found = forth.unionByName(back).distinct().join(F.broadcast(seen.select("id")), "id", "left_anti")
        rows = [r["id"] for r in found.orderBy("id").limit(max_nodes - total).collect()]  # at most max_nodes ids
        if not rows:
            break
        frontier = spark.createDataFrame([(r, level) for r in rows], "id string, depth int")
        seen, total = seen.unionByName(frontier), total + len(rows)
        if total >= max_nodes:
            break
    return seen


def notices(result: DataFrame, whole: DataFrame, edges: DataFrame | None = None) -> list[str]:
    """Notices of a capped mode's result: NODE_BUDGET if whole, the same mode with a larger limit, has more rows;
    CANDIDATE_TARGET if an edge among edges, those returned, has a candidate target."""
    out = ["NODE_BUDGET"] if whole.limit((n := result.count()) + 1).count() > n else []
    if edges is not None and not edges.filter("resolution = 'candidate'").isEmpty():
        out.append("CANDIDATE_TARGET")
    return out


def status(notes: list[str], partial: bool = False, supported: bool = True) -> str:
    """complete, partial (a budget was reached, or partial: a shard is missing or incomplete) or unsupported."""
    return "unsupported" if not supported else "partial" if partial or "NODE_BUDGET" in notes else "complete"


def paths(edges: DataFrame, start: str, goal: str, depth: int = DEFAULT_DEPTH, limit: int = MAX_PATHS) -> DataFrame:
    """Simple directed paths from start to goal, by length and then node ids: path (ids joined by >), length, truncated. A
    path ends where it meets the goal.

    Nodes from which the goal can be reached in so many steps are found first, backwards from the goal, one set per level;
    forward steps keep to them, so no prefix is made that cannot be completed.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError("depth out of bounds")
    links = edges.select("source_id", "target_id").distinct()
    now = edges.sparkSession.createDataFrame([([start], start)], "path array<string>, at string")
    near = [edges.sparkSession.createDataFrame([(goal,)], "target_id string")]  # by the steps that are left
    for _ in range(depth - 1):
        near.append(near[-1].union(links.join(near[-1], "target_id", "left_semi").select("source_id")).distinct())
    done = None
    for k in range(depth):
        ahead = links.join(near[depth - 1 - k], "target_id", "left_semi")
        step = now.join(ahead, F.col("at") == F.col("source_id")).filter(~F.array_contains("path", F.col("target_id")))
        step = step.select(F.concat("path", F.array("target_id")).alias("path"), F.col("target_id").alias("at"))
        hit = step.filter(F.col("at") == goal)
        done = hit if done is None else done.unionByName(hit)
        now = step.filter(F.col("at") != goal)
    return capped(done.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("length")), limit, "length", "path")


def descendants(edges: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, id, depth, cut): what each root (column id) contains, directly or not, at its least depth; cut where the depth
    ended the walk although the node contains something."""
    links = edges.filter("kind = 'contains'").select("source_id", "target_id")
    now = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    every = now
    for level in range(1, depth + 1):
        now = now.join(links, F.col("id") == F.col("source_id")).select("root", F.col("target_id").alias("id"), F.lit(level).alias("depth")).distinct()
        every = every.unionByName(now)
    found = every.groupBy("root", "id").agg(F.min("depth").alias("depth"))
    parents = links.select(F.col("source_id").alias("id"), F.lit(True).alias("holds")).distinct()
    last = found.filter(F.col("depth") == depth).join(parents, "id", "left").select("root", "id", "depth", F.coalesce("holds", F.lit(False)).alias("cut"))
    return found.filter(F.col("depth") < depth).withColumn("cut", F.lit(False)).unionByName(last)


def structure(edges: DataFrame, seeds: list[str], depth: int = 2, max_nodes: int = 200) -> tuple[DataFrame, list[str]]:
    """(id, depth) over outgoing edges from the seeds, and the reasons for stopping early."""
    spark, notes = edges.sparkSession, []
    rows = [(s, 0) for s in sorted(set(seeds))[:max_nodes]]
    seen, frontier = {s for s, _ in rows}, [s for s, _ in rows]
    for level in range(1, depth + 1):
        nxt = edges.filter(F.col("source_id").isin(frontier)).select("target_id").distinct().filter(~F.col("target_id").isin(list(seen)))
        found = [r[0] for r in nxt.orderBy("target_id").limit(max_nodes - len(seen) + 1).collect()]
        if len(seen) + len(found) > max_nodes:
            notes.append("NODE_BUDGET")
            found = found[: max_nodes - len(seen)]
        rows += [(f, level) for f in found]
        seen |= set(found)
        frontier = found
        if not found or "NODE_BUDGET" in notes:
            break
    else:
        if frontier and not edges.filter(F.col("source_id").isin(frontier) & ~F.col("target_id").isin(list(seen))).isEmpty():
            notes.append("DEPTH_BUDGET")
    return spark.createDataFrame(rows, "id string, depth int"), notes


def completeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and edges per kind and resolution."""
    counts = [F.count_if((F.col("kind") == k) & (F.col("resolution") == r)).alias(f"{k}_{r}") for k in ("references", "calls", "contains") for r in ("exact", "candidate", "unresolved")]
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), *counts))


def shards(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with shard, edges with shard): a node belongs to its file, one without a file to the smallest file (id,
    repository_id, project_ids) of its repository that all its projects hold; an edge goes where its source is."""
    at = F.struct(F.col("f.id").alias("id"))
    loose = nodes.filter(F.coalesce("file_id", F.lit("")) == "").alias("n")
    fits = (F.col("n.repository_id") == F.col("f.repository_id")) & (F.size(F.array_except("n.project_ids", "f.project_ids")) == 0)
    placed = loose.join(files.alias("f"), fits).groupBy("n.id").agg(F.min(at)["id"].alias("shard"))
    owner = nodes.select("id", F.when(F.coalesce("file_id", F.lit("")) != "", F.col("file_id")).alias("own")).join(placed, "id", "left")
    owner = owner.select("id", F.coalesce("own", "shard").alias("shard"))
    return nodes.join(owner, "id"), edges.join(owner.withColumnRenamed("id", "source_id"), "source_id")


def foreign(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) of shard nodes (id, kind, file_id, shard, repository_id, project_ids) that their shard's file (id,
    repository_id, project_ids) does not own: no identity, no such file, another file's, another repository's, or projects
    that the file is not in."""
    f = files.select(F.col("id").alias("shard"), F.col("repository_id").alias("r"), F.col("project_ids").alias("p"))
    j = nodes.join(f, "shard", "left")
    blank = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("kind", F.lit("")) == "")
    problem = (
        F.when(blank, "identity").when(F.col("p").isNull(), "unknown file").when((F.coalesce("file_id", F.lit("")) != "") & (F.col("file_id") != F.col("shard")), "file")
        .when(F.col("repository_id") != F.col("r"), "repository").when(F.size(F.array_except("project_ids", "p")) > 0, "projects")
    )
    return j.select("id", problem.alias("problem")).filter("problem is not null")


def shared_projects(a: Column, b: Column) -> Column:
    """The projects of an edge between two nodes: those both are in, sorted; empty where there are none, and no edge."""
    return F.array_sort(F.array_intersect(a, b))


def answer(result: DataFrame, files: DataFrame, sharded: DataFrame, supported: bool = True) -> DataFrame:
    """One row about a mode's result (resolution where it has edges, truncated where it is capped) over files (id) with
    their shards (id, complete): status, rows, and notices, sorted. A file without a shard, an incomplete shard or a budget
    make it partial; without a graph projection it is unsupported."""
    none = F.lit(False)
    cut = F.coalesce(F.bool_or("truncated"), none) if "truncated" in result.columns else none
    candidate = F.coalesce(F.bool_or(F.col("resolution") == "candidate"), none) if "resolution" in result.columns else none
    told = result.agg(F.count(F.lit(1)).alias("rows"), cut.alias("cut"), candidate.alias("candidate"))
    s = files.select("id").join(sharded.select("id", "complete"), "id", "left").agg(F.coalesce(F.bool_or(F.col("complete").isNull()), none).alias("lost"), F.coalesce(F.bool_or(~F.col("complete")), none).alias("part"))
    marks = [("cut", "BUDGET"), ("candidate", "CANDIDATE_TARGET"), ("lost", "MISSING_SHARD")]
    notes = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in marks])))
    if not supported:
        notes = F.array(F.lit("UNSUPPORTED_VIEW"))
    state = F.when(F.lit(not supported), "unsupported").when(F.col("cut") | F.col("lost") | F.col("part"), "partial").otherwise("complete")
    return told.crossJoin(s).select(state.alias("status"), F.when(F.lit(supported), F.col("rows")).otherwise(0).alias("rows"), notes.alias("notices"))


def structures(counts: DataFrame, max_nodes: int = 200, max_edges: int = 5000) -> DataFrame:
    """(file_id, nodes, edges, stopped) of files (file_id, nodes, edges selected in each) taken in order of id while both
    budgets, shared by all files, last; the file that uses one up is the last, cut to what was left, and says so."""
    n = min(max_nodes, max_edges) + 1  # each file that counts uses at least a node
    top = counts.filter("nodes > 0").orderBy("file_id").limit(max(n, max_nodes + 1))
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    left = top.withColumns({"ln": max_nodes - F.coalesce(F.sum("nodes").over(before), F.lit(0)), "le": max_edges - F.coalesce(F.sum("edges").over(before), F.lit(0))})
    kept = left.filter("ln > 0 and le > 0").withColumns({"n": F.least("nodes", "ln"), "e": F.least("edges", "le")})
    stopped = (F.col("ln") - F.col("n") <= 0) | (F.col("le") - F.col("e") <= 0)
    return kept.select("file_id", F.col("n").alias("nodes"), F.col("e").alias("edges"), stopped.alias("stopped"))


def resolve_references(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References (id, name, file_id) against definitions (name, id): exact with one target, candidate with several,
    unresolved without any."""
    targets = definitions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target_id"))
    out = references.join(targets, "name", "left")
    resolution = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "exact").otherwise("candidate")
    return out.select("id", "name", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"), resolution.alias("resolution"))


def contained_sites(ranges: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, owner_id): the innermost range (file_id, id, start, end) around each site (file_id, id, at)."""
    s = sites.select("file_id", F.col("id").alias("site_id"), "at")
    r = ranges.select("file_id", F.col("id").alias("owner_id"), "start", "end")
    hit = s.join(r, "file_id").filter("start <= at and at < end")
    w = Window.partitionBy("file_id", "site_id").orderBy(F.col("end") - F.col("start"), "owner_id")
    return hit.withColumn("n", F.row_number().over(w)).filter("n = 1").select("site_id", "owner_id")
