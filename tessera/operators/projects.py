"""Projects: glob membership, fingerprints, manifests; projection registry; risk; type catalogue; configuration keys."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import importable

# --- membership -------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """A rooted glob as a regular expression: * and ? stay within a component, [class] as in file names, ** as a whole
    component matches any number of them."""
    if not pattern or pattern.startswith("/") or re.search(r"[\\:\x00]", pattern):
        raise ValueError(f"invalid glob {pattern!r}")
    parts = pattern.split("/")
    for p in parts:
        if p in ("", ".", "..") or ("**" in p and p != "**"):
            raise ValueError(f"invalid glob {pattern!r}")
    out = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]*/)*"
            continue
        i = 0
        while i < len(p):
            c = p[i]
            if c == "[" and (close := p.find("]", i + 2)) > 0:
                body = p[i + 1 : close].replace("\\", "\\\\").replace("&&", "&\\&").replace("[", "\\[")
                out += f"[{body}]"
                i = close + 1
                continue
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
            i += 1
        if not last:
            out = out + "(?:/" if parts[k + 1 :] == ["**"] else out + "/"
            if parts[k + 1 :] == ["**"]:  # a final ** also matches no component at all
                return f"^{out}.*)?$"
    return f"^{out}$"


def in_root(repository: str, path: str, include: list[str], exclude: list[str]) -> Column:
    inside = F.col("repository_id") == repository
    rel = F.col("path")
    if path != ".":
        inside = inside & F.startswith(F.col("path"), F.lit(path + "/"))
        rel = F.substr("path", F.lit(len(path) + 2))
    if include:
        inside = inside & reduce(lambda a, b: a | b, [rel.rlike(glob_regex(g)) for g in include])
    for g in exclude:
        inside = inside & ~rel.rlike(glob_regex(g))
    return inside


def membership(files: DataFrame, roots: list[tuple[str, str, str, list[str], list[str]]]) -> DataFrame:
    """files plus members: sorted ids of the projects with a root (project, repository, path, include, exclude) that
    holds the file, empty where there is none. Definitions are configuration, so they compile into one expression
    that is evaluated where the file is read: no join and no shuffle."""
    by: dict[str, Column] = {}
    for project, repo, path, include, exclude in roots:
        inside = in_root(repo, path, include, exclude)
        by[project] = by[project] | inside if project in by else inside
    found = F.array_compact(F.array(*[F.when(by[p], F.lit(p)) for p in sorted(by)])) if by else F.array().cast("array<string>")
    return files.withColumn("members", found)


def definition_fingerprint(definitions: DataFrame) -> DataFrame:
    """(project_id, fingerprint) of root rows (project_id, repository_id, path, include, exclude, role, version), whatever
    their order and that of their globs."""
    root = F.struct("repository_id", "path", F.array_sort("include").alias("include"), F.array_sort("exclude").alias("exclude"), "role", "version")
    rows = definitions.select("project_id", F.to_json(root).alias("root")).groupBy("project_id").agg(F.array_sort(F.collect_list("root")).alias("roots"))
    return rows.select("project_id", F.sha2(F.concat_ws("\n", F.lit("definition/1"), "project_id", F.array_join("roots", "\n")).cast("binary"), 256).alias("fingerprint"))


def manifest_shards(files: DataFrame) -> DataFrame:
    """(shard, n, digest): files (path, content) by the first byte of their path's SHA-256; the digest is over the
    sorted entries path NUL sha256(content)."""
    shard = F.conv(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 2), 16, 10).cast("int")
    entry = F.concat("path", F.char(F.lit(0)), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    by = files.select(shard.alias("shard"), entry.alias("entry")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entry")).alias("e"))
    return by.select("shard", "n", F.sha2(F.array_join("e", "\n").cast("binary"), 256).alias("digest"))


def manifest_root(shards: DataFrame) -> DataFrame:
    """One row: the digest over all shards that have entries (at most 256 rows)."""
    rows = shards.groupBy().agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("shard", "digest"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["shard"], x["digest"])), "\n")
    return rows.select("n", F.sha2(text.cast("binary"), 256).alias("fingerprint"))


def source_fingerprint(memberships: DataFrame) -> DataFrame:
    """(project_id, n, fingerprint) over files (path, content, members): what a project's sources are, by content."""
    entry = F.concat_ws("|", "repository_id", "path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    rows = memberships.select(F.explode("members").alias("project_id"), entry.alias("entry"))
    # Two levels, so that no group holds all entries of a large project: first digests of 256 parts, then their digest.
    parts = rows.groupBy("project_id", F.substring(F.sha2(F.col("entry").cast("binary"), 256), 1, 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("entry")).alias("e"))
    digests = parts.select("project_id", "part", "n", F.sha2(F.array_join("e", "\n").cast("binary"), 256).alias("d"))
    whole = digests.groupBy("project_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "d"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["part"], x["d"])), "\n")
    return whole.select("project_id", "n", F.sha2(text.cast("binary"), 256).alias("fingerprint"))


# --- projections ------------------------------------------------------------------------------------

#: Projection families and what each one depends on.
DEPENDENCIES = {
    "source_text": [], "structure": ["source_text"], "symbol_type": ["source_text", "structure"], "reference": ["symbol_type"],
    "call": ["symbol_type", "reference"], "data_flow": ["reference", "call"], "system_graph": ["structure", "data_flow"],
    "history_change": [], "context": ["system_graph", "history_change"], "vector": ["system_graph", "context"],
}


def topological_order(dependencies: dict[str, list[str]]) -> list[str]:
    """Dependencies before dependants, alphabetical where that leaves a choice; cycles and unknown names raise."""
    for f, deps in dependencies.items():
        if unknown := [d for d in deps if d not in dependencies]:
            raise ValueError(f"{f} depends on unknown {unknown[0]}")
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(f: str) -> None:
        if state.get(f) == 1:
            raise ValueError(f"a cycle through {f}")
        if f not in state:
            state[f] = 1
            for d in sorted(dependencies[f]):
                visit(d)
            state[f] = 2
            out.append(f)

    for f in sorted(dependencies):
        visit(f)
    return out


def dependency_edges(spark: SparkSession, dependencies: dict[str, list[str]] = DEPENDENCIES) -> DataFrame:
    return spark.createDataFrame([(d, f) for f, deps in dependencies.items() for d in deps], "source string, family string")


def downstream(spark: SparkSession, changed: list[str], dependencies: dict[str, list[str]] = DEPENDENCIES) -> DataFrame:
    """(family): the changed families and everything that depends on them, however far; the registry is configuration."""
    hit = set(changed)
    for f in topological_order(dependencies):
        if hit & set(dependencies[f]):
            hit.add(f)
    return spark.createDataFrame([(f,) for f in sorted(hit)], "family string")


def chained_fingerprints(dependencies: dict[str, list[str]] = DEPENDENCIES, versions: dict[str, str] | None = None) -> dict[str, str]:
    """A family's fingerprint covers its version and its dependencies' fingerprints."""
    import hashlib

    out: dict[str, str] = {}
    for f in topological_order(dependencies):
        text = "\0".join([f, (versions or {}).get(f, "1"), *(out[d] for d in sorted(dependencies[f]))])
        out[f] = hashlib.sha256(text.encode()).hexdigest()
    return out


def readiness(states: DataFrame, families: list[str]) -> DataFrame:
    """(view_id, status, n) of rows (view_id, family, status): families without a row are not_requested."""
    spark = states.sparkSession
    grid = states.select("view_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in families], "family string")))
    full = grid.join(states, ["view_id", "family"], "left").withColumn("status", F.coalesce("status", F.lit("not_requested")))
    return full.groupBy("view_id", "status").agg(F.count(F.lit(1)).alias("n"))


# --- risk -------------------------------------------------------------------------------------------

#: The risk factors and their weights in hundredths.
RISK_WEIGHTS = {"complexity": 20, "churn": 15, "change_frequency": 15, "dependency_exposure": 15, "ownership": 10, "coverage_gap": 20, "confirmed_bugs": 5}


def risk(values: DataFrame, key: str) -> DataFrame:
    """(key, known_weight, sufficient, score, tier) of one column per factor, null meaning unknown: weights of the known
    factors are scaled to one, and there is a score only from seventy hundredths on."""
    known = sum((F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(F.lit(0)) for f, w in RISK_WEIGHTS.items()), F.lit(0))
    total = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in RISK_WEIGHTS.items()), F.lit(0.0))
    bad = reduce(lambda a, b: a | b, [F.col(f).isNotNull() & (F.isnan(F.col(f).cast("double")) | ~F.col(f).between(0, 100)) for f in RISK_WEIGHTS])
    checked = F.when(bad, F.raise_error(F.lit("risk values lie between 0 and 100")).cast("int")).otherwise(known)
    out = values.select(key, checked.alias("known"), total.alias("total"))
    score = F.when(F.col("known") >= 70, F.col("total") / F.col("known"))
    tier = F.when(score.isNull(), "insufficient").when(score < 34, "low").when(score < 67, "medium").otherwise("high")
    return out.select(key, (F.col("known") / 100).alias("known_weight"), (F.col("known") >= 70).alias("sufficient"), score.alias("score"), tier.alias("tier"))


def risk_breakdown(values: DataFrame, key: str) -> DataFrame:
    """(key, factor, known, value, weight, effective_weight, contribution): one row per factor."""
    known = sum((F.when(F.col(f).isNotNull(), F.lit(w)).otherwise(F.lit(0)) for f, w in RISK_WEIGHTS.items()), F.lit(0))
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value"), F.lit(w).alias("w")) for f, w in RISK_WEIGHTS.items()])
    out = values.select(key, known.alias("k"), F.explode(rows).alias("r"))
    share = F.when(F.col("r.value").isNotNull(), F.col("r.w") / F.col("k"))
    return out.select(key, F.col("r.factor").alias("factor"), F.col("r.value").isNotNull().alias("known"), F.col("r.value").alias("value"), (F.col("r.w") / 100).alias("weight"), share.alias("effective_weight"), (F.col("r.value") * share).alias("contribution"))


# --- types ------------------------------------------------------------------------------------------


def type_lookup(types: DataFrame, names: DataFrame, project: str | None = None, profile: str | None = None, version: str | None = None) -> DataFrame:
    """(query, status, n, first_id): exact, ambiguous or not_found for each asked name, simple or qualified, in scope."""
    for c, v in (("project_id", project), ("profile_id", profile), ("version_id", version)):
        if v:
            types = types.filter(F.col(c) == v)
    forms = types.select("id", F.explode(F.array_distinct(F.array("name", F.coalesce("qualified_name", "name")))).alias("query"))
    found = forms.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    out = names.join(found, "query", "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "exact").otherwise("ambiguous")
    return out.select("query", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "first_id")


#: What is counted of a type: the counter, and the member kind whose rows it counts.
MEMBER_KINDS = {
    "fields": "field", "properties": "property", "methods": "method", "constructors": "constructor", "constants": "constant", "enum_members": "enum_member",
}
#: What is added up over a type's members, where members state it.
MEMBER_SUMS = ("parameters", "returns", "generic_parameters", "occurrences", "attributes")


def member_counts(members: DataFrame) -> DataFrame:
    """(type_id and eleven counters) of member rows (type_id, kind, and of MEMBER_SUMS the columns there are, nested ones
    included): rows by kind, and sums; what no member states counts as zero, which proves nothing absent."""
    sums = [(F.coalesce(F.sum(c), F.lit(0)) if c in members.columns else F.lit(0)).cast("bigint").alias(c) for c in MEMBER_SUMS]
    return members.groupBy("type_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in MEMBER_KINDS.items()], *sums)


def type_problems(types: DataFrame, members: DataFrame) -> DataFrame:
    """(id, problem) of types (id, name, project_id, layout, evidence) and members (type_id, id): no identity, no name, a
    member without identity or with one that the type has twice, layout without evidence, a repeated type."""
    t = types.select("id", F.when(F.coalesce("id", F.lit("")) == "", "identity").when(F.coalesce("name", F.lit("")) == "", "name").when(F.col("layout").isNotNull() & F.col("evidence").isNull(), "layout").alias("problem"))
    m = members.groupBy("type_id", "id").agg(F.count(F.lit(1)).alias("n"))
    blank = m.filter(F.coalesce("id", F.lit("")) == "").select(F.col("type_id").alias("id"), F.lit("member identity").alias("problem"))
    twice = m.filter((F.coalesce("id", F.lit("")) != "") & (F.col("n") > 1)).select(F.col("type_id").alias("id"), F.lit("repeated member").alias("problem"))
    again = types.groupBy("id", "project_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated type").alias("problem"))
    return t.filter("problem is not null").unionByName(blank).unionByName(twice).unionByName(again).distinct()


#: The valid form of identities that callers choose.
CATALOG_ID = "^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"


def definition_problems(definitions: DataFrame, repositories: DataFrame) -> DataFrame:
    """(id, problem) of project definitions (id, workspace, name, description, roots: array<string> of repositories)
    against repositories (id, workspace): identity, sizes, unknown or foreign repositories."""
    own = F.when(~F.coalesce(F.col("id").rlike(CATALOG_ID), F.lit(False)), "identity").when(F.size("roots") > 128, "roots").when(F.length("name") > 256, "name").when(F.length("description") > 8192, "description")
    first = definitions.select("id", own.alias("problem")).filter("problem is not null")
    each = definitions.select("id", "workspace", F.explode(F.array_distinct("roots")).alias("r"))
    r = repositories.select(F.col("id").alias("r"), F.col("workspace").alias("w"))
    second = each.join(r, "r", "left").select("id", F.when(F.col("w").isNull(), "unknown repository").when(F.col("w") != F.col("workspace"), "foreign repository").alias("problem")).filter("problem is not null")
    return first.unionByName(second).distinct()


def compare_and_set(there: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions after, ids refused) of definitions (id, version, body) and changes (id, expected, body): a change counts
    if the stored version is the one expected (null: none stored); of several for one id the first by body."""
    one = changes.groupBy("id").agg(F.min(F.struct(F.col("body").alias("b"), F.col("expected").alias("e"))).alias("c")).select("id", F.col("c.b").alias("new"), F.col("c.e").alias("expected"))
    j = there.select("id", "version", "body").join(one.withColumn("asked", F.lit(True)), "id", "full")
    good = F.coalesce("asked", F.lit(False)) & F.col("version").eqNullSafe(F.col("expected"))
    after = j.filter(good | F.col("version").isNotNull()).select("id", F.when(good, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(good, F.col("new")).otherwise(F.col("body")).alias("body"))
    return after, j.filter(F.coalesce("asked", F.lit(False)) & ~good).select("id")


def constant_groups(constants: DataFrame) -> DataFrame:
    """Constants (group_id, position, name, type, expression) with the type and expression of the last earlier one in
    the group that states one."""
    w = Window.partitionBy("group_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stated = F.struct("type", "expression")
    carried = F.last(F.when(F.col("expression").isNotNull(), stated), ignorenulls=True).over(w)
    return constants.withColumn("c", carried).select("group_id", "position", "name", F.col("c.type").alias("type"), F.col("c.expression").alias("expression"))


# --- configuration keys -----------------------------------------------------------------------------

SAFE_KEY = r"^[A-Za-z_][A-Za-z0-9_.-]{0,127}$"


def config_kind(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(F.startswith(base, F.lit(".env")) | F.endswith(base, F.lit(".env")), "env")
        .when(base.rlike(r"\.json$"), "json").when(base.rlike(r"\.ya?ml$"), "yaml")
        .when(base.rlike(r"\.(toml|ini|conf|config|properties|tfvars|hcl|xml)$"), "opaque").otherwise("")
    )


def json_keys(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(id, name): key paths of JSON texts as a.b, a[] for elements; keys that aren't safe names are not descended into.
    Values never appear. Invalid JSON has no keys. Level by level over VARIANT, until a level holds nothing to descend
    into."""
    now = rows.select(F.col(id_column).alias("id"), F.lit("").alias("name"), F.try_parse_json(json_column).alias("v")).filter("v is not null")
    every = None
    view = f"json_level_{uuid.uuid4().hex}"
    while every is None or not now.isEmpty():
        now.createOrReplaceTempView(view)
        step = rows.sparkSession.sql(
            "SELECT j.id, CASE WHEN e.key IS NULL THEN concat(j.name, '[]') WHEN j.name = '' THEN e.key ELSE concat(j.name, '.', e.key) END AS name,"
            f" e.value AS v, e.key AS k FROM {view} j, LATERAL variant_explode(j.v) e WHERE e.key IS NULL OR e.key RLIKE '{SAFE_KEY}'"
        )
        keys = step.filter("k is not null").select("id", "name")
        every = keys if every is None else every.unionByName(keys)
        now = step.select("id", "name", "v").filter("schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%'")
    rows.sparkSession.catalog.dropTempView(view)
    return every.distinct()


def env_keys(text: str) -> list[tuple[str, int]]:
    """(name, line) of an environment file; lines inside a quoted value that spans lines aren't keys."""
    out, quote = [], None

    def still_open(s: str, q: str) -> bool:
        escaped = False
        for c in s:
            if escaped:
                escaped = False
            elif c == "\\" and q == '"':
                escaped = True
            elif c == q:
                return False
        return True

    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if quote:
            quote = quote if still_open(s, quote) else None
            continue
        m = None if s.startswith("#") else re.match(r"(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", s)
        if m:
            out.append((m[1], n))
            value = s[m.end() :].strip()
            if value[:1] in ("'", '"') and still_open(value[1:], value[0]):
                quote = value[0]
    return sorted(out)


def env_config_keys(files: DataFrame) -> DataFrame:
    """(id, name, line) of the env files among files (id, path, content)."""

    @F.pandas_udf("array<struct<name:string,line:int>>")
    def keys(texts):
        return texts.map(lambda t: [{"name": n, "line": k} for n, k in env_keys(t or "")])

    rows = importable(files).filter(config_kind(F.col("path")) == "env").select("id", F.explode(keys(F.col("content"))).alias("k"))
    return rows.select("id", F.col("k.name").alias("name"), F.col("k.line").alias("line"))
