"""More registered queries: sources and sinks, ranges, parsed source, loads, graph answers, types, policy, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folding import fold
from ..operators import chunking, embeddings, graphs, policy, projects, rank, search, syntax
from ..sources import files as sources
from ..streaming import jobs
from ..tables import SYMBOL, chunks, files, graph, table
from . import ingest, retrieval
from .catalog import _COSINE, _G, _turn_reports, query

# --- sources and sinks ------------------------------------------------------------------------------


@query(
    """SELECT d.doc_id, d.doc_id % 5 = 0 AS test, contains(text, 'Code generated') AS generated, coalesce(n, 0) AS symbols, strlen(text) AS bytes
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id)"""
)
def view_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blob = F.sha2(F.col("text").cast("binary"), 256).alias("blob_id")
    path = F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "_test.go").otherwise(".go"))
    refs = d.select(F.col("doc_id").alias("id"), path.alias("path"), blob)
    blobs = d.select(blob, F.col("text").alias("content")).groupBy("blob_id").agg(F.min("content").alias("content"))
    symbols = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), F.lit("x").alias("name"), F.lit("function").alias("kind"), F.lit(0).cast("bigint").alias("start"), F.lit(1).cast("bigint").alias("end"))
    out = sources.view_files(refs, blobs, symbols)
    return out.select(F.col("id").alias("doc_id"), "test", "generated", F.size("symbols").cast("bigint").alias("symbols"), F.octet_length("content").cast("bigint").alias("bytes"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8)")
def lookup_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_custkey", "c_name")
    return sources.lookup(c, "k", ["3", "8", "5", "8"]).select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def point_get(spark, sf_dir):
    return sources.get(table(spark, sf_dir, "nation"), "n_nationkey", 7).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def list_page(spark, sf_dir):
    return sources.page(table(spark, sf_dir, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_custkey")


@query("SELECT event_type || '-' || user_id AS view_id, event_id AS seq FROM events ORDER BY event_id DESC LIMIT 1")
def latest_view(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return sources.latest(e.select(F.concat_ws("-", "event_type", "user_id").alias("view_id"), F.col("event_id").alias("seq")))


@query(
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'M ' WHEN 'view' THEN '??' WHEN 'purchase' THEN 'R ' ELSE ' D' END AS state FROM events)
SELECT user_id AS id, state, 'f' || event_id AS path, CASE WHEN state = 'R ' THEN 'o' || event_id END AS origin FROM e"""
)
def porcelain_status(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "M ").when(F.col("event_type") == "view", "??").when(F.col("event_type") == "purchase", "R ").otherwise(" D")
    entry = F.concat(state, F.lit(" f"), "event_id", F.char(F.lit(0)), F.when(state == "R ", F.concat(F.lit("o"), "event_id", F.char(F.lit(0)))).otherwise(""))
    raw = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.collect_list(entry), "").alias("raw"))
    return sources.status_rows(raw)


@query("SELECT n_regionkey AS id, '/w/' || n_nationkey AS path, sha256(n_name) AS head, CASE WHEN n_nationkey % 2 = 0 THEN 'refs/heads/' || n_nationkey END AS branch FROM nation")
def worktree_list(spark, sf_dir):
    zero = F.char(F.lit(0))
    branch = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("branch refs/heads/"), "n_nationkey")).otherwise("detached")
    block = F.concat(F.lit("worktree /w/"), "n_nationkey", zero, F.lit("HEAD "), F.sha2(F.col("n_name").cast("binary"), 256), zero, branch, zero, zero)
    raw = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_join(F.collect_list(block), "").alias("raw"))
    return sources.worktree_rows(raw)


@query(
    """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'unsafe_path' WHEN 1 THEN 'git' WHEN 2 THEN 'ignored' WHEN 3 THEN 'sensitive_name' WHEN 4 THEN 'oversize' WHEN 5 THEN 'binary' WHEN 6 THEN 'secret' END AS reason FROM pages"""
)
def capture_reasons(spark, sf_dir):
    k = F.col("page_id") % 9
    name = F.when(k == 0, F.concat(F.lit("../p"), "page_id")).when(k == 1, F.concat(F.lit(".git/p"), "page_id")).when(k == 2, F.concat(F.lit("build/p"), "page_id", F.lit(".log")))
    name = name.when(k == 3, F.concat(F.lit("p"), "page_id", F.lit(".pem"))).otherwise(F.concat(F.lit("src/p"), "page_id", F.lit(".txt")))
    body = F.when(k == 5, F.concat(F.lit("a"), F.char(F.lit(0)))).when(k == 6, "-----BEGIN RSA PRIVATE KEY-----").otherwise("plain")
    size = F.when(k == 4, 3 << 20).otherwise(F.octet_length(body)).cast("bigint")
    rules = policy.ignore_rules("*.log\n!keep.log\n")
    return table(spark, sf_dir, "pages").select("page_id", policy.exclusion(name, body, size, rules).alias("reason"))


@query(
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'build/a.log' WHEN 1 THEN 'build/keep.log' WHEN 2 THEN 'docs/x/y.md' ELSE 'src/docs.md' END AS path FROM pages)
SELECT page_id, page_id % 4 IN (0, 2) AS ignored FROM p"""
)
def ignore_files(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, "build/a.log").when(k == 1, "build/keep.log").when(k == 2, "docs/x/y.md").otherwise("src/docs.md")
    rules = policy.ignore_rules("# logs\n*.log\n!keep.log\n/docs/\n")
    return table(spark, sf_dir, "pages").select("page_id", policy.ignored(path, rules).alias("ignored"))


_PATHS = ["a/b.txt", "/abs", "a//b", "a/../b", "con.txt", "a/Lpt1", "tail.", "x<y", "ü/é.go", "a/.b", "", "a\\b", "./a"]
_GOOD = {"a/b.txt", "ü/é.go", "a/.b"}


@query(f"SELECT event_id, event_id % {len(_PATHS)} IN ({', '.join(str(i) for i, p in enumerate(_PATHS) if p in _GOOD)}) AS portable FROM events")
def portable_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", policy.portable_path(path).alias("portable"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 1 AND strlen(props) > 30 THEN 'oversize' WHEN event_id % 5 = 0 THEN 'digest' WHEN event_id % 5 = 1 THEN 'json' ELSE 'ready' END AS state FROM events")
def spool_states(spark, sf_dir):
    payload = F.when(F.col("event_id") % 5 == 1, "{broken").otherwise(F.col("props"))
    digest = F.sha2(F.when(F.col("event_id") % 5 == 0, F.lit("other")).otherwise(payload).cast("binary"), 256)
    bundles = table(spark, sf_dir, "events").select("event_id", digest.alias("id"), payload.alias("payload"))
    return sources.bundle_states(bundles, 30).select("event_id", "state")


@query(
    """SELECT 'append' AS what, vec_id FROM embeddings WHERE vec_id % 3 = 1
UNION ALL SELECT 'conflict', vec_id FROM embeddings WHERE vec_id % 6 = 0"""
)
def embedding_save(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    there = v.filter("id % 3 = 0")
    changed = F.when(F.col("id") % 6 == 0, F.transform("vector", lambda x: (x + 1).cast("float"))).otherwise(F.col("vector"))
    new, conflicts = embeddings.save(there, v.filter("id % 3 < 2").withColumn("vector", changed))
    one = lambda df, what: df.select(F.lit(what).alias("what"), F.col("id").alias("vec_id"))
    return one(new, "append").unionByName(one(conflicts, "conflict"))


@query("SELECT count(*) AS n FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def embedding_scan(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"), F.lit("w").alias("workspace_id"), F.concat(F.lit("v"), F.col("vec_id") % 2).alias("view_id"), F.concat(F.lit("p"), "label").alias("profile")
    )
    return embeddings.scan(v, "w", "v0", "p3", 1_000_000).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (2, 5, 11)")
def embedding_find(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.lit("w").alias("workspace"), F.lit("v").alias("view"), F.col("vec_id").cast("string").alias("item"), F.lit("p").alias("profile"), F.concat(F.lit("text "), "label").alias("text"))
    fields = ["workspace", "view", "item", "profile", "text"]
    records = v.select("vec_id", embeddings.record_id(*[F.col(c) for c in fields]).alias("id"))
    return embeddings.find(records, v.filter("vec_id in (2, 5, 11)").select(*fields)).select("vec_id")


@query("SELECT least(16, greatest(0, count(*) - 32)) AS \"rows\", least(count(*), 48) AS next_offset, count(*) <= 48 AS complete FROM embeddings")
def embedding_page_state(spark, sf_dir):
    return embeddings.complete(table(spark, sf_dir, "embeddings"), 32).select(F.col("rows").cast("bigint").alias("rows"), F.col("next_offset").cast("bigint").alias("next_offset"), "complete")


@query(
    """SELECT 'p' || p_partkey AS id, 'dimension' AS problem FROM part WHERE p_size > 45 UNION ALL SELECT 'p' || p_partkey, 'distance' FROM part WHERE p_size <= 45 AND p_size % 7 = 3
UNION ALL SELECT '*', 'too many' FROM (SELECT count(*) AS n FROM part) WHERE n > 64"""
)
def profile_problems(spark, sf_dir):
    dimension = F.when(F.col("p_size") > 45, 0).otherwise(F.col("p_size"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_type").alias("model"), dimension.alias("dimension"), F.when(F.col("p_size") % 7 == 3, "other").otherwise("cosine").alias("distance"))
    return embeddings.profile_problems(p)


@query("SELECT s_suppkey AS k, CASE WHEN s_nationkey % 3 = 0 THEN 'new' ELSE s_name END AS name FROM supplier")
def upsert_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "s_nationkey")
    return sources.upsert(s.select("k", "name"), s.filter("s_nationkey % 3 = 0").select("k", F.lit("new").alias("name")), "k")


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(CASE WHEN s_nationkey % 3 = 0 THEN 3 WHEN s_nationkey % 3 = 2 THEN 2 ELSE 2 END AS INTEGER) AS version, CASE WHEN s_nationkey % 3 = 0 THEN 'changed' ELSE s_name END AS body, s_nationkey % 3 = 2 AS refused FROM supplier
UNION ALL SELECT 'new', 1, 'first', FALSE"""
)
def compare_and_set(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit(2).alias("version"), F.col("s_name").alias("body"), "s_nationkey")
    asked = s.filter("s_nationkey % 3 <> 1").select("id", F.when(F.col("s_nationkey") % 3 == 0, 2).otherwise(1).alias("expected"), F.lit("changed").alias("body"))
    after, refused = projects.compare_and_set(s.drop("s_nationkey"), asked.unionByName(spark.createDataFrame([("new", None, "first")], "id string, expected int, body string")))
    return after.join(refused.withColumn("refused", F.lit(True)), "id", "left").select("id", "version", "body", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 10 = 0 THEN ' x' ELSE '' END AS id, 'identity' AS problem FROM part WHERE p_size % 10 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 10 = 0 THEN ' x' ELSE '' END, 'unknown repository' FROM part WHERE p_size > 40
UNION ALL SELECT CAST(p_partkey AS VARCHAR) || CASE WHEN p_size % 10 = 0 THEN ' x' ELSE '' END, 'foreign repository' FROM part WHERE p_size <= 40 AND p_size % 2 = 1"""
)
def definition_problems(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(
        F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 10 == 0, " x").otherwise("")).alias("id"), F.lit("w0").alias("workspace"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.array(F.concat(F.lit("r"), "p_size")).alias("roots"),
    )
    repos = spark.range(1, 41).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("w"), F.col("id") % 2).alias("workspace"))
    return projects.definition_problems(d, repos)


# --- search -----------------------------------------------------------------------------------------


def _turn_files(spark, sf_dir):
    """Conversations as files whose symbols are their turns."""
    c = table(spark, sf_dir, "conversations")
    symbol = F.struct(F.concat("role", "turn").alias("name"), F.col("role").alias("kind"), (F.col("turn") * 10).cast("bigint").alias("start"), (F.col("turn") * 10 + 5).cast("bigint").alias("end"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(symbol)).cast(f"array<{SYMBOL}>").alias("symbols"))
    return rows.select(
        F.concat(F.lit("c"), "conv_id").alias("id"), F.lit("a/c.txt").alias("path"), F.lit("").alias("content"), F.array().cast("array<string>").alias("project_ids"), F.lit("r").alias("repository_id"), F.lit("s").alias("snapshot_id"),
        F.lit("text").alias("language"), F.lit(False).alias("test"), F.lit(False).alias("generated"), "symbols",
    )


@query("SELECT 'c' || conv_id AS id FROM conversations GROUP BY conv_id HAVING bool_or(role || turn = 'user1') AND bool_or(role = 'system')")
def search_symbols(spark, sf_dir):
    return search.matching(_turn_files(spark, sf_dir), "symbol:user1 AND kind:system").select("id")


@query(
    """WITH k AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system'))
SELECT 'c' || conv_id AS id, turn * 10 AS "start", turn * 10 + 5 AS "end" FROM conversations JOIN k USING (conv_id) WHERE role = 'system'"""
)
def search_symbol_ranges(spark, sf_dir):
    found = search.with_ranges(_turn_files(spark, sf_dir), "kind:system")
    return found.select("id", F.explode("ranges").alias("r")).select("id", "r.start", "r.end")


def _hits(term: str, where: str) -> str:
    n = len(term)
    return f"""SELECT id, CAST(strlen(substr(text, 1, CAST(chars AS INTEGER))) AS BIGINT) AS "start", CAST(strlen(substr(text, 1, CAST(chars AS INTEGER))) + {n} AS BIGINT) AS "end" FROM (
SELECT id, text, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * {n} AS chars FROM (
SELECT id, text, parts, unnest(generate_series(1, len(parts) - 1)) AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text, string_split(lower(text), '{term}') AS parts FROM documents WHERE {where})))"""


_BOTH = "contains(lower(text), 'the') AND (contains(lower(text), 'stupid') OR contains(lower(text), 'idiot')) AND NOT contains(lower(text), 'license')"


@query(f"{_hits('stupid', _BOTH)} UNION {_hits('idiot', _BOTH)}")
def search_ranges_boolean(spark, sf_dir):
    """Spans of both sides of an OR, of the terms under an AND, and none of a NOT; the term of many hits is left out."""
    found = search.with_ranges(files(spark, sf_dir), "(stupid OR idiot) AND NOT license AND the", most=1 << 30)
    hits = found.select("id", "content", F.explode("ranges").alias("r")).filter(F.col("r.end") - F.col("r.start") > 3)
    return hits.select("id", "r.start", "r.end")


@query("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) <= 500 AND sum(strlen(text)) <= 400000 AS complete FROM documents")
def search_scan_complete(spark, sf_dir):
    return search.scan_complete(files(spark, sf_dir), 500, 400_000)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(upper(text)) AS folded FROM documents WHERE NOT contains(text, 'ß')")
def search_folding(spark, sf_dir):
    f = files(spark, sf_dir).filter(~F.contains("content", F.lit("ß")))
    return f.select("id", F.sha2(fold(F.col("content")).cast("binary"), 256).alias("folded"))


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, upper(text) AS t FROM documents)
SELECT id FROM d WHERE contains(t, 'PAT') AND contains(t, 'ATH') AND contains(t, 'THE') AND contains(t, 'HET') AND contains(t, 'ETI') AND contains(t, 'TIC')"""
)
def regex_candidates(spark, sf_dir):
    return search.regex_candidates(search.trigram_index(files(spark, sf_dir)), "(?:very )?pathetic[a-z]*")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || doc_id || '.txt' AS path, strlen(text) AS bytes FROM documents WHERE doc_id = 12")
def search_file(spark, sf_dir):
    return search.file(files(spark, sf_dir), "12").select("id", "path", F.octet_length("content").cast("bigint").alias("bytes"))


@query(
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(lower(text), 'idiot')),
k AS (SELECT id, k - 1 AS line, ls[k] AS t FROM (SELECT id, ls, unnest(generate_series(1, len(ls))) AS k FROM l)),
p AS (SELECT id, line, t, string_split(lower(t), 'idiot') AS parts FROM k),
h AS (SELECT id, line, t, parts, unnest(generate_series(1, len(parts) - 1)) AS j FROM p),
c AS (SELECT id, line, t, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * 5 AS chars FROM h)
SELECT id, CAST(line AS INTEGER) AS line, CAST(strlen(substr(t, 1, CAST(chars AS INTEGER))) AS BIGINT) AS "from", CAST(strlen(substr(t, 1, CAST(chars AS INTEGER))) + 5 AS BIGINT) AS "to" FROM c"""
)
def highlight_lines(spark, sf_dir):
    found = search.with_ranges(files(spark, sf_dir), "idiot", most=1 << 30).select("id", "content", F.explode("ranges").alias("r"))
    ranges = found.select("id", "r.start", "r.end")
    return search.highlights(found.select("id", "content").distinct(), ranges)


@query(
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(strlen(text) // 2 AS BIGINT) AS "offset", string_split(text, chr(10)) AS ls FROM documents WHERE length(text) = strlen(text)),
k AS (SELECT id, "offset", k - 1 AS line, coalesce(list_sum(list_transform(ls[1:k-1], lambda x: strlen(x) + 1)), 0) AS s, strlen(ls[k]) AS n FROM (SELECT id, "offset", ls, unnest(generate_series(1, len(ls))) AS k FROM l))
SELECT id, "offset", CAST(line AS INTEGER) AS line, CAST("offset" - s AS BIGINT) AS "character" FROM k WHERE "offset" >= s AND "offset" <= s + n"""
)
def byte_positions(spark, sf_dir):
    f = files(spark, sf_dir).filter(F.length("content") == F.octet_length("content"))
    return search.positions(f, f.select("id", F.floor(F.octet_length("content") / 2).cast("bigint").alias("offset")))


# --- ranking ----------------------------------------------------------------------------------------


def _doc_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def _first_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query(
    f"""WITH s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, {_COSINE} AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id AND d.lang = 'es', embeddings q WHERE q.vec_id = 0)
SELECT id, round(CAST(score AS DOUBLE), 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 30"""
)
def semantic_scoped(spark, sf_dir):
    found, _ = retrieval.retrieve(chunks(spark, sf_dir), "any", "semantic", 30, projects=["es"], vectors=_doc_vectors(spark, sf_dir), query_vector=_first_vector(spark, sf_dir))
    return found.select("id", F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH s AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 2 = 1)
SELECT id, round(CAST(score AS DOUBLE), 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""
)
def record_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    records = e.select(
        F.col("vec_id").cast("string").alias("id"), F.lit("v").alias("view_id"), F.lit("p").alias("profile"), F.size("embedding").alias("dimension"), F.lit("cosine").alias("distance"),
        F.when(F.col("label") % 2 == 1, "ready").otherwise("pending").alias("completeness"), F.col("embedding").alias("vector"),
    )
    found = rank.record_rank(records, _first_vector(spark, sf_dir), "v", "p")
    return found.select("id", F.round("score", 4).alias("score"), "rank")


@query(
    """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS rank FROM documents WHERE length(text) > 0 AND contains('doc' || doc_id, 'doc1')),
c AS (SELECT *, least(count(*) OVER (), 100) AS n FROM s)
SELECT id, CAST(rank AS INTEGER) AS rank, n AS candidate_count, n > 10 AS truncated FROM c WHERE rank <= 10"""
)
def retrieve_truncated(spark, sf_dir):
    found, _ = retrieval.retrieve(chunks(spark, sf_dir), "doc1", "symbol", 100)
    return retrieval.answer(found, 10).select("id", "rank", "candidate_count", "truncated")


@query(
    """WITH t AS (SELECT regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS x, CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS rank FROM t WHERE x = (SELECT x FROM t WHERE id = '5') QUALIFY rank <= 20"""
)
def retrieve_structural(spark, sf_dir):
    c = chunks(spark, sf_dir)
    target = sources.get(c, "id", "5").first()["text"]  # the text of the asked chunk
    same = c.filter(rank.structure_hash(F.col("text")) == rank.structure_hash(F.lit(target)))
    return rank.ranked(same.select("id", F.lit(1.0).alias("score")), 20).select("id", "rank")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'missing' AS problem FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'repeated' FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT 'x' || n_nationkey, 'unknown' FROM nation"""
)
def rerank_problems(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    scores = o.filter("o_orderkey % 3 = 2").select("id").union(o.filter("o_orderkey % 3 = 1").select(F.explode(F.array("id", "id")))).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), "n_nationkey")))
    return rank.validated_rerank(o.select("id"), scores.withColumn("score", F.lit(1.0)))


@query("""SELECT count(*) AS n, min(lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS first_id FROM part GROUP BY substr(p_brand, 7), p_size % 2 HAVING count(*) > 1""")
def ast_groups(spark, sf_dir):
    op = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    text = F.concat(F.lit("  def f(x):  # "), F.col("p_name"), F.lit("\n      return x "), op, F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" * brand"), F.substring("p_brand", 7, 9), F.lit("\n"))
    p = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), text.alias("text"))
    return rank.ast_groups(p).select("n", "first_id")


# --- chunks -----------------------------------------------------------------------------------------


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(strlen(text) AS BIGINT) AS bytes, TRUE AS joined, TRUE AS within, CASE WHEN strlen(text) <= 1024 THEN 'file_fallback' ELSE 'fallback' END AS kind,
'language=' || lang || '; path=' || source || '/' || doc_id || '.txt; kind=file' || CASE WHEN strlen(text) > 1024 THEN '; split=fallback' ELSE '' END AS header, sha256(text) AS whole, TRUE AS cut_well FROM documents"""
)
def chunk_split(spark, sf_dir):
    """What chunks of a file must be together: its bytes in order without gaps, none above the bound, each cut at a line's
    end if one is within reach."""
    c = chunking.split_files(files(spark, sf_dir), 1024)
    part = F.struct("start", "end", "text")
    rows = c.groupBy("file_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min("kind").alias("kind"), F.min("header").alias("header"))
    late = "regexp_instr(substring(p.text, greatest(1, length(p.text) - 100)), '\\n') > 0"
    return rows.select(
        "file_id", F.expr("element_at(p, -1).end").alias("bytes"),
        F.expr("p[0].start = 0 and forall(sequence(1, size(p)), i -> i = 1 or element_at(p, i).start = element_at(p, i - 1).end)").alias("joined"),
        F.expr("forall(p, x -> x.end - x.start <= 1024 and octet_length(x.text) = x.end - x.start)").alias("within"), "kind", "header",
        F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), "").cast("binary"), 256).alias("whole"),
        F.expr(f"forall(slice(p, 1, size(p) - 1), p -> endswith(p.text, '\\n') or not ({late}))").alias("cut_well"),
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'error,panic' WHEN 1 THEN 'Errorf,New' WHEN 2 THEN '' ELSE 'Error,error' END AS facts FROM events"""
)
def error_facts(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "if err != nil { panic (err) }\nvar e error").when(k == 1, 'errors.New("x"); fmt.Errorf("y"); New()').when(k == 2, "terror errors panicky").otherwise("x.Error() // error")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(chunking.error_facts(text), ",").alias("facts"))


@query(
    """WITH d AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' WHEN turn % 5 = 4 THEN 'none' ELSE CAST(turn - 1 AS VARCHAR) END AS parent FROM conversations)
SELECT 'c' || conv_id AS file_id, CAST(turn AS VARCHAR) AS id, 'unknown parent' AS problem FROM d WHERE parent = 'none'
UNION ALL SELECT 'c' || conv_id, CAST(turn AS VARCHAR), 'outside parent' FROM d WHERE parent NOT IN ('', 'none') AND turn % 3 = 2
UNION ALL SELECT 'c' || conv_id, CAST(turn AS VARCHAR), 'overlap' FROM d WHERE parent = 'none' AND turn > 4"""
)
def declaration_problems(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, "").when(F.col("turn") % 5 == 4, "none").otherwise((F.col("turn") - 1).cast("string"))
    end = F.when(F.col("turn") % 3 == 2, 2_000_000 + F.col("turn")).otherwise(1_000_000 - F.col("turn"))
    d = c.select(F.concat(F.lit("c"), "conv_id").alias("file_id"), F.col("turn").cast("string").alias("id"), parent.alias("parent_id"), F.col("turn").cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    return chunking.declaration_problems(d)


@query(
    """WITH d AS (SELECT conv_id, turn, max(CASE WHEN turn % 5 = 4 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS broken FROM conversations)
SELECT 'c' || conv_id AS file_id, CAST(turn AS VARCHAR) AS id, CASE WHEN broken IS NULL THEN CAST(turn AS INTEGER) END AS depth FROM d"""
)
def declaration_depths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, "").when(F.col("turn") % 5 == 4, F.col("turn").cast("string")).otherwise((F.col("turn") - 1).cast("string"))  # a cycle of one
    return chunking.declaration_depths(c.select(F.concat(F.lit("c"), "conv_id").alias("file_id"), F.col("turn").cast("string").alias("id"), parent.alias("parent_id")))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 6 WHEN 0 THEN 'unknown file' WHEN 1 THEN 'membership' WHEN 2 THEN 'range' END AS problem FROM documents WHERE doc_id % 6 < 3
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'repeated' FROM documents WHERE doc_id % 6 = 3"""
)
def chunk_problems(spark, sf_dir):
    k = F.col("id").cast("int") % 6
    c = chunks(spark, sf_dir)
    held = c.select(F.col("id"), "repository_id", "project_ids", F.col("end").alias("size")).filter(k != 0)
    bad = c.withColumns({"project_ids": F.when(k == 1, F.array(F.lit("other"))).otherwise(F.col("project_ids")), "end": F.when(k == 2, F.col("end") + 1).otherwise(F.col("end"))})
    return chunking.chunk_problems(bad.unionByName(bad.filter(k == 3)), held).distinct()


@query("SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE source = 'src1' OR lang = 'fr'")
def chunk_load(spark, sf_dir):
    c = chunks(spark, sf_dir)
    found = chunking.load(c, c.select("id", "repository_id", "project_ids", F.col("end").alias("size")), ["src1", "fr"], 10_000_000, 1 << 40)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT 'c' || conv_id AS file_id, count(*) + 1 AS n, 'c' || conv_id || ',' || string_agg('c' || conv_id || '-' || turn, ',' ORDER BY turn, turn * 100000 + strlen(text)) AS chunk_ids FROM conversations GROUP BY conv_id")
def chunks_by_file(spark, sf_dir):
    from ..tables import conversation_chunks

    c = conversation_chunks(spark, sf_dir)
    first = F.when(F.col("parent_id") == "", -1).otherwise(F.col("start"))
    return chunking.by_file(c.withColumn("start", first)).select("file_id", "n", F.array_join("chunk_ids", ",").alias("chunk_ids"))


# --- parsed source ----------------------------------------------------------------------------------


def _python_files(spark, sf_dir):
    """Each conversation as a Python file: a class, a method per turn that calls the one before it, and a free function."""
    c = table(spark, sf_dir, "conversations")
    before = F.when(F.col("turn") == 0, "start()").otherwise(F.concat(F.lit("self.t"), F.col("turn") - 1, F.lit("()")))
    method = F.concat(F.lit("    def t"), "turn", F.lit("(self, x: int):\n        v = "), before, F.lit("\n        return v\n"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", method.alias("m")))).alias("m"))
    body = F.concat(F.lit("def start():\n    return 1\n\nclass C:\n"), F.array_join(F.transform("m", lambda x: x["m"]), "\n"))
    return rows.select(F.concat(F.lit("c"), "conv_id").alias("id"), F.concat(F.lit("c"), "conv_id", F.lit(".py")).alias("path"), F.concat(F.lit("r"), "conv_id").alias("repository_id"), F.array(F.lit("p")).alias("project_ids"), F.lit("python").alias("language"), body.alias("content"))


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'c' || conv_id AS file_id, n + 2 AS symbols, n AS calls, n AS writes, TRUE AS valid FROM c"""
)
def python_reports(spark, sf_dir):
    r = syntax.python_reports(_python_files(spark, sf_dir))
    kind = lambda k: F.size(F.filter("references", lambda x: x["kind"] == k)).cast("bigint")
    return r.select("file_id", F.size("symbols").cast("bigint").alias("symbols"), kind("call").alias("calls"), kind("write").alias("writes"), "valid")


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT 'calls' AS kind, 'exact' AS resolution, CAST(sum(n) AS BIGINT) AS n FROM c UNION ALL SELECT 'contains', 'exact', CAST(sum(n) AS BIGINT) FROM c UNION ALL SELECT 'member_of', 'exact', CAST(sum(n) AS BIGINT) FROM c"""
)
def code_graph(spark, sf_dir):
    f = _python_files(spark, sf_dir)
    _, edges = syntax.code_graph(f, syntax.python_reports(f))
    return edges.filter("kind in ('calls', 'contains', 'member_of')").groupBy("kind", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'c' || conv_id AS file_id, 't' || turn AS name, 'method' AS kind, 2 AS parameters FROM conversations"""
)
def type_members(spark, sf_dir):
    r = syntax.python_reports(_python_files(spark, sf_dir))
    return syntax.members(r).select("file_id", "name", "kind", "parameters")


@query(
    """SELECT 'c' || conv_id AS file_id, 'C' AS name, 'c' || conv_id || '.py#C' AS qualified_name, 'class' AS kind, 'public' AS visibility, count(*) AS member_count, string_agg('t' || turn, ',' ORDER BY 't' || turn) AS methods FROM conversations GROUP BY conv_id"""
)
def type_descriptors(spark, sf_dir):
    f = _python_files(spark, sf_dir)
    return syntax.type_descriptors(f, syntax.python_reports(f)).select("file_id", "name", "qualified_name", "kind", "visibility", "member_count", F.array_join("methods", ",").alias("methods"))


@query(
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT 'c' || conv_id AS file_id, n + 2 AS declarations, TRUE AS covered FROM c"""
)
def syntax_chunks(spark, sf_dir):
    """A chunk for the function, the class and, where the class is above the bound, each method; together they cover the file."""
    f = _python_files(spark, sf_dir)
    c = syntax.syntax_chunks(f, syntax.python_reports(f), 64).filter("text <> '' or split")
    rows = c.groupBy("file_id").agg(F.sum((~F.col("fallback")).cast("bigint")).alias("declarations"), F.sum(F.octet_length("text")).alias("covered"))
    sizes = f.select(F.col("id").alias("file_id"), F.octet_length("content").alias("size"))
    return rows.join(sizes, "file_id").select("file_id", "declarations", (F.col("covered") == F.col("size")).alias("covered"))


@query("SELECT 'c' || conv_id AS file_id, string_agg(role || ':' || strlen(text), ',' ORDER BY turn) AS symbols FROM conversations GROUP BY conv_id")
def syntax_symbols(spark, sf_dir):
    s = syntax.search_symbols(_turn_reports(spark, sf_dir))
    return s.select("file_id", F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x["name"], x["end"])), ",").alias("symbols"))


@query("SELECT 'c' || conv_id AS file_id, 'range' AS problem FROM conversations GROUP BY conv_id HAVING max(strlen(text)) > 300")
def report_problems(spark, sf_dir):
    r = _turn_reports(spark, sf_dir)
    return syntax.report_problems(r.drop("size"), r.select("file_id", F.lit(300).cast("bigint").alias("size")))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE doc_id % 5 WHEN 0 THEN 'no report' WHEN 1 THEN 'language' ELSE 'content' END AS problem FROM documents WHERE doc_id % 5 < 3
UNION ALL SELECT 'gone', 'no file'"""
)
def report_agreement(spark, sf_dir):
    f = files(spark, sf_dir)
    k = F.col("id").cast("int") % 5
    r = f.filter(k != 0).select(F.col("id").alias("file_id"), F.when(k == 1, "none").otherwise(F.col("language")).alias("language"), F.sha2(F.when(k == 2, F.lit("other")).otherwise(F.col("content")).cast("binary"), 256).alias("digest"))
    return syntax.report_agreement(f, r.unionByName(spark.createDataFrame([("gone", "en", "x")], r.schema)))


@query(
    """WITH n AS (SELECT conv_id, turn, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS reach FROM conversations)
SELECT 'c' || conv_id || ':' || turn AS site_id, 'c' || conv_id || ':' || CAST(turn AS VARCHAR) AS owner_id FROM n"""
)
def contained_sites(spark, sf_dir):
    """Nested ranges, a site in each: the innermost one holds it."""
    c = table(spark, sf_dir, "conversations")
    f = F.concat(F.lit("c"), "conv_id")
    name = F.concat(f, F.lit(":"), "turn")
    ranges = c.select(f.alias("file_id"), name.alias("id"), F.col("turn").cast("bigint").alias("start"), (1_000_000 - F.col("turn")).cast("bigint").alias("end"))
    return graphs.contained_sites(ranges, c.select(f.alias("file_id"), name.alias("id"), F.col("turn").cast("bigint").alias("at")))


_TYPES = [
    ("*User", "pointer", "User"), ("[]byte", "slice", "byte"), ("[16]int", "array", "int"), ("map[string]int", "map", None), ("chan error", "channel", "error"), ("<-chan T", "channel", "T"), ("struct{}", "struct", None),
    ("interface{ A() }", "interface", None), ("func(int) error", "function", None), ("...string", "variadic", "string"), ("List[int]", "instantiation", None), ("time.Time", "named", None), ("(*Node)", "pointer", "Node"),
]


@query(
    "WITH t(k, kind, element) AS (VALUES " + ", ".join(f"({i}, '{k}', " + ("NULL" if e is None else f"'{e}'") + ")" for i, (_, k, e) in enumerate(_TYPES)) + f") SELECT p_partkey, kind, element FROM part JOIN t ON t.k = p_partkey % {len(_TYPES)}"
)
def type_expressions(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, *_ in _TYPES]), (F.col("p_partkey") % len(_TYPES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", syntax.type_expression(text).alias("t")).select("p_partkey", "t.kind", "t.element")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, 'layout' AS problem FROM part WHERE p_size % 8 = 1 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'name' FROM part WHERE p_size % 8 = 2
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'repeated type' FROM part WHERE p_size % 8 = 3 UNION ALL SELECT DISTINCT CAST(l_partkey AS VARCHAR), 'repeated member' FROM (SELECT l_partkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)"""
)
def type_problems(spark, sf_dir):
    k = F.col("p_size") % 8
    t = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(k == 2, "").otherwise(F.col("p_name")).alias("name"), F.lit("p").alias("project_id"), F.when(k == 1, "packed").alias("layout"), F.lit(None).cast("string").alias("evidence"), "p_size",
    )
    m = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("type_id"), F.col("l_linenumber").cast("string").alias("id"))
    return projects.type_problems(t.unionByName(t.filter("p_size % 8 = 3")), m)


# --- graph ------------------------------------------------------------------------------------------


@query(f"WITH {_G}, h AS (SELECT e.kind || '|' || s || '|' || t AS id, count(*) OVER () AS n FROM e WHERE s LIKE 'o:1%' AND kind = 'references' AND t = 'p:5') SELECT id, n > 3 AS truncated FROM h ORDER BY id LIMIT 3")
def graph_capped(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return graphs.incoming(nodes, edges.filter("source_id like 'o:1%'"), "p:5", limit=3).select("id", "truncated")


@query(
    f"""WITH {_G}, h AS (SELECT kind FROM e WHERE s = 'o:7' AND kind IN ('calls', 'references')), f AS (SELECT count(*) FILTER (c_custkey % 10 = 0) AS lost, count(*) FILTER (c_custkey % 10 = 1) AS part FROM customer)
SELECT CASE WHEN count(*) > 2 OR any_value(lost) > 0 OR any_value(part) > 0 THEN 'partial' ELSE 'complete' END AS status, least(count(*), 2) AS "rows",
CASE WHEN count(*) > 2 THEN 'BUDGET,' ELSE '' END || CASE WHEN bool_or(kind = 'calls') THEN 'CANDIDATE_TARGET,' ELSE '' END || CASE WHEN any_value(lost) > 0 THEN 'MISSING_SHARD' ELSE '' END AS notices FROM h, f"""
)
def graph_answer(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    result = graphs.outgoing(nodes, edges, "o:7", ["calls", "references"], 2)
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    sharded = every.filter("id % 10 <> 0").withColumn("complete", F.col("id") % 10 != 1)
    return graphs.answer(result, every, sharded).select("status", "rows", F.array_join("notices", ",").alias("notices"))


@query(
    """SELECT 'o:' || o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'projects' WHEN 2 THEN 'repository' ELSE 'unknown file' END AS problem FROM orders WHERE o_orderkey % 5 < 4"""
)
def graph_foreign(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    own = F.concat(F.lit("f"), "o_orderkey")
    nodes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit("symbol").alias("kind"), F.when(k == 0, "elsewhere").otherwise(own).alias("file_id"), own.alias("shard"), F.when(k == 2, "r2").otherwise("r").alias("repository_id"),
        F.when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("project_ids"),
    )
    held = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 3").select(F.concat(F.lit("f"), "o_orderkey").alias("id"), F.lit("r").alias("repository_id"), F.array(F.lit("a")).alias("project_ids"))
    return graphs.foreign(nodes, held)


@query(
    f"""WITH {_G}, o AS (SELECT id, CASE WHEN kind = 'package' THEN 'f-geo' ELSE 'f-' || p END AS shard FROM n)
SELECT shard, count(*) AS nodes, (SELECT count(*) FROM e JOIN o o2 ON o2.id = e.s WHERE o2.shard = o.shard) AS edges FROM o GROUP BY shard"""
)
def graph_shards(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    part = F.element_at("project_ids", 2)
    placed = nodes.withColumns({"file_id": F.when(F.col("kind") == "package", "").otherwise(F.concat(F.lit("f-"), part)), "project_ids": F.array(part)})
    held = spark.createDataFrame([("f-geo", "r", ["geo"]), ("f-sales", "r", ["sales"]), ("f-supply", "r", ["supply"]), ("f-zgeo", "r", ["geo"])], "id string, repository_id string, project_ids array<string>")
    n, e = graphs.shards(placed, edges, held)
    return n.groupBy("shard").agg(F.count(F.lit(1)).alias("nodes")).join(e.groupBy("shard").agg(F.count(F.lit(1)).alias("edges")), "shard", "left").select("shard", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'b' ELSE '' END AS shared FROM supplier")
def graph_shared_projects(spark, sf_dir):
    other = F.when(F.col("s_nationkey") % 2 == 0, F.array(F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("d")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(graphs.shared_projects(F.array(F.lit("b"), F.lit("a")), other), ",").alias("shared"))


@query(
    f"""WITH RECURSIVE {_G}, h AS (SELECT 'r:2' AS id, 0 AS depth UNION SELECT e.t, h.depth + 1 FROM h JOIN e ON e.s = h.id AND e.kind = 'contains' WHERE h.depth < 2)
SELECT id, CAST(min(depth) AS INTEGER) AS depth, 'DEPTH_BUDGET' AS reasons FROM h GROUP BY id"""
)
def structure_select(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    contains = edges.filter("kind = 'contains'")
    rows, notes = graphs.structure(contains, ["r:2"], 2, 1_000_000)
    return rows.withColumn("reasons", F.lit(",".join(notes)))


@query(
    """WITH c AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS file_id, count(*) AS nodes, 2 * count(*) AS edges FROM orders GROUP BY 1),
l AS (SELECT *, 200 - coalesce(sum(nodes) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln FROM c)
SELECT file_id, CAST(least(nodes, ln) AS BIGINT) AS nodes, edges, ln <= nodes AS stopped FROM l WHERE ln > 0"""
)
def structure_budget(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("file_id")).agg(F.count(F.lit(1)).alias("nodes"))
    return graphs.structures(o.withColumn("edges", F.col("nodes") * 2))


# --- projects, policy, ingest -----------------------------------------------------------------------


@query(
    "WITH e(source, family) AS (VALUES " + ", ".join(f"('{d}', '{f}')" for f, deps in projects.DEPENDENCIES.items() for d in deps) + ") SELECT source, family, TRUE AS in_order FROM e"
)
def projection_order(spark, sf_dir):
    order = {f: k for k, f in enumerate(projects.topological_order(projects.DEPENDENCIES))}
    e = projects.dependency_edges(spark)
    at = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return e.select("source", "family", (at[F.col("source")] < at[F.col("family")]).alias("in_order"))


def _chained_sql() -> str:
    parts = []
    for f in projects.topological_order(projects.DEPENDENCIES):
        deps = "".join(f" || chr(0) || (SELECT x FROM f_{d})" for d in sorted(projects.DEPENDENCIES[f]))
        parts.append(f"f_{f} AS (SELECT sha256('{f}' || chr(0) || '1'{deps}) AS x)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT '{f}' AS family, x AS fingerprint FROM f_{f}" for f in projects.DEPENDENCIES)


@query(_chained_sql())
def projection_fingerprints(spark, sf_dir):
    return spark.createDataFrame(list(projects.chained_fingerprints().items()), "family string, fingerprint string")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS view_id, p.k AS projection, p.v AS status FROM region, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ingest.PROJECTIONS.items()) + ") p(k, v)")
def projection_status(spark, sf_dir):
    return ingest.projection_status(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("view_id")))


@query(
    """WITH r AS (SELECT l_suppkey AS project_id, '{"repository_id":"r' || (l_partkey % 7) || '","path":"p' || l_linenumber || '","include":["a","b"],"exclude":[],"role":"main","version":1}' AS root FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT project_id, sha256('definition/1' || chr(10) || project_id || chr(10) || string_agg(root, chr(10) ORDER BY root)) AS fingerprint FROM r GROUP BY project_id"""
)
def definition_fingerprints(spark, sf_dir):
    globs = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    d = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 = 0").select(
        F.col("l_suppkey").alias("project_id"), F.concat(F.lit("r"), F.col("l_partkey") % 7).alias("repository_id"), F.concat(F.lit("p"), "l_linenumber").alias("path"), globs.alias("include"), F.array().cast("array<string>").alias("exclude"),
        F.lit("main").alias("role"), F.lit(1).alias("version"),
    )
    return projects.definition_fingerprint(d)


@query("SELECT DISTINCT p_type, p_size, sha256(p_type || chr(0) || p_size) AS fingerprint FROM part")
def profile_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_size", embeddings.profile_fingerprint(F.col("p_type"), F.col("p_size")).alias("fingerprint")).distinct()


_NAMES = [(".env", "env"), ("a/.env.local", "env"), ("x.ENV", "env"), ("b/c.json", "json"), ("k.YAML", "yaml"), ("k.yml", "yaml"), ("z.toml", "opaque"), ("main.tf", ""), ("v.tfvars", "opaque"), ("env.go", "")]


@query("WITH t(k, kind) AS (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(_NAMES)) + f") SELECT event_id, kind FROM events JOIN t ON t.k = event_id % {len(_NAMES)}")
def config_kinds(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p) for p, _ in _NAMES]), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", projects.config_kind(path).alias("kind"))


@query(
    """SELECT c_custkey AS id, 'KEY_' || c_custkey AS name, 2 AS line FROM customer UNION ALL SELECT c_custkey, 'LONG', 3 FROM customer UNION ALL SELECT c_custkey, 'last', 6 FROM customer WHERE c_nationkey % 2 = 0"""
)
def config_keys_env(spark, sf_dir):
    end = F.when(F.col("c_nationkey") % 2 == 0, "export last=x").otherwise("# last=x")
    text = F.concat(F.lit("# names\nKEY_"), "c_custkey", F.lit("=1\nLONG=\"a\nINSIDE=2\nb\"\n"), end, F.lit("\n"))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("a/.env").alias("path"), text.alias("content"))
    return projects.env_config_keys(f)


@query(
    """WITH d AS (SELECT source || '/' || doc_id AS base, doc_id % 7 AS k FROM documents)
SELECT CASE k WHEN 0 THEN '/' || base || '.txt' WHEN 2 THEN base || '.key' WHEN 4 THEN base || '.json' ELSE base || '.txt' END AS path,
CASE k WHEN 0 THEN 'unsafe_path' WHEN 1 THEN 'repeated' WHEN 2 THEN 'sensitive_name' WHEN 3 THEN 'size' WHEN 4 THEN 'config' ELSE 'digest' END AS problem FROM d WHERE k < 6"""
)
def snapshot_problems(spark, sf_dir):
    k = F.col("doc_id") % 7
    path = F.concat(F.when(k == 0, "/").otherwise(""), F.col("source"), F.lit("/"), F.col("doc_id"), F.when(k == 2, ".key").when(k == 4, ".json").otherwise(".txt"))
    text = F.concat(F.lit("text "), "doc_id")
    s = table(spark, sf_dir, "documents").select(
        path.alias("path"), text.alias("content"), (F.octet_length(text) + F.when(k == 3, 1).otherwise(0)).alias("size"), F.lit("text").alias("language"), F.sha2(F.when(k == 5, F.lit("x")).otherwise(text).cast("binary"), 256).alias("blob_id"), k.alias("k"),
    )
    return policy.revalidated(s.unionByName(s.filter("k = 1")))


_PREVIOUS = "SELECT doc_id, source, lang, text FROM documents WHERE doc_id % 2 = 0"


@query(
    """WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS path0, source, lang, strlen('v1 ' || doc_id) AS size FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1'),
n AS (SELECT CAST(doc_id AS VARCHAR) AS path0, source, lang, strlen('v2 ' || (doc_id % 50)) AS size FROM documents WHERE source = 'src1'),
f AS (SELECT *, TRUE AS carried FROM p UNION ALL SELECT *, FALSE FROM n)
SELECT source AS repository_id, path0 || '.txt' AS path, CAST(size AS BIGINT) AS size, carried, CASE WHEN source = 'src1' THEN 'alpha' || CASE WHEN path0 LIKE '1%' THEN ',beta' ELSE '' END WHEN source = 'src2' THEN 'beta' ELSE '' END AS members FROM f"""
)
def ingest_files(spark, sf_dir):
    return _ingested(spark, sf_dir)["files"].select("repository_id", "path", "size", "carried", F.array_join("members", ",").alias("members"))


@query("SELECT DISTINCT sha256('v2 ' || (doc_id % 50)) AS blob_id, 'v2 ' || (doc_id % 50) AS content FROM documents WHERE source = 'src1' AND doc_id % 50 >= 10")
def ingest_blobs(spark, sf_dir):
    return _ingested(spark, sf_dir)["blobs"]


def _ingested(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    one, two = F.concat(F.lit("v1 "), "doc_id"), F.concat(F.lit("v2 "), F.col("doc_id") % 50)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    previous = d.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repository_id"), path.alias("path"), digest(one).alias("blob_id"), F.octet_length(one).cast("bigint").alias("size"), F.lit("text").alias("language"), F.lit("s0").alias("snapshot_id"))
    snapshot = d.filter("source = 'src1'").select(path.alias("path"), two.alias("content"), F.octet_length(two).alias("size"), F.lit("text").alias("language"), digest(two).alias("blob_id"))
    known = spark.range(10).select(digest(F.concat(F.lit("v2 "), "id")).alias("blob_id"))
    roots = [("alpha", "src1", ".", [], []), ("beta", "src2", ".", [], []), ("beta", "src1", ".", ["1*.txt"], [])]
    return ingest.ingest(previous, snapshot, "src1", "s1", roots, known, max_files=None, max_bytes=None)


@query(
    """WITH a AS (SELECT event_type AS name, event_id % 1000 AS fence, event_id AS value FROM events), h AS (SELECT DISTINCT event_type AS name, 500 AS fence, -1 AS value FROM events), u AS (SELECT * FROM a UNION ALL SELECT * FROM h)
SELECT name, CAST(max(fence) AS BIGINT) AS fence FROM u GROUP BY name"""
)
def fenced_heads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    heads = e.select(F.col("event_type").alias("name"), F.lit(500).cast("bigint").alias("fence"), F.lit(-1).cast("bigint").alias("value")).distinct()
    tries = e.select(F.col("event_type").alias("name"), (F.col("event_id") % 1000).cast("bigint").alias("fence"), F.col("event_id").cast("bigint").alias("value"))
    return jobs.publish_fenced(heads, tries).select("name", "fence")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'succeeded' WHEN event_id % 3 = 1 THEN 'cancelled' ELSE 'running' END AS status FROM events")
def job_outcomes_repeated(spark, sf_dir):
    """Several outcomes for one lease, and some for others': one row per job, the first kind counts."""
    j = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.lit("running").alias("status"), F.lit(0).cast("bigint").alias("available_at"), F.lit("w").alias("owner"), F.lit(2).cast("bigint").alias("fence"), F.lit(1).cast("bigint").alias("attempts"), F.lit(100).cast("bigint").alias("lease_until")
    )
    told = F.when(F.col("id") % 3 == 0, F.array(F.lit("fail"), F.lit("complete"), F.lit("cancel"))).when(F.col("id") % 3 == 1, F.array(F.lit("heartbeat"), F.lit("cancel"))).otherwise(F.array(F.lit("heartbeat")))
    own = j.select("id", "owner", "fence", F.explode(told).alias("outcome"))
    return jobs.apply_outcome(j, own.unionByName(j.select("id", "owner", F.lit(1).cast("bigint").alias("fence"), F.lit("fail").alias("outcome"))), 50).select("id", "status")
