"""The registered queries of the library's own operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, embeddings, graphs, policy, projects, rank, search, syntax
from ..streaming import jobs
from ..tables import chunks, conversation_chunks, files, graph, table
from . import retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- ranking ----------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}]+'), lambda z: z <> '')"
_CHUNK_TEXT = "'language=' || lang || '; path=' || source || '/' || doc_id || '; kind=file' || chr(10) || text"


def _bm25_sql(terms: list[str], where: str = "TRUE", limit: int | None = 20) -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    top = f"WHERE rank <= {limit}" if limit else ""
    return f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, {_TOKENS.format(x=_CHUNK_TEXT)} AS t FROM documents WHERE length(text) > 0 AND {where}),
q(term) AS (VALUES {listed}),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda z: z = term)) AS f FROM d, (SELECT DISTINCT term FROM q)),
df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
sc AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term), s WHERE f > 0 GROUP BY id),
r AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)
SELECT id, score, CAST(rank AS INTEGER) AS rank FROM r {top}
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_bm25_sql(["the", "nation", "queestion", "der"]))
def lexical_bm25(spark, sf_dir):
    return _rounded(rank.bm25(chunks(spark, sf_dir), "the nation queestion der", limit=20))


@query(_bm25_sql(["der", "und", "und"], "(source = 'src1' OR lang = 'de')", None))
def lexical_bm25_scoped(spark, sf_dir):
    return _rounded(rank.bm25(chunks(spark, sf_dir), "der und und", projects=["src1", "de"]))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank
FROM documents WHERE length(text) > 0 AND contains(lower('symbol: doc' || doc_id || chr(10) || 'language=' || lang || '; path=' || source || '/' || doc_id || '; kind=file'), 'doc12')
QUALIFY rank <= 50"""
)
def symbol_rank(spark, sf_dir):
    return rank.symbol_rank(chunks(spark, sf_dir), "Doc12", limit=50)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(spark, sf_dir):
    return [float(x) for x in _vectors(spark, sf_dir).filter("id = '00000000'").first()["vector"]]


_COSINE = "CAST(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS FLOAT)"


@query(
    f"""WITH s AS (SELECT lpad(CAST(e.vec_id AS VARCHAR), 8, '0') AS id, {_COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0)
SELECT id, round(CAST(score AS DOUBLE), 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""
)
def cosine_topk(spark, sf_dir):
    found = rank.cosine_top(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20)
    return found.select("id", F.round("score", 4).alias("score"), "rank")


_TOP = _bm25_sql(["the", "nation"], "TRUE", 100)


@query(
    f"""WITH lex AS ({_TOP}),
sym AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS rank FROM documents WHERE length(text) > 0 AND lang = 'en'),
u AS (SELECT id, 'lexical' AS channel, rank FROM lex UNION ALL SELECT id, 'symbol', rank FROM sym WHERE rank <= 100),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, string_agg(channel || ':' || rank, ',' ORDER BY channel) AS provenance FROM u GROUP BY id)
SELECT id, round(score, 6) AS score, provenance FROM f"""
)
def rrf_fuse(spark, sf_dir):
    c = chunks(spark, sf_dir)
    english = rank.ranked(c.filter("array_contains(project_ids, 'en')").filter(F.length("text") > 0).select("id", F.lit(1.0).alias("score")), 100)
    out = rank.fuse({"lexical": rank.bm25(c, "the nation", limit=100), "symbol": english})
    return out.select("id", F.round("score", 6).alias("score"), F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p["channel"], p["rank"])), ",").alias("provenance"))


@query(
    f"""WITH lex AS ({_TOP}),
sym AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS rank FROM documents
        WHERE length(text) > 0 AND contains(lower('symbol: doc' || doc_id || chr(10) || 'language=' || lang || '; path=' || source || '/' || doc_id || '; kind=file'), 'the nation')),
u AS (SELECT id, 'lexical' AS channel, rank FROM lex UNION ALL SELECT id, 'symbol', rank FROM sym),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY id)
SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20"""
)
def hybrid(spark, sf_dir):
    found, _ = retrieval.retrieve(chunks(spark, sf_dir), "the nation", "hybrid", 20)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH lex AS ({_TOP}), l AS (SELECT CAST(doc_id AS VARCHAR) AS id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
s AS (SELECT id, lex.rank AS before, CAST(coalesce(q, 0) * 10 - coalesce(t, 0) * 5 AS DOUBLE) - lex.rank / 1000.0 AS score FROM lex LEFT JOIN l USING (id))
SELECT id, CAST(before AS INTEGER) AS before, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM s"""
)
def rerank_top100(spark, sf_dir):
    found = rank.bm25(chunks(spark, sf_dir), "the nation", limit=100)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    scored = found.join(labels, "id", "left").select("id", ((F.coalesce("q", F.lit(0)) * 10 - F.coalesce("t", F.lit(0)) * 5).cast("double") - F.col("rank") / 1000.0).alias("score"))
    return rank.rerank(found, scored).select("id", "before", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS shape FROM documents)
SELECT shape, count(*) AS n, min(id) AS first_id FROM s GROUP BY shape HAVING count(*) > 1"""
)
def structural_dup_groups(spark, sf_dir):
    return rank.structural_groups(chunks(spark, sf_dir))


# --- boolean search ---------------------------------------------------------------------------------


def _search(text: str, **options):
    def run(spark, sf_dir):
        return search.matching(files(spark, sf_dir), text, **options).select("id", "path")

    return run


def _search_sql(where: str) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || doc_id || '.txt' AS path FROM documents WHERE {where}"


for _name, _text, _where, _options in (
    ("search_boolean_and_not", "tion NOT queest AND the", "contains(lower(text), 'tion') AND NOT contains(lower(text), 'queest') AND contains(lower(text), 'the')", {}),
    ("search_boolean_or", "(stupid OR idiot) OR worthless", "contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') OR contains(lower(text), 'worthless')", {}),
    ("search_boolean_nested", "(stupid OR thanwhha) AND NOT (idiot OR lang:de)", "(contains(lower(text), 'stupid') OR contains(lower(text), 'thanwhha')) AND NOT (contains(lower(text), 'idiot') OR lower(lang) = 'de')", {}),
    ("search_phrase", '"of the " AND repo:src1', "contains(lower(text), 'of the ') AND source = 'src1'", {}),
    ("search_case_sensitive", "Tion", "contains(text, 'Tion')", {"case_sensitive": True}),
    ("search_regex", "/th(er|in)[a-z]*tion/ NOT /[0-9]{4}/", "regexp_matches(lower(text), 'th(er|in)[a-z]*tion') AND NOT regexp_matches(text, '[0-9]{4}')", {}),
    ("search_exact_field", "lang:FR AND project:src2", "lang = 'fr' AND (source = 'src2' OR lang = 'src2')", {}),
    ("search_filters", "file:7.txt path:src7 generated:false test:false", "contains(CAST(doc_id AS VARCHAR) || '.txt', '7.txt') AND contains(source || '/' || doc_id || '.txt', 'src7') AND NOT contains(text, 'Code generated')", {}),
    ("search_scoped", "the", "contains(lower(text), 'the') AND (source = 'src4' OR lang = 'es') AND source IN ('src4', 'src5')", {"projects": ["src4", "es"], "repositories": ["src4", "src5"]}),
):
    QUERIES[_name] = _search(_text, **_options)
    ORACLE[_name] = _search_sql(_where)


@query(
    """WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, source || '/' || doc_id || '.txt' AS path, lang FROM documents WHERE contains(lower(text), 'thing')),
p AS (SELECT *, row_number() OVER (ORDER BY source, path, id) AS k, count(*) OVER () AS total FROM m)
SELECT id, path, total, 'en' AS visible FROM p WHERE k > 10 AND k <= 60 AND lang = 'en'
UNION ALL SELECT id, path, total, '' AS visible FROM p WHERE k > 10 AND k <= 60 AND lang <> 'en'"""
)
def search_paged_total(spark, sf_dir):
    f = files(spark, sf_dir)
    page, total = search.search(f, "thing", offset=10, limit=50)
    shown = page.withColumn("visible", F.array_join(search.visible_projects(["en"]), ","))
    return shown.crossJoin(F.broadcast(total)).select("id", "path", "total", "visible")


@query(
    """WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, source || '/' || doc_id || '.txt' AS path, strlen(text) AS bytes FROM documents ORDER BY source, path, id LIMIT 500),
r AS (SELECT *, sum(bytes) OVER (ORDER BY source, path, id ROWS UNBOUNDED PRECEDING) AS so_far FROM o)
SELECT id, path, CAST(so_far AS BIGINT) AS so_far FROM r WHERE so_far <= 400000"""
)
def search_budget_cutoff(spark, sf_dir):
    return search.within_budget(files(spark, sf_dir), 500, 400_000).select("id", "path", "so_far")


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE contains(lower(text), 'stupid')),
p AS (SELECT id, text, string_split(lower(text), 'stupid') AS parts FROM d),
k AS (SELECT id, parts, text, unnest(generate_series(1, len(parts) - 1)) AS k FROM p),
c AS (SELECT id, k, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 6 AS chars, text FROM k)
SELECT id, CAST(strlen(substr(text, 1, CAST(chars AS INTEGER))) AS BIGINT) AS "start", CAST(strlen(substr(text, 1, CAST(chars AS INTEGER))) + 6 AS BIGINT) AS "end" FROM c"""
)
def search_ranges(spark, sf_dir):
    found = search.with_ranges(files(spark, sf_dir), "STUPID")
    return found.select("id", F.explode("ranges").alias("r")).select("id", "r.start", "r.end")


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, upper(text) AS t FROM documents)
SELECT id FROM d WHERE contains(t, 'TUP') AND contains(t, 'UPI') AND contains(t, 'PID') AND contains(t, 'STU')"""
)
def trigram_candidates(spark, sf_dir):
    return search.candidates(search.trigram_index(files(spark, sf_dir)), "stupid")


@query(
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10)) AS parts FROM documents),
k AS (SELECT id, parts, unnest(generate_series(1, len(parts))) AS k FROM l)
SELECT id, CAST(k - 1 AS INTEGER) AS line, CAST(coalesce(list_sum(list_transform(parts[1:k-1], lambda x: strlen(x) + 1)), 0) AS BIGINT) AS "start",
       CAST(coalesce(list_sum(list_transform(parts[1:k-1], lambda x: strlen(x) + 1)), 0) + strlen(parts[k]) AS BIGINT) AS "end" FROM k"""
)
def line_index(spark, sf_dir):
    return search.lines(files(spark, sf_dir)).select("id", "line", "start", "end")


# --- chunks and context -----------------------------------------------------------------------------


@query()
def chunk_split(spark, sf_dir):
    return chunking.split_files(files(spark, sf_dir), 1024).select("id", "file_id", "start", "end", "kind", "header")


@query(
    """WITH c AS (SELECT conv_id, turn, CAST(turn * 100000 AS BIGINT) AS s, CAST(turn * 100000 + strlen(text) AS BIGINT) AS e FROM conversations),
m AS (SELECT 'c' || conv_id AS file_id, s, e FROM c UNION ALL SELECT 'c' || conv_id, CAST((max(turn) + 1) * 100000 AS BIGINT), CAST((max(turn) + 1) * 100000 AS BIGINT) FROM c GROUP BY conv_id),
g AS (SELECT file_id, coalesce(max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, s FROM m)
SELECT file_id, f AS "start", s AS "end" FROM g WHERE f < s"""
)
def chunk_gaps(spark, sf_dir):
    c = conversation_chunks(spark, sf_dir).filter("parent_id <> ''")
    sizes = c.groupBy("file_id").agg((F.floor(F.max("start") / 100000) * 100000 + 100000).alias("size"))
    return chunking.gaps(c, sizes)


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, 'language=' || lang || '; path=' || source || '/' || doc_id || '; kind=file' AS h, 'Doc' || doc_id AS decl FROM documents)
SELECT id, 1 AS position, 'code' AS kind, sha256(text) AS digest FROM d WHERE text <> ''
UNION ALL SELECT id, 2, 'symbol', sha256('symbol: ' || decl || chr(10) || h) FROM d
UNION ALL SELECT id, 3, 'context', sha256(h) FROM d
UNION ALL SELECT id, 4, 'api', sha256('api: ' || decl || chr(10) || h) FROM d"""
)
def representations_expand(spark, sf_dir):
    c = chunks(spark, sf_dir)
    reps = chunking.representations(F.col("text"), F.col("header"), F.concat(F.lit("Doc"), "id"), F.lit(""))
    out = c.select("id", F.posexplode(reps).alias("p", "r"))
    return out.select("id", (F.col("p") + 1).alias("position"), "r.kind", F.sha2(F.col("r.text").cast("binary"), 256).alias("digest"))


@query(
    """WITH RECURSIVE c AS (SELECT 'c' || conv_id AS root_id, 'c' || conv_id || '-' || turn AS id, turn,
   strlen('c' || conv_id || '-' || turn) + 2 * strlen('c' || conv_id) + strlen('role=' || role) + strlen(text) AS size, text FROM conversations),
o AS (SELECT root_id, id, size, text, row_number() OVER (PARTITION BY root_id ORDER BY turn, id) AS k FROM c),
f AS (SELECT root_id, root_id AS id, CAST(0 AS BIGINT) AS k, CAST(2 * strlen(root_id) + 12 AS BIGINT) AS size, CAST(2 * strlen(root_id) + 12 AS BIGINT) AS used, 'taken' AS outcome FROM (SELECT DISTINCT root_id FROM c)
      UNION ALL SELECT o.root_id, o.id, o.k, o.size, CASE WHEN f.used + o.size > 2000 THEN f.used ELSE f.used + o.size END,
      CASE WHEN f.used + o.size > 2000 THEN 'budget' ELSE 'taken' END FROM f JOIN o ON o.root_id = f.root_id AND o.k = f.k + 1)
SELECT root_id, CAST(k AS INTEGER) AS position, id, size, outcome FROM f"""
)
def context_budget(spark, sf_dir):
    c = conversation_chunks(spark, sf_dir)
    return chunking.context(c, c.filter("parent_id = ''"), 2000)


# --- projects ---------------------------------------------------------------------------------------

_ROOTS = [("alpha", "src1", "src1", ["1*.txt", "**/9?.txt"], ["*7.txt"]), ("beta", "src2", ".", [], []), ("beta", "src1", ".", ["**/*5.txt"], []), ("gamma", "src1", "src1", ["[2-4]*.txt"], [])]


@query(
    """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, CAST(doc_id AS VARCHAR) || '.txt' AS name FROM documents),
m AS (SELECT id, 'alpha' AS p FROM f WHERE source = 'src1' AND (name LIKE '1%.txt' OR regexp_full_match(name, '9[^/].txt')) AND NOT name LIKE '%7.txt'
UNION SELECT id, 'beta' FROM f WHERE source = 'src2' OR (source = 'src1' AND name LIKE '%5.txt')
UNION SELECT id, 'gamma' FROM f WHERE source = 'src1' AND regexp_full_match(name, '[2-4].*[.]txt'))
SELECT f.id, coalesce(string_agg(p, ',' ORDER BY p), '') AS members FROM f LEFT JOIN m USING (id) GROUP BY f.id"""
)
def membership_glob(spark, sf_dir):
    return projects.membership(files(spark, sf_dir), _ROOTS).select("id", F.array_join("members", ",").alias("members"))


_ENTRIES = "SELECT CAST(('0x' || substr(sha256(source || '/' || doc_id || '.txt'), 1, 2)) AS INTEGER) AS shard, source || '/' || doc_id || '.txt' || chr(0) || sha256(text) AS entry FROM documents"
_SHARDS = f"SELECT shard, count(*) AS n, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS digest FROM ({_ENTRIES}) GROUP BY shard"


@query(_SHARDS)
def manifest_shards(spark, sf_dir):
    return projects.manifest_shards(files(spark, sf_dir))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(shard || ':' || digest, chr(10) ORDER BY shard)) AS fingerprint FROM ({_SHARDS})")
def manifest_root(spark, sf_dir):
    return projects.manifest_root(projects.manifest_shards(files(spark, sf_dir)))


@query(
    """WITH r AS (SELECT lang AS project_id, source || '|' || source || '/' || doc_id || '.txt' || '|' || sha256(text) AS entry FROM documents),
p AS (SELECT project_id, substr(sha256(entry), 1, 2) AS part, count(*) AS n, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS d FROM r GROUP BY 1, 2)
SELECT project_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part)) AS fingerprint FROM p GROUP BY project_id"""
)
def source_fingerprints(spark, sf_dir):
    return projects.source_fingerprint(files(spark, sf_dir).withColumn("members", F.array("language")))


_FAMILIES = list(projects.DEPENDENCIES)
_EDGES = ", ".join(f"('{d}', '{f}')" for f, deps in projects.DEPENDENCIES.items() for d in deps)


@query(
    f"""WITH RECURSIVE e(source, family) AS (VALUES {_EDGES}), h AS (SELECT 'reference' AS family UNION SELECT e.family FROM h JOIN e ON e.source = h.family)
SELECT family FROM h"""
)
def projection_downstream(spark, sf_dir):
    return projects.downstream(spark, ["reference"])


@query(
    f"""WITH s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS view_id, CASE event_type WHEN 'click' THEN 'source_text' WHEN 'view' THEN 'structure' WHEN 'purchase' THEN 'call' WHEN 'signup' THEN 'vector' ELSE 'context' END AS family FROM events),
g AS (SELECT view_id, family FROM (SELECT DISTINCT view_id FROM s), (VALUES {", ".join(f"('{f}')" for f in _FAMILIES)}) t(family))
SELECT g.view_id, CASE WHEN s.family IS NULL THEN 'not_requested' ELSE 'ready' END AS status, count(*) AS n FROM g LEFT JOIN s USING (view_id, family) GROUP BY 1, 2"""
)
def projection_readiness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    family = F.when(F.col("event_type") == "click", "source_text").when(F.col("event_type") == "view", "structure").when(F.col("event_type") == "purchase", "call").when(F.col("event_type") == "signup", "vector").otherwise("context")
    states = e.select(F.col("user_id").cast("string").alias("view_id"), family.alias("family"), F.lit("ready").alias("status")).distinct()
    return projects.readiness(states, _FAMILIES)


def _risk_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    some = lambda c, every, part: F.when(F.col("doc_id") % every != part, c)
    return d.select(
        "doc_id", some(F.col("n_chars") % 101, 7, 0).alias("complexity"), some(F.col("doc_id") % 97, 5, 1).alias("churn"), some(F.col("n_chars") % 89, 3, 2).alias("change_frequency"),
        some(F.col("doc_id") % 83, 4, 3).alias("dependency_exposure"), some(F.col("n_chars") % 79, 6, 4).alias("ownership"), some(F.col("doc_id") % 73, 2, 1).alias("coverage_gap"),
        (F.col("doc_id") % 2 * 100).alias("confirmed_bugs"),
    )


_RISK_CTE = """v AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 101 END AS a, CASE WHEN doc_id % 5 <> 1 THEN doc_id % 97 END AS b, CASE WHEN doc_id % 3 <> 2 THEN n_chars % 89 END AS c,
 CASE WHEN doc_id % 4 <> 3 THEN doc_id % 83 END AS d, CASE WHEN doc_id % 6 <> 4 THEN n_chars % 79 END AS e, CASE WHEN doc_id % 2 <> 1 THEN doc_id % 73 END AS f, doc_id % 2 * 100 AS g FROM documents),
k AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 20 END + CASE WHEN b IS NULL THEN 0 ELSE 15 END + CASE WHEN c IS NULL THEN 0 ELSE 15 END + CASE WHEN d IS NULL THEN 0 ELSE 15 END + CASE WHEN e IS NULL THEN 0 ELSE 10 END + CASE WHEN f IS NULL THEN 0 ELSE 20 END + 5 AS known FROM v)"""


@query(
    f"""WITH {_RISK_CTE},
s AS (SELECT doc_id, known, CASE WHEN known >= 70 THEN CAST(coalesce(a, 0) * 20 + coalesce(b, 0) * 15 + coalesce(c, 0) * 15 + coalesce(d, 0) * 15 + coalesce(e, 0) * 10 + coalesce(f, 0) * 20 + g * 5 AS DOUBLE) / known END AS score FROM k)
SELECT doc_id, round(known / 100.0, 6) AS known_weight, known >= 70 AS sufficient, round(score, 6) AS score,
CASE WHEN score IS NULL THEN 'insufficient' WHEN score < 34 THEN 'low' WHEN score < 67 THEN 'medium' ELSE 'high' END AS tier FROM s"""
)
def risk_score(spark, sf_dir):
    out = projects.risk(_risk_values(spark, sf_dir), "doc_id")
    return out.withColumns({"known_weight": F.round("known_weight", 6), "score": F.round("score", 6)})


@query(f"WITH {_RISK_CTE} SELECT doc_id, round(CAST(b * 15 AS DOUBLE) / known, 6) AS contribution, b IS NOT NULL AS known FROM k")
def risk_breakdown(spark, sf_dir):
    out = projects.risk_breakdown(_risk_values(spark, sf_dir), "doc_id").filter("factor = 'churn'")
    return out.select("doc_id", F.round("contribution", 6).alias("contribution"), "known")


# --- policy and configuration -----------------------------------------------------------------------

# RE2's \s has no vertical tab, so that the SQL spells the set out where the two differ.
_SQL_SUSPICIOUS = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in policy.SUSPICIOUS)


@query(f"SELECT doc_id, coalesce({_SQL_SUSPICIOUS}, FALSE) AS suspicious FROM documents")
def suspicious_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", policy.suspicious(F.col("text")).alias("suspicious"))




@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '') || CASE page_id % 5 WHEN 0 THEN '/my_Token.txt' WHEN 1 THEN '/.ssh/config' WHEN 2 THEN '/cert.PEM' WHEN 3 THEN '/main.go' ELSE '/a.TSX' END AS path FROM pages)
SELECT page_id, path, page_id % 5 < 3 AS sensitive, CASE page_id % 5 WHEN 3 THEN 'go' WHEN 4 THEN 'typescript' ELSE 'text' END AS language FROM p"""
)
def sensitive_paths(spark, sf_dir):
    k = F.col("page_id") % 5
    suffix = F.when(k == 0, "/my_Token.txt").when(k == 1, "/.ssh/config").when(k == 2, "/cert.PEM").when(k == 3, "/main.go").otherwise("/a.TSX")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", ""), suffix).alias("path"))
    return p.select("page_id", "path", policy.sensitive_path(F.col("path")).alias("sensitive"), policy.language(F.col("path")).alias("language"))


@query("SELECT event_id AS id, unnest(json_keys(props)) AS name FROM events")
def config_keys_json(spark, sf_dir):
    return projects.json_keys(table(spark, sf_dir, "events"), "event_id", "props")


# --- graph ------------------------------------------------------------------------------------------

_NODES = """SELECT 'r:' || r_regionkey AS id, 'package' AS kind, r_name AS name, 'geo' AS p FROM region UNION ALL SELECT 'n:' || n_nationkey, 'package', n_name, 'geo' FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'symbol', c_name, 'sales' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'symbol', s_name, 'supply' FROM supplier
UNION ALL SELECT 'p:' || p_partkey, 'type', p_name, 'supply' FROM part UNION ALL SELECT 'o:' || o_orderkey, 'call_site', o_orderpriority, 'sales' FROM orders"""
_LINKS = """SELECT DISTINCT 'contains' AS kind, 'r:' || n_regionkey AS s, 'n:' || n_nationkey AS t FROM nation UNION SELECT 'contains', 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
UNION SELECT 'contains', 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier UNION SELECT 'contains', 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
UNION SELECT 'references', 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem UNION SELECT 'calls', 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem"""
_G = f"n AS ({_NODES}), e AS ({_LINKS})"


@query(f"WITH {_G} SELECT id, kind, name FROM n WHERE name = '1-URGENT' ORDER BY id LIMIT 100")
def graph_symbols(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    return graphs.by_name(nodes, "1-URGENT", 100).select("id", "kind", "name")


@query(f"WITH {_G} SELECT e.kind || '|' || s || '|' || t AS id, s AS source_id, n.name AS source_name FROM e JOIN n ON n.id = e.s WHERE t = 'p:5' AND e.kind = 'references'")
def graph_incoming(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return graphs.incoming(nodes, edges, "p:5").select("id", "source_id", "source_name")


@query(f"WITH {_G} SELECT e.kind || '|' || s || '|' || t AS id, t AS target_id, n.name AS target_name FROM e JOIN n ON n.id = e.t WHERE s = 'o:7' AND e.kind IN ('calls', 'references')")
def graph_outgoing(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return graphs.outgoing(nodes, edges, "o:7", ["calls", "references"]).select("id", "target_id", "target_name")


@query(f"WITH {_G} SELECT a.t AS site_id, b.t AS callee_id, 'candidate' AS resolution FROM e a JOIN e b ON b.s = a.t AND b.kind = 'calls' WHERE a.s = 'c:11' AND a.kind = 'contains'")
def graph_callees_2hop(spark, sf_dir):
    return graphs.callees(*graph(spark, sf_dir), "c:11")


@query(
    f"""WITH RECURSIVE {_G}, u AS (SELECT s AS a, t AS b FROM e WHERE kind = 'contains' UNION SELECT t, s FROM e WHERE kind = 'contains'),
h AS (SELECT 'r:0' AS id, 0 AS depth UNION SELECT u.b, h.depth + 1 FROM h JOIN u ON u.a = h.id WHERE h.depth < 2)
SELECT id, min(depth) AS depth FROM h GROUP BY id"""
)
def graph_neighbors(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    return graphs.neighbours(edges.filter("kind = 'contains'"), "r:0", 2, None)


@query(
    f"""WITH RECURSIVE {_G}, h AS (SELECT 'r:1' AS path, 'r:1' AS node, 0 AS length UNION ALL SELECT h.path || '>' || e.t, e.t, h.length + 1 FROM h JOIN e ON e.s = h.node
WHERE h.length < 4 AND h.node <> 's:3' AND NOT list_contains(string_split(h.path, '>'), e.t))
SELECT path, length FROM h WHERE node = 's:3' ORDER BY length, path LIMIT 100"""
)
def graph_paths(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    return graphs.paths(edges, "r:1", "s:3", 4).select("path", "length")


@query(
    f"""WITH RECURSIVE {_G}, h AS (SELECT id AS root, id, 0 AS depth FROM n WHERE kind = 'package' AND id LIKE 'r:%' UNION SELECT h.root, e.t, h.depth + 1 FROM h JOIN e ON e.s = h.id AND e.kind = 'contains' WHERE h.depth < 2)
SELECT root, id, min(depth) AS depth, min(depth) = 2 AND max(coalesce(k.s, '')) <> '' AS cut FROM h LEFT JOIN (SELECT DISTINCT s FROM e WHERE kind = 'contains') k ON k.s = h.id GROUP BY root, id"""
)
def graph_descendants(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return graphs.descendants(edges, nodes.filter("id like 'r:%'"), 2)


@query(f"WITH {_G}, k AS (SELECT id FROM n WHERE p IN ('geo', 'supply')) SELECT e.kind || '|' || s || '|' || t AS id FROM e WHERE s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)")
def graph_scope(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    kept = nodes.filter(F.arrays_overlap("project_ids", F.array(F.lit("geo"), F.lit("supply"))))
    return graphs.scope(kept, edges, ["all"])[1].select("id")


@query(
    f"""WITH {_G}, k AS (SELECT id FROM n WHERE p <> 'supply')
SELECT 'no source_id' AS problem, count(*) AS n FROM e WHERE s NOT IN (SELECT id FROM k) UNION ALL SELECT 'no target_id', count(*) FROM e WHERE t NOT IN (SELECT id FROM k)
UNION ALL SELECT 'repeated edge', 0 UNION ALL SELECT 'repeated node', 0"""
)
def graph_validate(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return graphs.problems(nodes.filter("NOT array_contains(project_ids, 'supply')"), edges)


@query("SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_nationkey % 2 = 1")
def graph_merge_conflicts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    one = s.select("id", "name", F.lit(1).alias("shard"))
    two = s.select("id", F.when(F.col("s_nationkey") % 2 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), F.lit(2).alias("shard"))
    return graphs.merge(one.unionByName(two))[1]


@query(f"WITH {_G} SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, count(*) FILTER (kind = 'references') AS references_exact, count(*) FILTER (kind = 'calls') AS calls_candidate FROM e")
def graph_completeness(spark, sf_dir):
    return graphs.completeness(*graph(spark, sf_dir)).select("nodes", "edges", "references_exact", "calls_candidate")


@query(
    """WITH d AS (SELECT p_type AS name, count(*) AS n, min('p:' || p_partkey) AS t FROM part GROUP BY p_type)
SELECT 'x:' || p_partkey AS id, p_type AS name, CASE WHEN n = 1 THEN t END AS target_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'exact' ELSE 'candidate' END AS resolution FROM part LEFT JOIN d ON d.name = p_type"""
)
def resolve_references(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    refs = p.select(F.concat(F.lit("x:"), "p_partkey").alias("id"), F.col("p_type").alias("name"))
    return graphs.resolve_references(refs, p.select(F.col("p_type").alias("name"), F.concat(F.lit("p:"), "p_partkey").alias("id")))


# --- parsed source ----------------------------------------------------------------------------------


def _turn_reports(spark, sf_dir):
    """Conversations as parsed files: a declaration per turn, nested in the one before it, a reference per turn."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("file_id"), "turn", "role", F.octet_length("text").cast("bigint").alias("size"))
    none = F.array()
    symbol = F.struct(
        F.col("turn").cast("string").alias("id"), F.col("role").alias("name"), F.lit("function").alias("kind"), F.when(F.col("turn") == 0, "").otherwise((F.col("turn") - 1).cast("string")).alias("parent_id"),
        F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"), F.lit(None).cast("string").alias("type"), F.lit("public").alias("visibility"), none.cast("array<string>").alias("modifiers"),
        none.cast("array<string>").alias("attributes"), none.cast(f"array<{syntax.PARAMETER}>").alias("parameters"),
    )
    use = F.struct(F.col("role").alias("name"), F.when(F.col("turn") % 2 == 0, "call").otherwise("read").alias("kind"), F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    rows = c.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("turn", symbol.alias("s"), use.alias("u")))).alias("t"), F.sum("size").alias("size"))
    return rows.select(
        "file_id", "size", F.transform("t", lambda t: t["s"]).alias("symbols"), F.transform("t", lambda t: t["u"]).alias("references"),
        none.cast(f"array<{syntax.IMPORT}>").alias("imports"), F.lit(True).alias("valid"), none.cast(f"array<{syntax.REFERENCE}>").alias("diagnostics"),
    )


@query(
    """SELECT 'node file' AS what, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'node declaration', count(*) FROM conversations
UNION ALL SELECT 'node call', count(*) FILTER (turn % 2 = 0) FROM conversations UNION ALL SELECT 'node reference', count(*) FILTER (turn % 2 = 1) FROM conversations
UNION ALL SELECT 'edge contains', 2 * count(*) FROM conversations UNION ALL SELECT 'edge declares', count(*) FROM conversations"""
)
def structure_graph_build(spark, sf_dir):
    reports = _turn_reports(spark, sf_dir)
    sources = reports.select(F.col("file_id").alias("id"), F.col("file_id").alias("path"), F.lit("r").alias("repository_id"), F.array(F.lit("p")).alias("project_ids"), F.lit("").alias("content"))
    nodes, edges = syntax.structure_graph(sources, reports.drop("size"))
    count = lambda df, what: df.groupBy(F.concat(F.lit(what), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes.dropDuplicates(["id"]), "node ").unionByName(count(edges.dropDuplicates(["id"]), "edge "))


@query(
    """WITH s AS (SELECT conv_id, turn FROM conversations WHERE role = 'system'), r AS (SELECT conv_id, count(*) AS k FROM s GROUP BY conv_id)
SELECT 'c' || c.conv_id AS file_id, count(*) AS declarations, max(r.k) AS "references" FROM conversations c JOIN r USING (conv_id)
WHERE EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.turn <= c.turn AND c.turn - s.turn <= 32) GROUP BY c.conv_id"""
)
def syntax_query(spark, sf_dir):
    found = syntax.query(_turn_reports(spark, sf_dir), "system")
    return found.select("file_id", F.size("symbols").cast("bigint").alias("declarations"), F.size("references").cast("bigint").alias("references"))


# --- types ------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT DISTINCT p_type AS query FROM part UNION SELECT 'nothing such'), t AS (SELECT p_type AS query, count(*) AS n, min(lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS first_id FROM part WHERE p_brand = 'Brand#11' GROUP BY p_type)
SELECT q.query, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n, first_id FROM q LEFT JOIN t USING (query)"""
)
def type_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    types = p.select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.col("p_type").alias("name"), F.lit(None).cast("string").alias("qualified_name"),
        F.col("p_brand").alias("project_id"), F.lit("").alias("profile_id"), F.lit("").alias("version_id"),
    )
    names = p.select(F.col("p_type").alias("query")).distinct().unionByName(spark.createDataFrame([("nothing such",)], "query string"))
    return projects.type_lookup(types, names, project="Brand#11")


@query(
    """SELECT l_partkey AS type_id, count(*) FILTER (l_returnflag = 'N') AS fields, count(*) FILTER (l_returnflag = 'R') AS properties, count(*) FILTER (l_returnflag = 'A') AS methods,
CAST(0 AS BIGINT) AS constructors, CAST(0 AS BIGINT) AS constants, CAST(0 AS BIGINT) AS enum_members, CAST(sum(l_linenumber) AS BIGINT) AS parameters, CAST(sum(l_suppkey % 2) AS BIGINT) AS returns,
CAST(sum(l_suppkey % 5) AS BIGINT) AS generic_parameters, CAST(0 AS BIGINT) AS occurrences, CAST(sum(l_suppkey % 3) AS BIGINT) AS attributes FROM lineitem GROUP BY l_partkey"""
)
def type_member_counts(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "N", "field").when(F.col("l_returnflag") == "R", "property").otherwise("method")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("type_id"), kind.alias("kind"), F.col("l_linenumber").alias("parameters"), (F.col("l_suppkey") % 3).alias("attributes"), (F.col("l_suppkey") % 2).alias("returns"), (F.col("l_suppkey") % 5).alias("generic_parameters"))
    return projects.member_counts(members)


@query(
    """WITH c AS (SELECT conv_id AS group_id, turn AS position, CASE WHEN role = 'user' THEN text END AS expression FROM conversations),
g AS (SELECT *, count(expression) OVER (PARTITION BY group_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT group_id, position, max(expression) OVER (PARTITION BY group_id, k) AS expression FROM g"""
)
def constants_carried(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), F.lit("x").alias("name"), F.lit("string").alias("type"), F.when(F.col("role") == "user", F.col("text")).alias("expression")
    )
    return projects.constant_groups(c).select("group_id", "position", "expression")


# --- embeddings -------------------------------------------------------------------------------------


@query("SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, label FROM embeddings ORDER BY id LIMIT 16 OFFSET 32")
def embeddings_page(spark, sf_dir):
    return embeddings.page(_vectors(spark, sf_dir).select("id", "label"), 32)[0]


@query("SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, label FROM embeddings WHERE label % 3 <> 0")
def embed_missing(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "label")
    return embeddings.missing(v, v.filter("label % 3 = 0"))


@query("SELECT count(*) AS n FROM embeddings WHERE len(embedding) <> 64 OR vec_id % 100 = 7")
def embedding_problems(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    broken = v.withColumn("vector", F.when(F.col("id").cast("int") % 100 == 7, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")))
    return embeddings.problems(broken, 64).agg(F.count(F.lit(1)).alias("n"))


# --- jobs -------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS t FROM events), l AS (SELECT key, t, lag(t) OVER (PARTITION BY key ORDER BY t) AS b FROM s),
g AS (SELECT key, t, sum(CASE WHEN b IS NULL OR t - b >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT CAST(key AS BIGINT) AS key, min(t) AS "first", max(t) AS "last", least(max(t) + 7200000, min(t) + 100000000000) AS fires, count(*) AS n FROM g GROUP BY key, session"""
)
def debounce_batches(spark, sf_dir):
    return jobs.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), 7_200_000, 100_000_000_000)


@query(
    """WITH RECURSIVE s AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
f AS (SELECT key, k, t, t AS "first" FROM s WHERE k = 1 UNION ALL
      SELECT s.key, s.k, s.t, CASE WHEN s.t - f.t >= 7200000 OR s.t >= f."first" + 14400000 THEN s.t ELSE f."first" END FROM f JOIN s ON s.key = f.key AND s.k = f.k + 1)
SELECT key, "first", max(t) AS "last", least(max(t) + 7200000, "first" + 14400000) AS fires, count(*) AS n FROM f GROUP BY key, "first" """
)
def debounce_capped(spark, sf_dir):
    return jobs.debounced(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), 7_200_000, 14_400_000)


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"), F.when(F.col("event_type") == "error", "running").otherwise("queued").alias("status"), F.round("value", 0).cast("bigint").alias("priority"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("available_at"), F.lit("w0").alias("owner"), (F.col("event_id") % 5).alias("fence"), (F.col("event_id") % 7).alias("attempts"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + 60).alias("lease_until"),
    )


_JOBS = """j AS (SELECT lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, CASE WHEN event_type = 'error' THEN 'running' ELSE 'queued' END AS status, CAST(CASE WHEN value < 0 THEN ceil(value - 0.5) ELSE floor(value + 0.5) END AS BIGINT) AS priority,
 CAST(floor(epoch(ts)) AS BIGINT) AS a, event_id % 5 AS fence, event_id % 7 AS attempts, CAST(floor(epoch(ts)) AS BIGINT) + 60 AS lease FROM events)"""
_NOW = 1705276800


@query(
    f"""WITH {_JOBS} SELECT id, 'running' AS status, fence + 1 AS fence, attempts + 1 AS attempts, CAST({_NOW + 60} AS BIGINT) AS lease_until FROM j
WHERE (status = 'queued' AND a <= {_NOW}) OR (status = 'running' AND lease <= {_NOW}) ORDER BY priority DESC, a, id LIMIT 25"""
)
def job_claim_next(spark, sf_dir):
    return jobs.claim(_jobs(spark, sf_dir), _NOW, "w1", 25).select("id", "status", "fence", "attempts", "lease_until")


@query(
    f"""WITH {_JOBS} SELECT id, CASE WHEN status = 'running' AND lease > {_NOW} AND fence <> 4 THEN CASE WHEN attempts <= 5 THEN 'queued' ELSE 'failed' END ELSE status END AS status,
CASE WHEN status = 'running' AND lease > {_NOW} AND fence <> 4 AND attempts <= 5 THEN CAST({_NOW} + pow(2, least(attempts, 8)) AS BIGINT) ELSE a END AS available_at FROM j"""
)
def job_outcomes(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    failures = j.select("id", "owner", F.when(F.col("fence") == 4, 99).otherwise(F.col("fence")).alias("fence"), F.lit("fail").alias("outcome"))
    return jobs.apply_outcome(j, failures, _NOW).select("id", "status", "available_at")


@query("SELECT DISTINCT sha256(event_type || chr(0) || user_id) AS id FROM events WHERE user_id % 4 <> 0")
def event_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("key"), F.lit(0).alias("priority"), F.col("ts").alias("available_at"))
    there = e.filter("user_id % 4 = 0").select(F.sha2(F.concat("event_type", F.char(F.lit(0)), F.col("user_id").cast("string")).cast("binary"), 256).alias("id")).distinct()
    return jobs.enqueue(there, r).select("id")


@query(
    """WITH l AS (SELECT user_id AS agent, ts, event_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT agent, event_id AS at, s AS snapshot_id FROM l WHERE b IS NULL OR b <> s"""
)
def captures_changed(spark, sf_dir):
    return jobs.new_snapshots(table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_id").alias("at"), F.col("event_type").alias("snapshot_id")))


