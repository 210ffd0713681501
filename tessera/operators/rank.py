"""Ranking: BM25, symbol and structural similarity, exact cosine, reciprocal-rank fusion, reranking."""

from __future__ import annotations

import ast
import hashlib
import math
import textwrap
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.folding import tokens
from ..session import importable

K1, B, RRF_K = 1.2, 0.75, 60
CHANNEL_CUT = RERANK_CUT = 100


def scoped(chunks: DataFrame, projects: list[str] | None = None, repositories: list[str] | None = None) -> DataFrame:
    out = chunks
    if projects:
        out = out.filter(F.arrays_overlap("project_ids", F.array(*map(F.lit, projects))))
    if repositories:
        out = out.filter(F.col("repository_id").isin(repositories))
    return out


def query_tokens(spark, query: str) -> list[str]:
    """The query's terms by the same expression as the documents'; repeated terms stay repeated."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def bm25(chunks: DataFrame, query: str, k1: float = K1, b: float = B, limit: int | None = None, projects=None, repositories=None) -> DataFrame:
    """(id, score, rank): chunks with text, by header and text; a term repeated in the query counts each time.

    One pass over the text: a chunk's length and its counts of the query's terms are computed where it is read, and
    dealt out by id; statistics and scores both read that one exchange of small rows.
    """
    if not (math.isfinite(k1) and k1 > 0 and 0 <= b <= 1) or len(query.encode()) > 8192 or len(projects or ()) > 128 or len(set(projects or ())) < len(projects or ()):
        raise ValueError("k1, b, query or scope out of bounds")
    spark = chunks.sparkSession
    wanted = Counter(query_tokens(spark, query))
    terms = sorted(wanted)
    docs = scoped(chunks, projects, repositories).filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    toks = tokens(F.concat("header", F.lit("\n"), "text"))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)

    def counter(term: str) -> Column:
        return F.size(F.filter("toks", lambda t: t == term))

    # The token array is used many times, so it is computed once, behind the generator.
    once = docs.select("id", F.explode(F.array(toks)).alias("toks"))
    tf = once.select("id", F.size("toks").alias("dl"), *[counter(t).alias(f"tf{i}") for i, t in enumerate(terms)]).repartition("id")
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        f, df = F.col(f"tf{i}").cast("double"), F.col(f"df{i}").cast("double")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + F.when(f > 0, part * wanted[t]).otherwise(0.0)
    # One row of statistics: the cross join is with a single row.
    scored = tf.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return ranked(scored.filter("score > 0"), limit)


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds the 1-based rank by score descending, id ascending. With a limit the top rows are taken first, so the
    window that numbers them sees no more than that."""
    if limit is not None:
        scored = scored.orderBy(F.desc("score"), "id").limit(limit)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def symbol_rank(chunks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """2 where the first symbol representation equals the query, 1 where it contains it, ignoring case; others drop."""
    first = F.element_at(F.filter("representations", lambda r: r["kind"] == "symbol"), 1)["text"]
    text = F.lower(first)
    score = F.when(text == query.lower(), 2.0).when(F.contains(text, F.lit(query.lower())), 1.0)
    return ranked(chunks.filter(F.length("text") > 0).select("id", score.alias("score")).filter("score is not null"), limit)


def structure_hash(text: Column) -> Column:
    """A text's shape: digits and white space runs normalised, then hashed; equal shapes are similar with score 1."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "0"), r"\s+", " ").cast("binary"), 256)


def ast_shape(text: str | None) -> str | None:
    """The shape of Python source: its syntax tree without positions, comments and literal values, with names, operators
    and the kinds of literals; a chunk that does not parse is tried as the body of a function, then of a class. Null where
    nothing parses. Equal shapes are candidates, not proof of equal behaviour."""

    def encoded(node) -> str:
        if isinstance(node, ast.Constant):
            return f"Constant<{type(node.value).__name__}>"
        if isinstance(node, ast.AST):
            return f"{type(node).__name__}({','.join(encoded(v) for k, v in ast.iter_fields(node) if k not in ('type_comment', 'type_ignores', 'kind'))})"
        return f"[{','.join(map(encoded, node))}]" if isinstance(node, list) else repr(node)

    body = textwrap.dedent(text or "")
    inside = textwrap.indent(body, " ")
    for source in (body, f"def _():\n{inside}", f"class _:\n{inside}"):
        try:
            return hashlib.sha256(encoded(ast.parse(source)).encode()).hexdigest()
        except (SyntaxError, ValueError, RecursionError):
            continue
    return None


def ast_groups(chunks: DataFrame) -> DataFrame:
    """(shape, n, first_id): syntax shapes that two or more chunks (id, text) of Python source share."""

    @F.pandas_udf("string")
    def shape(texts):
        return texts.map(ast_shape)

    shapes = importable(chunks).select("id", shape("text").alias("shape")).filter("shape is not null")
    return shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def structural_groups(chunks: DataFrame) -> DataFrame:
    """(shape, n, first_id): shapes that two or more chunks share."""
    return chunks.select("id", structure_hash(F.col("text")).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, given as a float; null for empty, mismatched, non-finite or zero vectors."""
    zero = F.lit(0.0)
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(d(v), zero, lambda s, x: s + x * x))
    finite = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & finite(a) & finite(b) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, (dot / (norm(a) * norm(b))).cast("float"))


def cosine_top(vectors: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """(id, score, rank) of the vectors closest to the query; the query travels as a literal."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit out of bounds")
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    scored = vectors.select("id", cosine(F.col("vector"), q).cast("double").alias("score")).filter("score is not null")
    return ranked(scored, limit)


def record_rank(records: DataFrame, query: list[float], view_id: str, profile: str, distance: str = "cosine", limit: int = 20) -> DataFrame:
    """cosine_top over the ready records (id, view_id, profile, dimension, distance, completeness, vector) of a view and
    profile; a ready record of another dimension or distance than the query's raises when the plan runs."""
    mine = records.filter((F.col("view_id") == view_id) & (F.col("profile") == profile) & (F.col("completeness") == "ready"))
    fits = (F.col("dimension") == len(query)) & (F.size("vector") == F.col("dimension")) & (F.col("distance") == distance)
    checked = mine.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("record does not fit the query: "), "id")).cast("boolean")))
    return cosine_top(checked, query, limit)


def fuse(channels: dict[str, DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) channels: one contribution per id and channel, the best; provenance kept."""
    parts = [c.select("id", F.lit(name).alias("channel"), "rank") for name, c in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    best = union.groupBy("id", "channel").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("provenance")
    )
    return ranked(fused, limit)


def rerank(found: DataFrame, scorer: DataFrame, cut: int = RERANK_CUT) -> DataFrame:
    """The first `cut` rows of (id, score, rank) in the order of scorer's (id, score): every candidate must have exactly
    one finite score, or the plan raises."""
    top = found.filter(F.col("rank") <= cut).select("id", F.col("rank").alias("before"))
    given = scorer.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("score").alias("new"))
    joined = top.join(given, "id", "left")
    good = (F.col("n") == 1) & F.col("new").isNotNull() & ~F.isnan("new") & (F.abs("new") != float("inf"))
    checked = F.when(good, F.col("new")).otherwise(F.raise_error(F.lit("a candidate has no single finite score")).cast("double"))
    return ranked(joined.select("id", "before", checked.alias("score")))


def validated_rerank(found: DataFrame, scorer: DataFrame) -> DataFrame:
    """Problems of a score set: candidates without a score, scores without a candidate, repeated scores."""
    counts = scorer.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = found.select("id", F.lit(1).alias("c")).join(counts, "id", "full")
    problem = F.when(F.col("c").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("id", problem.alias("problem")).filter("problem is not null")
