"""The retrieval dispatcher: lexical, symbol, structural, semantic and hybrid modes over scoped chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rank

MODES = ("lexical", "symbol", "structural", "semantic", "hybrid")


def retrieve(
    chunks: DataFrame, query: str, mode: str = "lexical", limit: int = 20, projects=None, repositories=None,
    vectors: DataFrame | None = None, query_vector: list[float] | None = None, scorer: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """(id, score, rank[, provenance]) of the best chunks, and diagnostics. Hybrid fuses the first hundred lexical, all
    symbol and the first hundred semantic results, and goes on without the semantic ones where there is no vector."""
    if mode not in MODES or not 1 <= limit <= 100 or not query or len(query.encode()) > 8192:
        raise ValueError("mode, limit or query out of bounds")
    scoped, notes = rank.scoped(chunks, projects, repositories), []
    semantic = None
    if vectors is not None and query_vector:  # the scope comes before the cut: the best of the scoped chunks
        semantic = rank.cosine_top(vectors.join(scoped.select("id"), "id", "left_semi"), query_vector, rank.CHANNEL_CUT)
    if mode == "lexical":
        found = rank.bm25(scoped, query, limit=rank.CHANNEL_CUT)
    elif mode == "symbol":
        found = rank.symbol_rank(scoped, query, rank.CHANNEL_CUT)
    elif mode == "structural":
        same = scoped.filter(rank.structure_hash(F.col("text")) == rank.structure_hash(F.lit(query)))
        found = rank.ranked(same.select("id", F.lit(1.0).alias("score")), rank.CHANNEL_CUT)
    elif mode == "semantic":
        if semantic is None:
            raise ValueError("semantic retrieval needs vectors")
        found = semantic
    else:
        channels = {"lexical": rank.bm25(scoped, query, limit=rank.CHANNEL_CUT), "symbol": rank.symbol_rank(scoped, query)}
        if semantic is None:
            notes.append("semantic channel unavailable")
        else:
            channels["semantic"] = semantic
        found = rank.fuse(channels, limit=rank.CHANNEL_CUT)
    if scorer is not None:
        found = rank.rerank(found, scorer)
    return found.filter(F.col("rank") <= limit), notes


def answer(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` rows of ranked candidates (at most CHANNEL_CUT of them) with candidate_count, how many there were
    before any cut or reranking, and truncated, whether that is more than the limit."""
    n = F.count(F.lit(1)).over(Window.partitionBy())  # over the candidates alone
    counted = found.filter(F.col("rank") <= rank.CHANNEL_CUT).withColumn("candidate_count", n)
    return counted.filter(F.col("rank") <= limit).withColumn("truncated", F.col("candidate_count") > limit)
