"""Ingest: a repository's snapshot becomes the next view's files, blobs and memberships, what is unchanged reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, policy, projects

MAX_FILES, MAX_BYTES = 10_000, 16 << 20
#: How far each projection of a published view is made.
PROJECTIONS = {
    "source_text": "ready", "symbols": "partial", "types": "partial", "compiler": "partial", "references": "partial", "calls": "partial", "reads_writes": "partial", "retrieval_chunks": "ready",
    "lexical": "ready", "structural_fingerprint": "partial", "configuration_graph": "unsupported", "git_diff": "unsupported", "cfg": "unsupported", "dataflow": "unsupported", "vectors": "not_requested",
}


def projection_status(views: DataFrame) -> DataFrame:
    """(view_id, projection, status) of published views (view_id)."""
    return views.select("view_id", F.explode(F.create_map(*[F.lit(x) for kv in PROJECTIONS.items() for x in kv])).alias("projection", "status"))


def checked(snapshot: DataFrame, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """snapshot if none of its files must be refused and it is within its budgets (None: none); else the plan raises."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    one = snapshot.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"))
    one = one.crossJoin(policy.revalidated(snapshot).agg(F.count(F.lit(1)).alias("bad")))
    large = (F.col("n") > (max_files if max_files is not None else 2**62)) | (F.col("b") > (max_bytes if max_bytes is not None else 2**62))
    reason = F.when(F.col("bad") > 0, "invalid snapshot").when(large, "scope too large")
    ok = one.select(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")).alias("__ok"))
    return snapshot.crossJoin(F.broadcast(ok)).filter("__ok").drop("__ok")


def ingest(previous: DataFrame, snapshot: DataFrame, repository: str, snapshot_id: str, roots: list[tuple], known_blobs: DataFrame, **budget) -> dict[str, DataFrame]:
    """The tables of the next view: files (previous ones of other repositories as they are, and the snapshot's, each with
    its members under the project roots), blobs (those not known yet), manifest (the repository's shards).

    previous: id, repository_id, path, blob_id, size, language, snapshot_id; snapshot: path, content, size, language,
    blob_id (the content's digest); known_blobs: blob_id. Digests and memberships are expressions where a file is read;
    only references are joined, never content.
    """
    good = checked(snapshot, **budget)
    new = good.select(
        chunking.digest_id(F.lit(snapshot_id), F.col("path")).alias("id"), F.lit(repository).alias("repository_id"), "path", "blob_id", F.col("size").cast("bigint").alias("size"), "language", F.lit(snapshot_id).alias("snapshot_id"),
    )
    kept = previous.filter(F.col("repository_id") != repository).select(*new.columns)
    files = projects.membership(kept.withColumn("carried", F.lit(True)).unionByName(new.withColumn("carried", F.lit(False))), roots)
    blobs = good.select("blob_id", "content").join(known_blobs.select("blob_id"), "blob_id", "left_anti").groupBy("blob_id").agg(F.first("content").alias("content"))
    return {"files": files, "blobs": blobs, "manifest": projects.manifest_shards(good)}
