"""The bounded sample of labelled rows that the classifiers are fitted on: whole texts, bounded in number only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket

#: Labelled rows of each class that a classifier is fitted on, at most.
MAX_ROWS = 1500


def training_sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, max_rows: int = MAX_ROWS) -> tuple[DataFrame, dict[int, int], float | None]:
    """(doc_id, text) of up to max_rows labelled documents of each class, none of them with crc32(id) mod divisor equal to
    held_out; 0 or 1 for each of their ids; the share of label 1 among all rows that may be learnt from (None without
    both). Chosen by a hash of the id, so the sample does not depend on the order of rows; a label counts only if a
    document has its id, and of documents that share an id one is used, the one whose text is first."""
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket(F.col("doc_id"), divisor) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    of: dict[int, int] = {}
    count = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    for y in count:
        of |= {r[0]: y for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id").collect()}
    share = count[1] / (count[0] + count[1]) if len(count) == 2 else None
    texts = docs.filter(F.col("doc_id").isin(list(of)) if of else F.lit(False)).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return texts, of, share
