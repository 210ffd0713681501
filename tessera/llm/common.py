"""What the operators share: work tables in the shared folder, bounded batches, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case ASCII, for lower-casing A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows of one Arrow batch: whole texts pass through Python, so batches are kept short.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and executors are threads of this
    very process (master local, as in tests) a folder of our own; elsewhere it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir().rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches, and a package path that Python workers can import from."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors,
    and fixes what is not deterministic (row ids, task order), since only committed task output is read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str, codec: str = "zstd") -> DataFrame:
    """As saved, in n buckets by key: what groups or joins by key reads it in place. The table's name is given up at once,
    its files stay."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    table = f"spark_catalog.default.tessera_{name}"
    df.write.format("parquet").bucketBy(n, key).option("compression", codec).option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def row_keys() -> list[Column]:
    """k1, k2: 128 bits that tell rows apart by doc_id and text. Only rows that repeat both share them, so a repeated or
    null doc_id is no hot key."""
    parts = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    return [F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("k2")]


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows whose keys (k1, k2) are in lost; whatever the columns of docs are called. Spark broadcasts lost
    where it finds it small enough, else, or where it comes with a hint, texts are shuffled once."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), *row_keys())
    return packed.join(lost, ["k1", "k2"], "left_anti").select("r.*")
