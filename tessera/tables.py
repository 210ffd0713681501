"""Declared schemas, and adapters that show the driver's tables as a corpus of files, chunks, graph and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "struct<start:bigint,end:bigint>"
SYMBOL = "struct<name:string,kind:string,start:bigint,end:bigint>"
FILE = (
    "id string, path string, content string, project_ids array<string>, repository_id string, snapshot_id string,"
    f" language string, test boolean, generated boolean, symbols array<{SYMBOL}>"
)
REPRESENTATION = "struct<kind:string,text:string>"
CHUNK = (
    "id string, file_id string, repository_id string, project_ids array<string>, start bigint, end bigint, text string,"
    f" header string, parent_id string, kind string, split boolean, fallback boolean, representations array<{REPRESENTATION}>"
)
NODE = "id string, kind string, name string, file_id string, repository_id string, project_ids array<string>"
EDGE = "id string, kind string, source_id string, target_id string, resolution string, project_ids array<string>"
EMBEDDING = "id string, view_id string, profile string, dimension int, distance string, completeness string, vector array<float>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files: projects are the source and the language."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"),
        F.col("text").alias("content"),
        F.array("source", "lang").alias("project_ids"),
        F.col("source").alias("repository_id"),
        F.lit("s0").alias("snapshot_id"),
        F.col("lang").alias("language"),
        F.lit(False).alias("test"),
        F.contains(F.col("text"), F.lit("Code generated")).alias("generated"),
        F.array().cast(f"array<{SYMBOL}>").alias("symbols"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one chunk each, with code, symbol and context representations."""
    d = table(spark, sf_dir, "documents")
    header = F.concat(F.lit("language="), "lang", F.lit("; path="), "source", F.lit("/"), "doc_id", F.lit("; kind=file"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.col("source").alias("repository_id"),
        F.array("source", "lang").alias("project_ids"),
        F.lit(0).cast("bigint").alias("start"),
        F.octet_length("text").cast("bigint").alias("end"),
        F.col("text"),
        header.alias("header"),
        F.lit("").alias("parent_id"),
        F.lit("file_fallback").alias("kind"),
        F.lit(False).alias("split"),
        F.lit(False).alias("fallback"),
        F.array(
            F.struct(F.lit("code").alias("kind"), F.col("text").alias("text")),
            F.struct(F.lit("symbol").alias("kind"), F.concat(F.lit("symbol: doc"), "doc_id", F.lit("\n"), header).alias("text")),
            F.struct(F.lit("context").alias("kind"), header.alias("text")),
        ).alias("representations"),
    )


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a textless parent chunk per conversation and a child per turn."""
    c = table(spark, sf_dir, "conversations")
    conv = F.concat(F.lit("c"), "conv_id")
    shared = [F.array(F.lit("p")).alias("project_ids")]
    child = c.select(
        F.concat(conv, F.lit("-"), "turn").alias("id"), conv.alias("file_id"), F.lit("r").alias("repository_id"), *shared,
        (F.col("turn") * 100000).alias("start"), (F.col("turn") * 100000 + F.octet_length("text")).alias("end"),
        F.col("text"), F.concat(F.lit("role="), "role").alias("header"), conv.alias("parent_id"), F.lit("statement").alias("kind"),
    )
    parent = c.select(
        conv.alias("id"), conv.alias("file_id"), F.lit("r").alias("repository_id"), *shared, F.lit(0).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"), F.lit("conversation").alias("header"), F.lit("").alias("parent_id"), F.lit("type").alias("kind"),
    ).distinct()
    return parent.unionByName(child)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: regions contain nations, nations contain customers and suppliers, customers declare orders,
    orders refer to parts and suppliers."""
    t = lambda n: table(spark, sf_dir, n)

    def node(df, prefix, key, kind, name, project):
        return df.select(
            F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"),
            F.lit(prefix).alias("file_id"), F.lit("r").alias("repository_id"), F.array(F.lit("all"), project).alias("project_ids"),
        )

    nodes = [
        node(t("region"), "r", "r_regionkey", "package", "r_name", F.lit("geo")),
        node(t("nation"), "n", "n_nationkey", "package", "n_name", F.lit("geo")),
        node(t("customer"), "c", "c_custkey", "symbol", "c_name", F.lit("sales")),
        node(t("supplier"), "s", "s_suppkey", "symbol", "s_name", F.lit("supply")),
        node(t("part"), "p", "p_partkey", "type", "p_name", F.lit("supply")),
        node(t("orders"), "o", "o_orderkey", "call_site", "o_orderpriority", F.lit("sales")),
    ]

    def edge(df, kind, sp, s, tp, d, resolution="exact"):
        ends = df.select(F.concat(F.lit(f"{sp}:"), F.col(s)).alias("source_id"), F.concat(F.lit(f"{tp}:"), F.col(d)).alias("target_id")).distinct()
        return ends.select(
            F.concat_ws("|", F.lit(kind), "source_id", "target_id").alias("id"), F.lit(kind).alias("kind"), "source_id", "target_id",
            F.lit(resolution).alias("resolution"), F.array(F.lit("all")).alias("project_ids"),
        )

    edges = [
        edge(t("nation"), "contains", "r", "n_regionkey", "n", "n_nationkey"),
        edge(t("customer"), "contains", "n", "c_nationkey", "c", "c_custkey"),
        edge(t("supplier"), "contains", "n", "s_nationkey", "s", "s_suppkey"),
        edge(t("orders"), "contains", "c", "o_custkey", "o", "o_orderkey"),
        edge(t("lineitem"), "references", "o", "l_orderkey", "p", "l_partkey"),
        edge(t("lineitem"), "calls", "o", "l_orderkey", "s", "l_suppkey", "candidate"),
    ]
    return _union(nodes), _union(edges)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
