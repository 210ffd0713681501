"""Embedding records: identity, validation, compute-or-reuse, resumable pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE = 16


def profile_fingerprint(*fields: Column) -> Column:
    joined = fields[0].cast("string")
    for f in fields[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), f.cast("string"))
    return F.sha2(joined.cast("binary"), 256)


def record_id(workspace: Column, view: Column, item: Column, profile: Column, text: Column) -> Column:
    return profile_fingerprint(workspace, view, item, profile, F.sha2(text.cast("binary"), 256))


def missing(inputs: DataFrame, records: DataFrame) -> DataFrame:
    """Inputs (id, …) that have no record yet."""
    return inputs.join(records.select("id"), "id", "left_anti")


def compute(inputs: DataFrame, records: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All records: the ones there are, and embed's for the inputs without one."""
    return records.unionByName(embed(missing(inputs, records)))


def save(there: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to append, ids that would change a record): equal records may be saved again, others conflict."""
    same = there.select("id", F.xxhash64("vector").alias("old"))
    joined = new.join(same, "id", "left")
    return joined.filter("old is null").drop("old"), joined.filter(F.col("old") != F.xxhash64("vector")).select("id")


def scan(records: DataFrame, workspace: str, view: str, profile: str, limit: int = 1000) -> DataFrame:
    """The records of a workspace, view and profile in order of id; more than the limit raise when the plan runs, since a
    part would pass for the whole."""
    mine = records.filter((F.col("workspace_id") == workspace) & (F.col("view_id") == view) & (F.col("profile") == profile))
    top = mine.orderBy("id").limit(limit + 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    return top.filter(F.when(F.col("__n") <= limit, F.lit(True)).otherwise(F.raise_error(F.lit("more records than the limit")).cast("boolean"))).drop("__n")


def find(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of wanted items (workspace, view, item, profile, text), by the identity derived from these."""
    ids = wanted.select(record_id(*[F.col(c) for c in ("workspace", "view", "item", "profile", "text")]).alias("id")).distinct()
    return records.join(ids, "id", "left_semi")


def profile_problems(profiles: DataFrame, most: int = 64) -> DataFrame:
    """(id, problem) of embedding profiles (id, model, dimension, distance): identity, repeats, model, dimension, distance;
    and, under the id *, more profiles than there may be."""
    own = (
        F.when(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), F.lit(False)), "identity").when(F.trim(F.coalesce("model", F.lit(""))) == "", "model")
        .when(~F.coalesce(F.col("dimension").between(1, 65536), F.lit(False)), "dimension").when(~F.coalesce(F.col("distance").isin("cosine", "euclidean", "dot"), F.lit(False)), "distance")
    )
    first = profiles.select("id", own.alias("problem")).filter("problem is not null")
    twice = profiles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated").alias("problem"))
    many = profiles.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.lit("*").alias("id"), F.lit("too many").alias("problem"))
    return first.unionByName(twice).unionByName(many)


def complete(inputs: DataFrame, offset: int, limit: int = PAGE) -> DataFrame:
    """One row about a page: rows on it, next_offset, and whether it is the last."""
    return inputs.agg(F.count(F.lit(1)).alias("n")).select(
        F.greatest(F.lit(0), F.least(F.col("n") - offset, F.lit(limit))).alias("rows"), F.least(F.col("n"), F.lit(offset + limit)).alias("next_offset"), (F.col("n") <= offset + limit).alias("complete")
    )


def page(inputs: DataFrame, offset: int, limit: int = PAGE) -> tuple[DataFrame, int]:
    """(the inputs of one page in order of id, the next offset); a page holds at most sixteen."""
    if not 1 <= limit <= PAGE or offset < 0:
        raise ValueError("page out of bounds")
    return inputs.orderBy("id").offset(offset).limit(limit), offset + limit


def problems(records: DataFrame, dimension: int) -> DataFrame:
    """(id, problem): wrong dimension, values that aren't finite, zero vectors."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(F.size("vector") != dimension, "dimension").when(~finite, "not finite").when(~F.exists("vector", lambda x: x != 0), "zero")
    return records.select("id", problem.alias("problem")).filter("problem is not null")
