"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .common import prepare, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    @wraps(f)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = prepared
    return prepared


@query
def op1_secrets(spark, sf_dir):
    from .secretscan import secrets

    return secrets(read_table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark, sf_dir):
    from .compression import toxicity

    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_katz(spark, sf_dir):
    from .katz import scored

    return scored(read_table(spark, sf_dir, "documents"))


@query
def op4_quality(spark, sf_dir):
    from .boosting import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op5_fingerprints(spark, sf_dir):
    from .iblt import fingerprints

    return fingerprints(read_table(spark, sf_dir, "documents"))


@query
def op6_token_files(spark, sf_dir):
    from .rans import encoded

    return encoded(read_table(spark, sf_dir, "documents"))


@query
def op7_edit_counts(spark, sf_dir):
    from .editcount import edit_counts, standard_edits

    return edit_counts(read_table(spark, sf_dir, "documents").withColumn("edits", standard_edits()))


@query
def op8_decontamination(spark, sf_dir):
    from .positional import contaminated_words

    return contaminated_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op9_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op10_packing(spark, sf_dir):
    from .packing import packed

    return packed(read_table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
