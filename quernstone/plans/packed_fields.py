"""Queries of problem 2 over questions.tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.packed import split_packed
from quernstone.session import spread, table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(spread(table(spark, sf_dir, "questions").select("id", "tags")), "id", "tags")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of questions.tags with its position."""
    return _values(spark, sf_dir).select("question_id", "pos", "tag")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the grammar's alternative and the error flag."""
    return _values(spark, sf_dir)


def p2_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions carry each tag, and how often it was written malformed."""
    return (
        _values(spark, sf_dir)
        .groupBy("tag")
        .agg(
            F.count("*").alias("n_values"),
            F.countDistinct("question_id").alias("n_questions"),
            F.count_if("malformed").alias("n_malformed"),
        )
    )


QUERIES = {"p2_found": p2_found, "p2_values": p2_values, "p2_tag_counts": p2_tag_counts}
SQL: dict[str, str] = {}
