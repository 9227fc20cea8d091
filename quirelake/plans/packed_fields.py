"""Queries of the packed-field operator (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.operators.packed import split_packed
from quirelake.session import table


def names_of_records(spark: SparkSession, d: str) -> DataFrame:
    """record_id, pos, author and flags, one row per name; repeated rows of a record count once."""
    records = table(spark, d, "paper_records").select("record_id", "authors").where("authors IS NOT NULL").distinct()
    return split_packed(records, "authors", ["record_id"], "author")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names_of_records(spark, d).select("record_id", "pos", "author")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many values and records carry each error flag."""
    return names_of_records(spark, d).groupBy("flags").agg(F.count("*").alias("n_values"), F.countDistinct("record_id").alias("n_records"))


QUERIES = {f.__name__: f for f in (p5_found, p5_flags)}
