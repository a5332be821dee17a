"""Queries on loading raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.session import table
from rankloom.sources.records import loaded, parse_records, skipped


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-blank record of dataset_rows that fails, with its first reason."""
    return skipped(parse_records(table(spark, folder, "dataset_rows"), table(spark, folder, "dataset_uploads")))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Every valid record of dataset_rows with its fields."""
    return loaded(parse_records(table(spark, folder, "dataset_rows"), table(spark, folder, "dataset_uploads")))


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected records by format and reason."""
    rows, uploads = table(spark, folder, "dataset_rows"), table(spark, folder, "dataset_uploads")
    bad = skipped(parse_records(rows, uploads)).join(rows.select("row_id", "upload_id").distinct(), "row_id")
    return bad.join(uploads.select("upload_id", "fmt"), "upload_id", "left").groupBy("fmt", "reason").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p2_reasons": p2_reasons}
SQL: dict[str, str] = {}
