"""Readers and writers of the files that editors exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and nulls as nothing, in parts."""
    text = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
    text.write.option("header", True).option("emptyValue", "").csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """Each row as a line of CSV, nulls as nothing; a table's first line starts with a byte
    order mark when ``header_line`` is put before them."""
    cells = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
    return rows.select(F.to_csv(cells, {"emptyValue": ""}).alias("line"))


def header_line(rows: DataFrame) -> str:
    return "﻿" + ",".join(rows.columns)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Insert rows into the table of Parquet files at ``path``, beside what is there."""
    rows.write.mode("append").parquet(path)


def with_missing_columns(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Rows of an old and a new schema together, columns that the old one lacks filled in."""
    return old.unionByName(new, allowMissingColumns=True).na.fill(defaults)
