"""Registered queries of the document-intelligence operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as registered


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with e-mail addresses and phone numbers blacked out, summed up by source."""
    return registered.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in registered.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registered.REGISTERED.items() if sql}
