"""Registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saldo.plans import certification, closing, declared, intake, ledger, onboarding, readmodels, streams
from saldo.plans.registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "certification", "closing", "declared", "intake", "ledger", "onboarding", "readmodels", "streams", "statement_by_store_month"]


def statement_by_store_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profit-and-loss statement of every store and month."""
    return ledger.statement_by_store_month(Tables(spark, sf_dir))
