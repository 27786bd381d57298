"""Spark-native reconciliation and profitability analytics."""
