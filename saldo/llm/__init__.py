"""Operators for preparing training text at corpus scale, each a Spark job of its own."""
