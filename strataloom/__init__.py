"""Strataloom: evidence analytics and data processing as composable Spark DataFrame operators."""
