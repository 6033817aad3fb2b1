"""Clickstream analytics written as Spark DataFrame operators."""
