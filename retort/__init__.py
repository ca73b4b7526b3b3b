"""Molecular analytics as Spark DataFrame operators."""
