"""Corpus linguistics, semantic spaces and text analytics as Spark DataFrame operators."""
