"""Scholarly curation, scoring, retrieval and ranking as Spark DataFrame operators."""
