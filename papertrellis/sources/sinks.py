"""Writes: JSON lines, CSV with a fixed column order, and the provenance side table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from papertrellis.operators.priors import provenance_report

SCORE_COLUMNS = ("research_paper_id", "paper_authority_score", "citation_influence_score", "author_authority_score")


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; ``compression`` is a codec such as gzip, which readers tell by the files' names."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path, compression=compression)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = SCORE_COLUMNS) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_provenance(factors: DataFrame, path: str) -> None:
    """Authority status and prior, beside the score rows because those have no status column."""
    write_json(provenance_report(factors), path)
