"""Reads: landed files and bounded or keyed reads of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrellis.functions.text import identifier
from papertrellis.schemas import READABLE, SCHEMAS, WORKS
from papertrellis.session import broadcast_if_small


def json_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files that each hold a JSON array of objects; malformed content fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def works_table(spark: SparkSession, path: str) -> DataFrame:
    """Landed works as JSON lines; unreadable lines are kept in ``_corrupt_record``."""
    return spark.read.schema(WORKS + ", _corrupt_record STRING").option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path)


def pages_scan(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def bounded_scan(df: DataFrame, row_limit: int) -> DataFrame:
    """The first ``row_limit`` distinct ids in id order, one row each; ``truncated`` says the bound was reached.

    Only the ids are compared over the whole table; of rows with one id the smallest by all columns stands for it.
    """
    ids = df.select("id").where("id IS NOT NULL").distinct().orderBy("id").limit(row_limit)
    reached = ids.agg((F.count(F.lit(1)) >= row_limit).alias("truncated"))
    one = df.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct(*df.columns)).alias("_row"))
    return one.select("_row.*").join(F.broadcast(reached), F.lit(True)).orderBy("id")


def first_page(df: DataFrame, limit: int) -> DataFrame:
    """The first rows in id order; a limit of zero or less is empty."""
    return df.orderBy("id").limit(max(0, limit))


def rows_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids (column ``id``), in id order; unknown ids are ignored."""
    wanted = ids.select(identifier(F.col("id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    return df.join(broadcast_if_small(wanted), "id", "left_semi").orderBy("id")


def rows_overlapping(df: DataFrame, column: str, values: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose array column shares a value with ``values`` (column ``value``), in id order."""
    hits = (
        df.select("id", F.explode(column).alias("value"))
        .join(broadcast_if_small(values.select("value").distinct()), "value", "left_semi")
        .select("id").distinct()
    )
    out = df.join(hits, "id", "left_semi").orderBy("id")
    return out if limit is None else out.limit(limit)


def eq_filter_read(df: DataFrame, columns: list[str], filters: dict[str, object]) -> DataFrame:
    """Columns of the rows that equal every given value; both reach the file scan."""
    conditions = [F.col(name) == F.lit(value) for name, value in filters.items()]
    kept = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    return kept.select(*columns)


def table_readiness(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per readable table: present, columns missing, has a row. No table stops the report."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, columns in READABLE.items():
        df = tables.get(name)
        missing = list(columns) if df is None else [c for c in columns if c not in df.columns]
        label = spark.range(1).select(
            F.lit(name).alias("table_name"), F.lit(df is not None).alias("present"), F.lit("|".join(missing)).alias("missing")
        )
        some = spark.range(0).agg(F.count(F.lit(1)).alias("n")) if df is None else df.limit(1).agg(F.count(F.lit(1)).alias("n"))
        row = label.join(F.broadcast(some), F.lit(True)).select(
            "table_name", "present", "missing", (F.col("n") > 0).alias("has_rows"),
            (F.col("present") & (F.col("missing") == "")).alias("ready"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def read_schema(table: str):
    """Explicit read schema of a stored table."""
    if table not in SCHEMAS:
        raise ValueError(f"unknown table {table!r}")
    return SCHEMAS[table]
