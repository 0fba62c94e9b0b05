"""Landed works in compressed files."""

import os

from pyspark.sql import functions as F

from papertrellis.sources import sinks, tables


def size(path):
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(path) for f in files)


def test_landed_works_are_read_from_compressed_files(spark, tmp_path):
    path = str(tmp_path / "works")
    works = spark.range(2000).select(F.concat(F.lit("https://openalex.org/W"), "id").alias("id"), F.col("id").alias("work_seq"))
    sinks.write_json(works, path, "gzip")
    assert size(path) < 60_000 and any(f.endswith(".json.gz") for f in os.listdir(path))
    assert tables.works_table(spark, path).where("_corrupt_record is null").agg(F.count("*"), F.sum("work_seq")).first() == (2000, 1999000)
