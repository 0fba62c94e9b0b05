"""What a kept stage takes on disk."""

import os

from pyspark.sql import functions as F

from papertrellis import session


def size(path):
    return sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(path) for f in files)


def test_a_kept_stage_is_compressed_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rows = spark.range(50_000).select(
        "id", F.concat(F.lit("https://openalex.org/W"), "id").alias("name"), F.array(F.struct(F.col("id").alias("x"), F.lit("education").alias("k"))).alias("l"))
    kept = session.cut_lineage(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    assert kept.exceptAll(rows).count() == 0 and kept.count() == 50_000
    assert kept.inputFiles() and size(tmp_path) < 800_000  # a checkpoint takes over 100 bytes a row
