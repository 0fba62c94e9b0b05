"""The stages of corpus_pipeline over awkward documents: what each keeps, and the whole against its parts."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papertrellis.llm import decontam, langid, mixing

from .test_corpus import BENCH, COLUMNS, corpus
from .test_jaccard import plain_keep


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([b for b in BENCH if b[0] != 10], "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return path


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_takes_any_table(spark, folder, name, stage):
    docs = read(spark, folder)
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "row", "count", "component_id", "score", "h", "copies", "part", "hits", "lang_pred")])
    for table in (wide, docs.where("doc_id < 0"), docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")):
        out = stage(spark, table, folder)
        if stage is not corpus_pipeline.token_output:
            assert out.columns == table.columns
        out.count()


def test_language_stage_keeps_texts_with_letters(spark, folder):
    docs = read(spark, folder)
    kept = corpus_pipeline.language_id(spark, docs, folder)
    marked = langid.identify(docs, langid.learn(docs))
    assert kept.count() == marked.where("lang_pred <> 'und' and score >= 0.5").count()
    assert kept.where("text is null or trim(text) = ''").count() == 0


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    docs = read(spark, folder)
    kept = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    want = plain_keep([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((r["doc_id"] for r in kept), key=lambda i: (i is not None, i or 0)) == want


def test_decontamination_keeps_own_columns(spark, folder):
    docs = read(spark, folder).withColumn("n_words", F.lit(8)).withColumn("hits", F.lit("own")).withColumn("contaminated", F.col("doc_id"))
    kept = corpus_pipeline.decontaminate(spark, docs, folder)
    assert kept.dtypes == docs.dtypes
    plain = decontam.scan(read(spark, folder), decontam.load(spark.read.parquet(f"{folder}/benchmark.parquet")), unnamed=True).collect()
    left = sorted(((r["doc_id"], r["text"]) for r in plain if not r["contaminated"]), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == left and 0 < len(left) < docs.count()
    assert kept.where("n_words <> 8 or hits <> 'own' or contaminated is distinct from doc_id").count() == 0


def test_run_is_the_stages_in_turn(spark, folder):
    docs = read(spark, folder)
    docs = corpus_pipeline.language_id(spark, docs, folder)
    docs = corpus_pipeline.near_dedup(spark, docs, folder)
    docs = decontam.clean_documents(docs, decontam.load(spark.read.parquet(f"{folder}/benchmark.parquet")))
    taken = mixing.mix(docs).collect()
    out = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted((r["id"] is not None, r["id"] or 0) for r in taken for _ in range(r["copies"]))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in out] == want
    ends = [r["start"] + r["n_tokens"] for r in out]
    assert [r["start"] for r in out] == [0, *ends[:-1]]
