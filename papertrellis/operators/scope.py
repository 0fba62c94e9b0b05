"""Restrict the corpus to the universities in scope and prune relations to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.functions.relations import attach_row, explode_ids, ordered_distinct
from papertrellis.functions.text import blank_to_null
from papertrellis.operators.normalise import TARGET_SOURCES


def id_from_url(c: Column) -> Column:
    """Last path segment after trailing slashes; null for an empty url."""
    return F.when(
        blank_to_null(c).isNotNull(), F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    )


def target_universities(universities: DataFrame, targets: tuple[str, ...] = TARGET_SOURCES) -> DataFrame:
    return universities.where(id_from_url(F.col("openalex_id")).isin(*targets))


def target_academics(academics: DataFrame, universities: DataFrame) -> DataFrame:
    """Academics with at least one affiliation in ``universities``."""
    wanted = universities.select(F.col("id").alias("_u"))
    hits = academics.select("id", F.explode("university_ids").alias("_u")).join(wanted, "_u", "left_semi")
    return academics.join(hits.select("id").distinct(), "id", "left_semi")


def papers_in_scope(papers: DataFrame, academics: DataFrame) -> DataFrame:
    """Papers with their in-scope academics (order kept, distinct); papers left without any go."""
    wanted = academics.select(F.col("id").alias("_a"))
    kept = explode_ids(papers, "academic_ids", "_a", keep=["id"]).join(wanted, "_a", "left_semi")
    arrays = ordered_distinct(kept, ["id"], "_a", ["pos"], "_academics")
    return papers.join(arrays, "id").withColumn("academic_ids", F.col("_academics")).drop("_academics")


def paper_universities_backfill(papers: DataFrame, academics: DataFrame, universities: DataFrame, seq: str = "seq") -> DataFrame:
    """Direct in-scope universities, then those of the paper's academics in academic-table order."""
    wanted = universities.select(F.col("id").alias("_u"))
    direct = explode_ids(papers, "university_ids", "_u", keep=["id"]).select(
        "id", "_u", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.col("pos").alias("_pos"))
    affil = explode_ids(academics, "university_ids", "_u", keep=["id", seq]).select(
        F.col("id").alias("_a"), F.col(seq).cast("long").alias("_seq"), F.col("pos").alias("_pos"), "_u")
    via = papers.select("id", F.explode("academic_ids").alias("_a")).join(
        affil.join(wanted, "_u", "left_semi"), "_a").select("id", "_u", F.lit(1).alias("_side"), "_seq", "_pos")
    rows = direct.join(wanted, "_u", "left_semi").unionByName(via)
    arrays = ordered_distinct(rows, ["id"], "_u", ["_side", "_seq", "_pos"], "_unis")
    return papers.join(arrays, "id", "left").withColumn(
        "university_ids", F.coalesce("_unis", F.array().cast("array<string>"))).drop("_unis")


def used_academics(academics: DataFrame, papers: DataFrame) -> DataFrame:
    used = papers.select(F.explode("academic_ids").alias("id")).distinct()
    return academics.join(used, "id", "left_semi")


def prune_relations(academics: DataFrame, papers: DataFrame, universities: DataFrame) -> DataFrame:
    """Academics whose university and paper ids are restricted to retained rows, distinct in order."""
    out = academics
    for column, keep in (("university_ids", universities), ("research_paper_ids", papers)):
        wanted = keep.select(F.col("id").alias("_m"))
        rows = explode_ids(academics, column, "_m", keep=["id"]).join(wanted, "_m", "left_semi")
        arrays = ordered_distinct(rows, ["id"], "_m", ["pos"], "_kept")
        out = out.join(arrays, "id", "left").withColumn(
            column, F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")
    return out


def scope_report(universities: DataFrame, academics: DataFrame, papers: DataFrame) -> DataFrame:
    """One row of counts after scoping."""
    row = papers.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.size("academic_ids") == 0).alias("papers_without_academics"),
        F.count_if(F.size("university_ids") == 0).alias("papers_without_universities"),
    )
    row = attach_row(row, universities.agg(F.count(F.lit(1)).alias("universities")))
    return attach_row(row, academics.agg(F.count(F.lit(1)).alias("academics")))


def unplaced_papers(papers: DataFrame, academics: DataFrame) -> DataFrame:
    """Papers without a university beside the academics they list and those academics' universities."""
    rows = papers.where(F.size("university_ids") == 0).select(
        F.col("id").alias("paper_id"), "name", F.explode("academic_ids").alias("_a"))
    people = academics.select(F.col("id").alias("_a"), F.col("name").alias("academic_name"),
                              F.col("university_ids").alias("academic_universities"))
    return rows.join(people, "_a").withColumnRenamed("_a", "academic_id")
