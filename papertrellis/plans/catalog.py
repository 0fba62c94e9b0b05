"""The fixed catalogue of listing and lookup queries.

A relation held as an array of ids is a predicate: a repeated id gives one row.
It is joined by exploding the distinct ids, so the join is an equi-join; names
are filtered first, which keeps the matching side small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def by_name(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("name"))


def newest_first(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc_nulls_first("publication_date"))


def like(c: Column | str, pattern: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.ilike(pattern)


def any_like(array: str, pattern: str) -> Column:
    return F.coalesce(F.exists(F.col(array), lambda x: F.coalesce(x.ilike(pattern), F.lit(False))), F.lit(False))


def related(left: DataFrame, array: str, right: DataFrame, pattern: str) -> DataFrame:
    """Rows of ``left`` once per row of ``right`` whose name is like the pattern and whose id the array holds."""
    wanted = right.where(like("name", pattern)).select(F.col("id").alias("_rid"))
    keys = left.select(F.col("id").alias("_lid"), F.explode(F.array_distinct(array)).alias("_rid"))
    return left.join(keys.join(wanted, "_rid"), F.col("id") == F.col("_lid")).drop("_lid", "_rid")


def academics_by_keyword(academics: DataFrame, fields: DataFrame, name: str, field: str) -> DataFrame:
    """Name like one pattern, or any field name like the other."""
    wanted = fields.where(like("name", field)).select(F.col("id").alias("_fid"))
    hits = (
        academics.select("id", F.explode("field_ids").alias("_fid"))
        .join(wanted, "_fid", "left_semi").select(F.col("id").alias("_hit")).distinct()
    )
    return academics.join(hits, F.col("id") == F.col("_hit"), "left").where(
        F.coalesce(like("name", name), F.lit(False)) | F.col("_hit").isNotNull()
    ).drop("_hit")


def papers_by_title_or_keyword(papers: DataFrame, title: str, keyword: str) -> DataFrame:
    return papers.where(F.coalesce(like("name", title), F.lit(False)) | any_like("keywords", keyword))


def papers_by_author(papers: DataFrame, academics: DataFrame, name: str) -> DataFrame:
    return related(papers, "academic_ids", academics, name)


def authors_of_papers(academics: DataFrame, papers: DataFrame, title: str) -> DataFrame:
    """Academics once per matching paper that lists them."""
    wanted = papers.where(like("name", title)).select(F.explode(F.array_distinct("academic_ids")).alias("_aid"))
    return academics.join(wanted, F.col("id") == F.col("_aid")).drop("_aid")


def papers_in(papers: DataFrame, key: str, table: DataFrame, pattern: str) -> DataFrame:
    """Papers whose foreign key points at a row with a matching name."""
    wanted = table.where(like("name", pattern)).select(F.col("id").alias(key))
    return papers.join(wanted, key)


def papers_with_venue(papers: DataFrame, journals: DataFrame, publishers: DataFrame) -> DataFrame:
    j = journals.select(F.col("id").alias("journal_id"), F.col("name").alias("journal_name"))
    p = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"))
    return (
        papers.join(j, "journal_id", "left").join(p, "publisher_id", "left")
        .select(F.col("name").alias("paper_name"), "publication_date", "doi", "journal_name", "publisher_name")
        .orderBy(F.desc_nulls_first("publication_date"))
    )


def academics_with(academics: DataFrame, array: str, table: DataFrame, label: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per academic and related name, sorted by academic."""
    named = table.select(F.col("id").alias("_rid"), F.col("name").alias(label))
    rows = academics.select(
        F.col("name").alias("academic_name"), *extra, F.explode(F.array_distinct(array)).alias("_rid")
    )
    return rows.join(named, "_rid").drop("_rid").orderBy(F.asc_nulls_last("academic_name"))


def most_cited(papers: DataFrame) -> DataFrame:
    return papers.select("name", "publication_date", "incoming_citation_count").orderBy(
        F.desc_nulls_first("incoming_citation_count")
    )


def open_access(papers: DataFrame) -> DataFrame:
    return papers.where("is_open_access").select("name", "publication_date", "open_access_url")


def topic_search(academics: DataFrame, pattern: str) -> DataFrame:
    """Academics with a matching interest or area of expertise."""
    return (
        academics.where(any_like("research_interests", pattern) | any_like("areas_of_expertise", pattern))
        .select("id", "name", "academic_position", "research_interests", "areas_of_expertise", "profile_url")
        .distinct()
    )
