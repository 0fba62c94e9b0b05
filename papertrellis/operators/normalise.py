"""Nested bibliographic works to relational tables.

Dimension rows are created at first encounter in (work, author, institution)
order and numbered densely in that order. ``work_seq`` is an input column, so
nothing depends on partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from papertrellis.functions.relations import dense_ids, empty_if_null, ordered_distinct
from papertrellis.functions.text import has_text
from papertrellis.session import cut_lineage

# OpenAlex ids of the nine universities in scope.
TARGET_SOURCES = (
    "I165779595", "I129604602", "I31746571", "I114017466", "I99043593", "I56590836", "I82951845", "I165143802",
    "I118347636",
)


def dedupe_works(works: DataFrame) -> DataFrame:
    """First row per work id over all sources, by (source_seq, seq).

    The row_number filter also runs before the shuffle, so copies of one id
    collapse inside each task.
    """
    order = Window.partitionBy("id").orderBy("source_seq", "seq")
    return works.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def cap_per_source(works: DataFrame, sources: DataFrame, cap: int = 100) -> DataFrame:
    """The first ``cap`` works of every source in ``sources`` (column source_seq)."""
    order = Window.partitionBy("source_seq").orderBy("seq")
    kept = works.join(sources.select("source_seq").distinct(), "source_seq", "left_semi")
    return kept.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn")


def work_authors(works: DataFrame) -> DataFrame:
    rows = works.select("work_seq", F.posexplode("authorships").alias("a_pos", "a"))
    orcid, name = F.col("a.author.orcid"), F.col("a.author.display_name")
    return rows.select(
        "work_seq", "a_pos", name.alias("name"), orcid.alias("orcid"),
        F.when(has_text(orcid), orcid).when(has_text(name), name).alias("author_key"),
        F.col("a.institutions").alias("institutions"),
    )


def work_institutions(works: DataFrame) -> DataFrame:
    rows = work_authors(works).select("work_seq", "a_pos", "author_key", F.posexplode("institutions").alias("i_pos", "i"))
    return rows.select(
        "work_seq", "a_pos", "i_pos", "author_key", F.col("i.display_name").alias("name"), F.col("i.id").alias("openalex_id"),
        F.col("i.country_code").alias("country_code"), F.col("i.ror").alias("ror_url"), F.col("i.type").alias("type"),
    )


def universities_dim(works: DataFrame) -> DataFrame:
    attrs = F.struct("openalex_id", "country_code", "ror_url", "type")
    first = work_institutions(works).groupBy("name").agg(F.min(
        F.struct(F.struct("work_seq", "a_pos", "i_pos").alias("at"), attrs.alias("attrs"))).alias("_f"))
    return dense_ids(first.select("name", "_f.attrs.*", "_f.at.*"), ["work_seq", "a_pos", "i_pos"], "id").select(
        "id", "openalex_id", "name", "country_code", "ror_url", "type")


def _topic(works: DataFrame) -> DataFrame:
    return works.select(
        "work_seq", F.col("primary_topic.domain.display_name").alias("domain"),
        F.col("primary_topic.field.display_name").alias("discipline"),
        F.col("primary_topic.subfield.display_name").alias("subfield"),
    )


def _topic_dim(works: DataFrame, name: str, parent: str | None = None) -> DataFrame:
    value = F.struct("work_seq", F.col(parent).alias("parent")) if parent else F.struct("work_seq")
    first = _topic(works).groupBy(F.col(name).alias("name")).agg(F.min(value).alias("_f")).select("name", "_f.*")
    return dense_ids(first, ["work_seq"], "id")


def faculties_dim(works: DataFrame) -> DataFrame:
    """Topic domains; a missing name is a value of its own."""
    return _topic_dim(works, "domain").select("id", "name")


def _with_parent(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    p = parent.select(F.col("id").alias(column), F.col("name").alias("_pn"))
    return child.join(p, F.col("parent").eqNullSafe(F.col("_pn"))).select("id", "name", column)


def disciplines_dim(works: DataFrame) -> DataFrame:
    return _with_parent(_topic_dim(works, "discipline", "domain"), faculties_dim(works), "faculty_id")


def fields_dim(works: DataFrame) -> DataFrame:
    return _with_parent(_topic_dim(works, "subfield", "discipline"), disciplines_dim(works), "discipline_id")


def journals_dim(works: DataFrame) -> DataFrame:
    source = F.col("primary_location.source")
    rows = works.where(has_text(source["issn_l"])).select(
        "work_seq", source["issn_l"].alias("issn"), source["display_name"].alias("name"), source["type"].alias("type"))
    first = rows.groupBy("issn").agg(F.min(F.struct("work_seq", "name", "type")).alias("_f")).select("issn", "_f.*")
    return dense_ids(first, ["work_seq"], "id").select(
        "id", "name", "type", "issn", F.lit(-1).cast("long").alias("publisher_id"))


def work_ids(works: DataFrame) -> DataFrame:
    return dense_ids(works.select("work_seq"), ["work_seq"], "paper_id")


def academic_ids(works: DataFrame) -> DataFrame:
    """author_key, id, name, orcid of each academic, from its first encounter."""
    first = work_authors(works).where(F.col("author_key").isNotNull()).groupBy("author_key").agg(
        F.min(F.struct(F.struct("work_seq", "a_pos").alias("at"), "name", "orcid")).alias("_f"))
    return dense_ids(first.select("author_key", "_f.name", "_f.orcid", "_f.at.*"), ["work_seq", "a_pos"], "id").select(
        "author_key", "id", "name", "orcid")


def academics_dim(works: DataFrame) -> DataFrame:
    """Academics with paper, discipline and field ids (repeats kept) and distinct university ids, in order.

    The columns of the works that ids and lists come from are computed once and kept; all numberings read them from there.
    """
    works = cut_lineage(works.select("work_seq", "authorships", "primary_topic"))
    ids = academic_ids(works)
    authors = work_authors(works).where(F.col("author_key").isNotNull()).select("work_seq", "a_pos", "author_key")
    d = _topic_dim(works, "discipline").select(F.col("id").alias("discipline_id"), F.col("name").alias("_d"))
    f = _topic_dim(works, "subfield").select(F.col("id").alias("field_id"), F.col("name").alias("_f"))
    topics = _topic(works).join(d, F.col("discipline").eqNullSafe(F.col("_d"))).join(
        f, F.col("subfield").eqNullSafe(F.col("_f"))).select("work_seq", "discipline_id", "field_id")
    rows = authors.join(topics, "work_seq").join(work_ids(works), "work_seq")
    each = rows.groupBy("author_key").agg(
        F.array_sort(F.collect_list(F.struct("work_seq", "a_pos", "paper_id", "discipline_id", "field_id"))).alias("_r"))
    unis = universities_dim(works).select(F.col("id").alias("uid"), F.col("name").alias("_un"))
    linked = work_institutions(works).where(F.col("author_key").isNotNull()).join(
        unis, F.col("name").eqNullSafe(F.col("_un")))
    unis_of = ordered_distinct(linked, ["author_key"], "uid", ["work_seq", "a_pos", "i_pos"], "university_ids")
    take = lambda c: F.transform("_r", lambda s: s[c])
    return ids.join(each, "author_key").join(unis_of, "author_key", "left").select(
        "id", "name", F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("academic_position"),
        F.lit(None).cast("string").alias("profile_url"), F.col("orcid").alias("orcid_url"),
        take("paper_id").alias("research_paper_ids"),
        F.coalesce("university_ids", F.array().cast("array<bigint>")).alias("university_ids"),
        take("discipline_id").alias("discipline_ids"), take("field_id").alias("field_ids"))


def papers_fact(works: DataFrame) -> DataFrame:
    """One row per work with foreign ids resolved; the works are computed once and kept, as all numberings read them."""
    works = cut_lineage(works)
    ids = academic_ids(works).select("author_key", F.col("id").alias("aid"))
    authors = work_authors(works).where(F.col("author_key").isNotNull()).select("work_seq", "a_pos", "author_key")
    academics = ordered_distinct(authors.join(ids, "author_key"), ["work_seq"], "aid", ["a_pos"], "academic_ids")
    unis = universities_dim(works).select(F.col("id").alias("uid"), F.col("name").alias("_un"))
    inst = work_institutions(works).select("work_seq", "a_pos", "i_pos", "name").join(
        unis, F.col("name").eqNullSafe(F.col("_un")))
    universities = ordered_distinct(inst, ["work_seq"], "uid", ["a_pos", "i_pos"], "university_ids")
    journals = journals_dim(works).select(F.col("id").alias("journal_id"), F.col("issn").alias("_issn"))
    faculties = faculties_dim(works).select(F.col("id").alias("_fid"), F.col("name").alias("_fn"))
    first, last = F.col("biblio.first_page"), F.col("biblio.last_page")
    names = F.transform(F.coalesce("keywords", F.array().cast("array<struct<display_name:string>>")), lambda k: k["display_name"])
    none = F.array().cast("array<bigint>")
    return (
        works.join(work_ids(works), "work_seq")
        .join(academics, "work_seq", "left").join(universities, "work_seq", "left")
        .join(journals, F.col("primary_location.source.issn_l") == F.col("_issn"), "left")
        .join(faculties, F.col("primary_topic.domain.display_name").eqNullSafe(F.col("_fn")), "left")
        .select(
            F.col("paper_id").alias("id"), F.col("id").alias("openalex_id"), F.col("title").alias("name"),
            "publication_date", F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"),
            F.when(first.isNotNull() & last.isNotNull(), F.concat_ws("-", first, last)).otherwise(first).alias("page_numbers"),
            F.col("ids.doi").alias("doi"), F.col("open_access.is_oa").alias("is_open_access"),
            F.col("open_access.oa_url").alias("open_access_url"), F.col("primary_location.pdf_url").alias("primary_url"),
            F.col("primary_location.raw_type").alias("publication_type"),
            F.col("cited_by_count").alias("incoming_citation_count"),
            F.filter(names, has_text).alias("keywords"),
            empty_if_null("referenced_works").alias("outgoing_citations"),
            F.lit(-1).cast("long").alias("publisher_id"), "journal_id",
            F.coalesce("university_ids", none).alias("university_ids"), F.array("_fid").alias("faculty_ids"),
            F.coalesce("academic_ids", none).alias("academic_ids"),
        )
    )


def score_stub(papers: DataFrame) -> DataFrame:
    """One placeholder score row per paper."""
    fixed = F.lit(0.99)
    return papers.select(
        "id", F.col("id").alias("research_paper_id"), "academic_ids", "publisher_id", "journal_id",
        fixed.alias("paper_authority_score"), fixed.alias("academic_authority_score"),
        fixed.alias("publisher_authority_score"), fixed.alias("journal_authenticity_score"))
