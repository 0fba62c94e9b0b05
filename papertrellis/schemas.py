"""Stored tables: column registry and explicit read schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "university": _struct(id=_S, name=_S, country_code=_S, ror_url=_S, type=_S),
    "faculty": _struct(id=_S, name=_S),
    "discipline": _struct(id=_S, name=_S, faculty_id=_S),
    "field": _struct(id=_S, name=_S, discipline_id=_S),
    "publisher": _struct(id=_S, name=_S),
    "journal": _struct(id=_S, name=_S, type=_S, issn=_S, publisher_id=_S),
    "academic": _struct(
        id=_S, name=_S, gender=_S, academic_position=_S, profile_url=_S, orcid_url=_S,
        research_paper_ids=_L, university_ids=_L, discipline_ids=_L, field_ids=_L,
        research_interests=_L, areas_of_expertise=_L, academic_summary=_S,
    ),
    "research_paper": _struct(
        id=_S, name=_S, publication_date=T.DateType(), volume=T.IntegerType(), issue=T.IntegerType(),
        page_numbers=_S, doi=_S, is_open_access=T.BooleanType(), open_access_url=_S, primary_url=_S,
        publication_type=_S, incoming_citation_count=T.IntegerType(), keywords=_L, outgoing_citations=_L,
        publisher_id=_S, journal_id=_S, university_ids=_L, faculty_ids=_L, academic_ids=_L,
    ),
    "score": _struct(
        id=_S, paper_authority_score=_D, academic_authority_score=_D, publisher_authority_score=_D,
        journal_authenticity_score=_D, citation_influence_score=_D, author_authority_score=_D,
        research_paper_id=_S, academic_ids=_L, publisher_id=_S, journal_id=_S,
    ),
}

# The columns each readable table exposes to retrieval, in order.
READABLE: dict[str, tuple[str, ...]] = {
    "university": ("id", "name", "country_code", "ror_url", "type"),
    "faculty": ("id", "name"),
    "discipline": ("id", "name", "faculty_id"),
    "field": ("id", "name", "discipline_id"),
    "journal": ("id", "name", "type", "issn"),
    "academic": (
        "id", "name", "academic_position", "profile_url", "orcid_url",
        "research_paper_ids", "university_ids", "discipline_ids", "field_ids",
    ),
    "research_paper": (
        "id", "name", "publication_date", "doi", "is_open_access", "open_access_url", "primary_url",
        "publication_type", "incoming_citation_count", "keywords", "outgoing_citations", "journal_id",
        "university_ids", "faculty_ids", "academic_ids",
    ),
    "score": (
        "id", "paper_authority_score", "academic_authority_score", "citation_influence_score",
        "author_authority_score", "journal_authenticity_score", "research_paper_id", "academic_ids", "journal_id",
    ),
}

# Landed bibliographic works, as a DDL string for spark.read.schema.
WORKS = (
    """work_seq BIGINT, id STRING, title STRING, publication_date DATE, cited_by_count BIGINT,
    referenced_works ARRAY<STRING>, ids STRUCT<doi: STRING>,
    biblio STRUCT<volume: STRING, issue: STRING, first_page: STRING, last_page: STRING>,
    open_access STRUCT<is_oa: BOOLEAN, oa_url: STRING>,
    primary_location STRUCT<pdf_url: STRING, raw_type: STRING,
        source: STRUCT<issn_l: STRING, display_name: STRING, type: STRING>>,
    primary_topic STRUCT<domain: STRUCT<display_name: STRING>, field: STRUCT<display_name: STRING>,
        subfield: STRUCT<display_name: STRING>>,
    keywords ARRAY<STRUCT<display_name: STRING>>,
    authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING, orcid: STRING>,
        institutions: ARRAY<STRUCT<id: STRING, display_name: STRING, country_code: STRING, ror: STRING,
            type: STRING>>>>"""
)


def project_table(df: DataFrame, table: str) -> DataFrame:
    """The fixed projection of a readable table."""
    if table not in READABLE:
        raise ValueError(f"unknown table {table!r}")
    return df.select(*READABLE[table])


def with_optional(df: DataFrame, **columns: str) -> DataFrame:
    """Add missing optional columns as typed nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
