"""Stored scores and their projection onto entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.functions.text import clamp_score, has_text, id_array, parse_date, strip
from papertrellis.schemas import with_optional

PUBLICATION = "publication"
RESEARCHER = "researcher"

SCORE_FIELDS = (
    "paper_authority_score",
    "academic_authority_score",
    "citation_influence_score",
    "author_authority_score",
    "journal_authenticity_score",
)

ENTITY_COLUMNS = (
    "entity_id", "kind", "label", "publication_date", "citation_score", "paper_authority_score",
    "paper_authority_reproducible", "author_authority_score", "journal_authenticity_score",
    "journal_authenticity_reproducible", "academic_authority_score", "academic_authority_provenance",
    "evidence_ids", "source_urls",
)

METADATA_TABLES = ("university", "faculty", "discipline", "field", "journal")


def namespaced(table: str, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(f"{table}:"), c.cast("string"))


def steady_mean(value: Column) -> Column:
    """Mean of values in [0, 1] by an exact sum of 15 decimals, the same in whatever order and however many tasks they are added."""
    return F.sum(value.cast("decimal(20,15)")).cast("double") / F.count(value)


def score_by_paper(scores: DataFrame) -> DataFrame:
    """Per paper the mean of each valid clamped score."""
    return (
        scores.where(F.col("research_paper_id").isNotNull())
        .groupBy(F.col("research_paper_id").cast("string").alias("paper_id"))
        .agg(*[steady_mean(clamp_score(F.col(f))).alias(f) for f in SCORE_FIELDS], F.count(F.lit(1)).alias("score_rows"))
    )


def score_by_academic(scores: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Mean academic authority over the score rows that list the academic; repeats count again.

    ``wanted`` (one column of ids) leaves other academics out before anything is summed.
    """
    listed = (
        scores.select(clamp_score(F.col("academic_authority_score")).alias("v"), "academic_ids")
        .where(F.col("v").isNotNull())
        .select("v", F.explode(id_array(F.col("academic_ids"))).alias("academic_id"))
    )
    if wanted is not None:
        listed = listed.join(wanted, F.col("academic_id") == F.col(wanted.columns[0]), "left_semi")
    return listed.groupBy("academic_id").agg(steady_mean(F.col("v")).alias("academic_authority_score"))


def distinct_urls(*urls: Column) -> Column:
    """Non-blank urls in order, each once."""
    kept = [F.when(strip(u) != "", u) for u in urls]
    return F.array_distinct(F.array_compact(F.array(*kept)))


def paper_entity(papers: DataFrame, paper_scores: DataFrame | None = None) -> DataFrame:
    papers = papers.where(F.col("id").isNotNull())
    if paper_scores is not None:
        joined = papers.join(paper_scores.withColumnRenamed("paper_id", "_pid"), F.col("id") == F.col("_pid"), "left")
    else:
        joined = papers
        for f in SCORE_FIELDS:
            joined = joined.withColumn(f, F.lit(None).cast("double"))
        joined = joined.withColumn("_pid", F.lit(None).cast("string"))
    doi_url = F.when(strip(F.col("doi")) != "", F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return joined.select(
        namespaced("research_paper", "id").alias("entity_id"),
        F.lit(PUBLICATION).alias("kind"),
        F.when(has_text(F.col("name")), F.col("name")).otherwise(F.col("id").cast("string")).alias("label"),
        parse_date(F.col("publication_date")).alias("publication_date"),
        F.col("citation_influence_score").alias("citation_score"),
        "paper_authority_score",
        F.col("paper_authority_score").isNotNull().alias("paper_authority_reproducible"),
        "author_authority_score",
        "journal_authenticity_score",
        F.col("journal_authenticity_score").isNotNull().alias("journal_authenticity_reproducible"),
        "academic_authority_score",
        F.when(F.col("_pid").isNotNull(), F.lit("score_table")).alias("academic_authority_provenance"),
        F.array().cast("array<string>").alias("evidence_ids"),
        distinct_urls(F.col("primary_url"), F.col("open_access_url"), doi_url).alias("source_urls"),
    )


def _bare_entity(df: DataFrame, table: str, kind: str, urls: Column, authority: Column | None = None) -> DataFrame:
    null_double = F.lit(None).cast("double")
    authority = null_double if authority is None else authority
    return df.where(F.col("id").isNotNull()).select(
        namespaced(table, "id").alias("entity_id"),
        F.lit(kind).alias("kind"),
        F.when(has_text(F.col("name")), F.col("name")).otherwise(F.col("id").cast("string")).alias("label"),
        F.lit(None).cast("date").alias("publication_date"),
        null_double.alias("citation_score"),
        null_double.alias("paper_authority_score"),
        F.lit(False).alias("paper_authority_reproducible"),
        null_double.alias("author_authority_score"),
        null_double.alias("journal_authenticity_score"),
        F.lit(False).alias("journal_authenticity_reproducible"),
        authority.alias("academic_authority_score"),
        F.when(authority.isNotNull(), F.lit("score_table")).alias("academic_authority_provenance"),
        F.array().cast("array<string>").alias("evidence_ids"),
        urls.alias("source_urls"),
    )


def academic_entity(academics: DataFrame, authority: DataFrame | None = None) -> DataFrame:
    """Researcher entities; without ``authority`` (as in the graph) the score stays null."""
    urls = distinct_urls(F.col("profile_url"), F.col("orcid_url"))
    if authority is None:
        return _bare_entity(academics, "academic", RESEARCHER, urls)
    joined = academics.join(
        authority.select(F.col("academic_id").alias("_aid"), F.col("academic_authority_score").alias("_auth")),
        F.col("id") == F.col("_aid"),
        "left",
    )
    return _bare_entity(joined, "academic", RESEARCHER, urls, F.col("_auth"))


def metadata_entity(tables: dict[str, DataFrame]) -> DataFrame:
    """Nodes of the named lookup tables that have a name."""
    parts = []
    for table in METADATA_TABLES:
        if table in tables:
            df = tables[table].where(has_text(F.col("name")))
            df = with_optional(df, ror_url="string")
            urls = distinct_urls(F.col("ror_url")) if table == "university" else F.array().cast("array<string>")
            parts.append(_bare_entity(df, table, table, urls))
    return reduce(DataFrame.unionByName, parts)


def validate_entities(entities: DataFrame) -> DataFrame:
    """Rows that break the entity contract, with the reason."""
    checks = [
        F.when(~has_text(F.col("entity_id")) | ~has_text(F.col("label")), F.lit("missing id or label")),
    ]
    for f in ("citation_score", *(s for s in SCORE_FIELDS if s != "citation_influence_score")):
        checks.append(F.when(~F.col(f).between(0.0, 1.0) | F.isnan(f), F.lit(f"{f} outside [0, 1]")))
    return (
        entities.select("entity_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    )
