"""Cleaning of paper columns, id mapping, and export to the stored shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.functions.ids import uuid_v5
from papertrellis.functions.relations import attach_row, explode_ids, ordered_distinct
from papertrellis.functions.text import blank_to_null, has_text, strip

# Namespace of minted ids.
MINT_NAMESPACE = "6b0f4a52-6f0b-5d0e-9c58-0d8a3f6f1c11"

# Stored ids of the nine universities, by local id.
UNIVERSITY_IDS = {
    "0": "c5198c6a-8f7d-4684-b1fc-782fa625ae9a",
    "100": "570e618b-14b2-4ce6-8c70-7b2bd5284fd7",
    "148": "e6384eb4-8ee5-4bcf-8a49-22146c29c4da",
    "149": "27c870c5-6b24-4889-bf1a-082d7b749c25",
    "181": "76ccfb81-7253-46d8-899e-25e39ba20023",
    "263": "fdd57748-5185-4e73-863d-8304e834885d",
    "296": "2ff40b74-fefd-43dd-a0be-2540e9f25e43",
    "921": "76197670-83f1-40ce-87c4-4172c6829f90",
    "3646": "c062e483-3506-4add-813c-07885ef30eb2",
}

# The discipline and fields an exported academic may keep.
KEPT_DISCIPLINES = ("4780a5ce-ed92-4ad7-a863-126b8e8477a7",)
KEPT_FIELDS = (
    "edf06679-a420-4028-a675-e6b0406082a9",
    "8a2787cf-3f7d-4e40-8c0f-893e8a72950f",
    "22a7121d-7b7b-4b8e-8e51-6df0d44cd822",
    "66591424-5e4a-4400-b73f-b3a79b1034ce",
    "b3b631f6-937e-41bb-ab53-5410fbf05a18",
    "2cfc5ac4-da1d-4f2f-8ae2-9981f225b8d8",
    "8ce9555b-c407-4c97-9b28-3369faea9352",
    "0012f2c4-9245-4b20-883c-266b1fae74ce",
)

TEXT_COLUMNS = ("name", "volume", "doi", "open_access_url", "primary_url", "publication_type")


def clean_string(c: Column) -> Column:
    return blank_to_null(strip(c.cast("string")))


def clean_issue(c: Column) -> Column:
    """Whole number or null; '1-2' and 'S1' are not numbers."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def clean_page_numbers(c: Column) -> Column:
    return F.when(has_text(c) & ~c.contains("None"), strip(c))


def clean_papers(papers: DataFrame) -> DataFrame:
    changes = {c: clean_string(F.col(c)) for c in TEXT_COLUMNS if c in papers.columns}
    changes["issue"] = clean_issue(F.col("issue"))
    changes["page_numbers"] = clean_page_numbers(F.col("page_numbers"))
    return papers.withColumns(changes)


def map_or_mint_ids(items: DataFrame, existing: DataFrame, kind: str) -> DataFrame:
    """(kind, local_id, uuid): the stored uuid where there is one, else a name-based one.

    Minting from the kind and local id gives the same uuid on every run and every retry.
    """
    ids = items.select(F.col("id").cast("string").alias("local_id")).where(F.col("local_id").isNotNull()).distinct()
    known = existing.where(F.col("kind") == kind).select("local_id", F.col("uuid").alias("_known"))
    minted = uuid_v5(MINT_NAMESPACE, F.concat(F.lit(f"{kind}:"), F.col("local_id")))
    return ids.join(known, "local_id", "left").select(
        F.lit(kind).alias("kind"), "local_id", F.coalesce("_known", minted).alias("uuid"))


def map_id(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a local foreign key by its uuid; unmapped becomes null."""
    m = mapping.select(F.col("local_id").alias("_l"), F.col("uuid").alias("_u"))
    return df.join(m, F.col(column).cast("string") == F.col("_l"), "left").withColumn(column, F.col("_u")).drop("_l", "_u")


def map_id_array(df: DataFrame, column: str, mapping: DataFrame, key: str = "id") -> DataFrame:
    """Replace an array of local ids by uuids: unmapped ones go, distinct in order."""
    m = mapping.select(F.col("local_id").alias("_l"), F.col("uuid").alias("_u"))
    rows = explode_ids(df, column, "_l", keep=[key]).join(m, "_l")
    arrays = ordered_distinct(rows, [key], "_u", ["pos"], "_mapped")
    return df.join(arrays, key, "left").withColumn(
        column, F.coalesce("_mapped", F.array().cast("array<string>"))).drop("_mapped")


def resolve_citations(papers: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, outgoing_citations): cited external ids as ids of papers in the corpus.

    Citations out of the corpus or to the paper itself go. Where several papers
    carry one external id, the last of them stands for it.
    """
    lookup = papers.where(has_text(F.col("openalex_id"))).groupBy("openalex_id").agg(
        F.max_by("id", seq).alias("_cited"))
    rows = explode_ids(papers, "outgoing_citations", "openalex_id", keep=["id"]).join(lookup, "openalex_id")
    arrays = ordered_distinct(rows.where(F.col("_cited") != F.col("id")), ["id"], "_cited", ["pos"], "_c")
    return papers.select("id").join(arrays, "id", "left").select(
        "id", F.coalesce("_c", F.array().cast("array<string>")).alias("outgoing_citations"))


def export_papers(papers: DataFrame, maps: dict[str, DataFrame], seq: str = "seq") -> DataFrame:
    """Cleaned papers in the stored shape: every id a uuid."""
    clean = clean_papers(papers)
    cited = map_id_array(resolve_citations(papers, seq), "outgoing_citations", maps["research_papers"])
    out = clean.drop("outgoing_citations").join(cited, "id")
    for column, kind in (("university_ids", "universities"), ("faculty_ids", "faculties"), ("academic_ids", "academics")):
        out = map_id_array(out, column, maps[kind])
    out = map_id(map_id(out, "journal_id", maps["journals"]), "id", maps["research_papers"])
    return out.select(
        "id", "name", "publication_date", "volume", "issue", "page_numbers", "doi", "is_open_access", "open_access_url",
        "primary_url", "publication_type", "incoming_citation_count",
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "outgoing_citations", "journal_id",
        "university_ids", "faculty_ids", "academic_ids")


def export_academics(
    academics: DataFrame,
    maps: dict[str, DataFrame],
    disciplines: tuple[str, ...] = KEPT_DISCIPLINES,
    fields: tuple[str, ...] = KEPT_FIELDS,
) -> DataFrame:
    """Mapped academics only; discipline and field ids restricted to the allowed ones."""
    m = maps["academics"].select(F.col("local_id").alias("id"))
    out = academics.join(m, "id", "left_semi")
    for column, kind in (("research_paper_ids", "research_papers"), ("university_ids", "universities"),
                         ("discipline_ids", "disciplines"), ("field_ids", "fields")):
        out = map_id_array(out, column, maps[kind])
    out = map_id(out, "id", maps["academics"])
    return out.select(
        "id", "name", "academic_position", "profile_url", "orcid_url", "academic_summary", "research_paper_ids",
        "university_ids", F.filter("discipline_ids", lambda x: x.isin(*disciplines)).alias("discipline_ids"),
        F.filter("field_ids", lambda x: x.isin(*fields)).alias("field_ids"))


def export_journals(journals: DataFrame, mapping: DataFrame) -> DataFrame:
    return _mapped_only(journals, mapping).select("id", "name", "type", "issn")


def export_faculties(faculties: DataFrame, mapping: DataFrame) -> DataFrame:
    return _mapped_only(faculties, mapping).select("id", "name")


def _mapped_only(df: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("local_id").alias("_l"), F.col("uuid").alias("_u"))
    return df.join(m, F.col("id").cast("string") == F.col("_l")).withColumn("id", F.col("_u")).drop("_l", "_u")


def export_check(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: source rows, exported rows, rows without a mapping, whether exported ids repeat."""
    out = _mapped_only(df, mapping)
    missing = df.join(mapping.select(F.col("local_id").alias("id")), "id", "left_anti")
    row = df.agg(F.count(F.lit(1)).alias("source_rows"))
    row = attach_row(row, out.agg(
        F.count(F.lit(1)).alias("exported_rows"), (F.count(F.lit(1)) != F.count_distinct("id")).alias("duplicate_ids")))
    return attach_row(row, missing.agg(F.count(F.lit(1)).alias("missing_mapping")))


def issue_class(c: Column) -> Column:
    s = strip(c.cast("string"))
    return F.when(c.isNull(), "null").when(s.rlike(r"^[+-]?\d+$"), "number").otherwise("text")


def issue_profile(papers: DataFrame) -> DataFrame:
    """Rows per kind of issue value."""
    return papers.groupBy(issue_class(F.col("issue")).alias("issue_class")).agg(F.count(F.lit(1)).alias("n"))


def invalid_issues(papers: DataFrame, show: int | None = None) -> DataFrame:
    """The papers whose issue is neither missing nor a number, or the first ``show`` of them by id."""
    found = papers.where(issue_class(F.col("issue")) == "text").select("id", "name", "issue")
    return found if show is None else found.orderBy("id").limit(show)


def required_name_check(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_if(~has_text(F.col("name"))).alias("without_name"))


def issue_presence(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count("issue").alias("with_issue"), F.count_if(F.col("issue").isNull()).alias("without_issue"))


def paper_integrity_report(papers: DataFrame) -> DataFrame:
    """One row of checks over exported papers."""
    cites = F.coalesce("outgoing_citations", F.array().cast("array<string>"))
    row = papers.select("id", "academic_ids", "university_ids", cites.alias("c")).agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(~has_text(F.col("id"))).alias("missing_id"),
        F.count_if(F.size("academic_ids") == 0).alias("without_academics"),
        F.count_if(F.size("university_ids") == 0).alias("without_universities"),
        F.count_if(F.size("c") > 0).alias("with_citations"),
        F.sum(F.size("c")).cast("long").alias("citations"),
        F.count_if(F.coalesce(F.array_contains("c", F.col("id")), F.lit(False))).alias("self_citations"),
        F.count_if(F.size("c") != F.size(F.array_distinct("c"))).alias("duplicate_citations"),
    )
    known = papers.where(F.col("id").isNotNull()).select(F.col("id").alias("_c")).distinct()
    dangling = papers.select(F.explode(cites).alias("_c")).join(known, "_c", "left_anti")
    return attach_row(row, dangling.agg(F.count(F.lit(1)).alias("dangling_citations")))
