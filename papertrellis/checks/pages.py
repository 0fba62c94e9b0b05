"""Field extraction from pages and profile records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrellis.checks.registry import check, joined
from papertrellis.checks.views import Views
from papertrellis.operators import pages
from papertrellis.session import cut_lineage

BLOCKS_TEXT = """
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(piece, '</?[a-zA-Z]([^>"'']|"[^"]*"|''[^'']*'')*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""


def blocks(v: Views) -> DataFrame:
    return pages.page_blocks(v("profile_page"))


def blocks_by_page(v: Views, kept: bool = False) -> DataFrame:
    """The blocks dealt by page into as many tasks as the pages, which AQE doesn't join to fewer: rules by section sort a task's blocks.

    ``kept``: they are cut out once for several rules.
    """
    found = cut_lineage(blocks(v)) if kept else blocks(v)
    return found.repartition(v.tasks("profile_page"), "page_id")


@check("page_blocks", f"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'),
            '<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>', ' ', 'gis') AS h FROM pages),
    cut AS (SELECT page_id, unnest(string_split(regexp_replace(h,
            '(</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)([\\s/>]))',
            chr(1) || '\\1', 'gi'), chr(1))) AS piece FROM bare),
    txt AS (SELECT page_id, lower(regexp_extract(piece, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, {BLOCKS_TEXT} AS t FROM cut)
    SELECT page_id, tag, count(*) AS n_blocks, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM txt WHERE t <> '' GROUP BY ALL
    """)
def _(v):
    b = pages.page_blocks(v("pages")).where("text IS NOT NULL")
    return b.groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@check("clean_text", """
    SELECT page_id, p_type || ', ' || p_brand AS value FROM profile_page JOIN part ON p_partkey = page_id""")
def _(v):
    # the texts that carry an interface phrase
    rows = blocks(v).where(F.col("text").endswith("Read more"))
    return rows.select("page_id", pages.clean_text(F.col("text")).alias("value"))


@check("distinct_ci", """
    SELECT page_id, 'Area ' || page_id % 13 AS items FROM profile_page""")
def _(v):
    rows = blocks(v).where("tag = 'li'")
    return rows.select("page_id", joined(pages.distinct_ci(F.split("text", ";"))).alias("items"))


@check("profile_links", """
    SELECT page_id, 'https://staff.example.edu/people/' || page_id % 50 AS link FROM profile_page WHERE page_id >= 50""")
def _(v):
    return pages.profile_links(blocks(v), v("profile_page"), r"/people/\d+$")


@check("directory_role", """
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'senior lecturer' WHEN 2 THEN 'professor' END AS role FROM profile_page
    WHERE page_id % 5 <> 4""")
def _(v):
    rows = blocks(v).where("tag = 'p' AND text rlike '^(Senior Lecturer in|PhD student|Professor$|School manager)'")
    return rows.select("page_id", pages.directory_role(F.col("text")).alias("role"))


@check("is_valid_academic", """
    SELECT page_id, page_id % 5 <> 3 AS valid FROM profile_page WHERE page_id % 5 <> 4""")
def _(v):
    rows = blocks(v).where("tag = 'p' AND text rlike '^(Senior Lecturer in|PhD student|Professor$|School manager)'")
    return rows.select("page_id", pages.is_valid_academic(F.col("text")).alias("valid"))


@check("page_name", "SELECT p_partkey AS page_id, p_name || ' & ' || p_partkey AS name FROM part")
def _(v):
    return pages.page_name(blocks(v))


@check("page_orcid", """
    SELECT p_partkey AS page_id, 'https://orcid.org/' || CASE p_partkey % 3
        WHEN 0 THEN '0000-0001-0000-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0')
        WHEN 1 THEN '0000-0002-0000-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || 'X'
        ELSE '0000-0003-0000-000X' END AS orcid_url FROM part""")
def _(v):
    return pages.page_orcid(blocks(v))


@check("position_near_heading", """
    SELECT p_partkey AS page_id, CASE
        WHEN p_partkey % 4 = 1 THEN 'Associate Professor ' || p_name || ' &'
        WHEN p_partkey % 4 = 2 THEN 'professor ' || p_name || ' &'
        WHEN p_partkey % 5 = 0 THEN 'Senior Lecturer in ' || p_type WHEN p_partkey % 5 = 2 THEN 'Professor'
        ELSE 'Acting Senior Research Fellow - Unit ' || p_partkey % 9 || ' School of Things' END AS position
    FROM part WHERE p_partkey % 4 IN (1, 2) OR p_partkey % 5 IN (0, 2) OR p_partkey % 2 = 0""")
def _(v):
    return pages.position_near_heading(v("profile_page"))


@check("position_by_priority", """
    SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 1 THEN 'Associate Professor'
        WHEN p_partkey % 4 = 2 OR p_partkey % 5 = 2 THEN 'Professor'
        WHEN p_partkey % 2 = 0 THEN 'Senior Research Fellow' WHEN p_partkey % 5 = 0 THEN 'Senior Lecturer' END AS position
    FROM part""")
def _(v):
    return pages.page_text(blocks(v)).select("page_id", pages.position_by_priority(F.col("page_text")).alias("position"))


@check("position_from_section", """
    SELECT p_partkey AS page_id, 'Senior Research Fellow - Unit ' || p_partkey % 9 AS position FROM part
    WHERE p_partkey % 2 = 0""")
def _(v):
    return pages.position_from_section(blocks_by_page(v))


@check("position_by_class", "SELECT p_partkey AS page_id, p_type || ' staff' AS position FROM part")
def _(v):
    return pages.position_by_class(v("profile_page"))


@check("section_text", """
    SELECT p_partkey AS page_id, '4611 ' || p_type || '|46 Computing ' || p_partkey % 5 || '|Section' AS texts FROM part""")
def _(v):
    return pages.section_list(blocks_by_page(v), ("research fields", "research field")).select(
        "page_id", joined("values").alias("texts"))


@check("section_text_contains", """
    SELECT p_partkey AS page_id, p_type || ', ' || p_brand || '|Area ' || p_partkey % 13 || '; area ' || p_partkey % 13
           AS texts FROM part""")
def _(v):
    return pages.section_list(blocks_by_page(v), ("interests",), "contains").select("page_id", joined("values").alias("texts"))


@check("split_interests", """
    SELECT doc_id, len(string_split(regexp_replace(text, '[^;,]', '', 'g'), '')) > 0 AS has_cut,
           (SELECT count(DISTINCT lower(x)) FROM (SELECT trim(regexp_replace(y, '[ .;:-]+$|^[ .;:-]+', '', 'g')) AS x FROM (
               SELECT unnest(string_split(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ',', ';'), ';')) AS y) u) w
            WHERE x <> '') AS n_items
    FROM documents""")
def _(v):
    items = pages.split_interests(pages.collapse(F.col("text")))
    return v("documents").select(
        "doc_id", F.lit(True).alias("has_cut"), F.size(items).cast("long").alias("n_items"))


@check("cue_interests", """
    SELECT p_partkey AS page_id, p_name || '|' || p_type || '|topic ' || p_partkey % 7 AS interests FROM part""")
def _(v):
    return pages.page_text(blocks(v)).select(
        "page_id", joined(pages.cue_interests(F.col("page_text"), "unimelb")).alias("interests"))


@check("resolve_interests", """
    SELECT p_partkey AS page_id, p_type || '|' || p_brand || '|Area ' || p_partkey % 13 AS interests FROM part""")
def _(v):
    return pages.resolve_interests(blocks_by_page(v, kept=True)).select("page_id", joined("interests").alias("interests"))


@check("expertise_values", """
    SELECT p_partkey AS page_id, p_type || '|Computing ' || p_partkey % 5 AS fields,
           p_brand || '|7 Clean Energy' AS keywords, p_brand AS kept, '' AS clusters FROM part""")
def _(v):
    b = blocks_by_page(v, kept=True)
    fields = pages.section_list(b, ("research fields",), "exact", "bio").select(
        "page_id", pages.field_values(F.col("values")).alias("fields"))
    words = pages.keyword_values(v("profile_page"))
    text = pages.page_text(b).select("page_id", pages.cluster_values(F.col("page_text")).alias("clusters"))
    return fields.join(words, "page_id").join(text, "page_id").select(
        "page_id", joined("fields").alias("fields"), joined("values").alias("keywords"),
        joined(pages.drop_goal_labels(F.col("values"))).alias("kept"), joined("clusters").alias("clusters"))


def profile_records(v: Views, source: str) -> DataFrame:
    """One JSON record per part."""
    none = F.lit(None).cast("string")
    k = F.col("p_partkey")
    body = F.to_json(F.struct(
        F.when(k % 10 == 0, none).when(k % 10 == 1, F.concat(F.lit("Student_"), k)).otherwise(F.concat(F.lit("u"), k)).alias("discoveryUrlId"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("firstNameLastName"), F.lit("Ann").alias("firstName"),
        F.col("p_name").alias("lastName"), F.col("p_type").alias("title"),
        F.when(k % 4 == 0, F.array(F.struct(F.col("p_brand").alias("position")))).alias("positions"),
        F.struct(F.array(F.struct(F.col("p_brand").alias("value")), F.struct(F.lit("").alias("value"))).alias("explicit")).alias("tags"),
        F.struct(F.concat(F.lit("https://orcid.org/"), k).alias("uri")).alias("orcid"),
        F.struct(F.concat(F.lit("Areas of interest are "), "p_name", F.lit(" and "), "p_type", F.lit(". End")).alias("value")).alias(
            "tabSummaryAbout"),
        F.col("p_name").alias("staffFullName"), F.col("p_type").alias("staffRole"), none.alias("liveUrl"),
        F.concat(F.lit("https://s.example.edu/"), k).alias("displayUrl"), F.col("p_name").alias("display_name"),
        F.array(F.struct(none.alias("organisation_position_title")), F.struct(F.col("p_type").alias("organisation_position_title"))).alias(
            "organisation_objects"),
        F.when(k % 2 == 0, k.cast("string")).alias("orc_id"),
        F.concat(F.lit("<p>Her research focuses on <b>"), "p_name", F.lit("</b> and "), "p_brand", F.lit(".</p>")).alias("bio"),
        F.array(F.lit("7 Clean Energy"), F.col("p_brand")).alias("publication_keywords"),
        F.array(F.lower("p_brand"), F.col("p_type")).alias("workcloud_keywords")))
    return v("part").select(k.alias("record_id"), body.alias("body"))


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "record_id", "name", "academic_position", joined("research_interests").alias("interests"),
        joined("areas_of_expertise").alias("expertise"), "profile_url", "orcid_url", "university_name")


NAME2 = "CASE WHEN p_partkey % 3 = 0 THEN 'Ann ' || p_name ELSE p_name END"


@check("profile_json", f"""
    SELECT p_partkey AS record_id, {NAME2} AS name,
           CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS academic_position, p_name || '|' || p_type AS interests,
           p_brand AS expertise,
           'https://profiles.sydney.edu.au/' || CASE WHEN p_partkey % 10 = 1 THEN 'Student_' ELSE 'u' END || p_partkey AS profile_url,
           'https://orcid.org/' || p_partkey AS orcid_url, 'University of Sydney' AS university_name
    FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT p_partkey, {NAME2}, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END, p_name || '|' || p_type,
           p_brand, 'https://profiles.uts.edu.au/u' || p_partkey, 'https://orcid.org/' || p_partkey,
           'University of Technology Sydney' FROM part WHERE p_partkey % 10 > 1
    UNION ALL SELECT p_partkey, p_name, p_type, '', '', 'https://s.example.edu/' || p_partkey, NULL, 'UNSW Sydney' FROM part
    UNION ALL SELECT p_partkey, p_name, p_type, p_name || '|' || p_brand, p_brand || '|' || p_type, NULL,
           CASE WHEN p_partkey % 2 = 0 THEN 'https://orcid.org/' || p_partkey END, 'University of Melbourne' FROM part""")
def _(v):
    out = None
    for source in ("usyd", "uts", "unsw", "unimelb"):
        part = shown(pages.profile_json(profile_records(v, source), source))
        out = part if out is None else out.unionByName(part)
    return out


@check("enrich_directory", """
    SELECT seq, name, coalesce(nullif(CASE WHEN seq % 2 = 0 THEN 'Fellow' ELSE '' END, ''), academic_position) AS academic_position,
           array_to_string(coalesce(research_interests, []), '|') AS interests, '' AS expertise, NULL AS orcid_url
    FROM profile WHERE seq % 3 = 1
    UNION ALL SELECT seq, name, academic_position, array_to_string(coalesce(research_interests, []), '|'), '', NULL
    FROM profile WHERE seq % 3 <> 1""")
def _(v):
    directory = v("profile")
    found = directory.where("seq % 3 = 1").select(
        "seq", F.when(F.col("seq") % 2 == 0, "Fellow").otherwise("").alias("academic_position"),
        F.array().cast("array<string>").alias("research_interests"))
    out = pages.enrich_directory(directory, found, "seq", blank=("areas_of_expertise", "orcid_url"))
    return out.select("seq", "name", "academic_position", joined("research_interests").alias("interests"),
                      joined("areas_of_expertise").alias("expertise"), "orcid_url")
