"""Normalisation, scoping, cleaning, entity resolution and quality over derived tables; reads and writes."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from papertrellis.checks.registry import check, joined
from papertrellis.checks.views import Views
from papertrellis.functions.ids import uuid_v5
from papertrellis.functions.relations import attach_row, dense_ids
from papertrellis.operators import clean, normalise, quality, resolve, scope
from papertrellis.schemas import READABLE, project_table
from papertrellis.session import cut_lineage, new_folder
from papertrellis.sources import sinks, tables

# --- normalisation ---


def works(v: Views) -> DataFrame:
    """The flat work views nested as landed works."""
    none = F.lit(None).cast("string")
    nations = v("nation").groupBy("n_nationkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    nations = nations.where("n_nationkey is not null").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("long"), "names"))).alias("_nations"))

    def institutions(work, uni):
        return F.transform(F.coalesce(F.try_element_at("_nations", uni), F.array().cast("array<string>")), lambda name: F.struct(
            F.concat(F.lit("https://openalex.org/I"), uni).alias("id"), name.alias("display_name"),
            F.concat(F.lit("C"), work % 3).alias("country_code"), none.alias("ror"), F.lit("education").alias("type")))

    def authorship(line):
        work, part = F.col("work_seq"), line["l_partkey"]
        number = (part * 50 + work % 50).cast("string")
        both = F.concat(institutions(work, line["l_suppkey"] % 25), institutions(work, F.when(line["l_linenumber"] % 2 == 0, part % 25)))
        return F.struct(
            F.struct(F.when(part % 19 != 0, F.concat(F.lit("Author "), number)).alias("display_name"),
                     F.when(part % 5 == 0, F.concat(F.lit("https://orcid.org/"), number)).alias("orcid")).alias("author"),
            F.when(F.size(both) > 0, both).alias("institutions"))

    # as the views work_author and work_institution have them; only the numbers of the line items move, once
    lines = v("lineitem").where("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("work_seq")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("_lines"))
    topics = v("work_topic").join(lines, "work_seq", "left")
    one = lambda c: F.struct(F.col(c).alias("display_name"))
    return attach_row(topics, nations).select(
        "work_seq", F.col("work_id").alias("id"), F.concat(F.lit("Work "), F.col("work_seq")).alias("title"),
        "publication_date", "cited_by_count",
        F.array(F.concat(F.lit("https://openalex.org/W"), F.col("work_seq") + 1), F.col("work_id")).alias("referenced_works"),
        F.struct(F.concat(F.lit("https://doi.org/10.1/w"), F.col("work_seq")).alias("doi")).alias("ids"),
        F.struct(none.alias("volume"), none.alias("issue"), "first_page", "last_page").alias("biblio"),
        F.struct((F.col("status") == "O").alias("is_oa"), none.alias("oa_url")).alias("open_access"),
        F.struct(none.alias("pdf_url"), "raw_type", F.struct(
            F.col("issn").alias("issn_l"), F.col("journal_name").alias("display_name"), F.lit("journal").alias("type"),
        ).alias("source")).alias("primary_location"),
        F.struct(one("domain").alias("domain"), one("discipline").alias("field"), one("subfield").alias("subfield")).alias(
            "primary_topic"),
        F.array(one("status"), one("raw_type"), F.struct(F.lit("").alias("display_name"))).alias("keywords"),
        F.transform("_lines", authorship).alias("authorships"))


@check("dedupe_works", """
    SELECT id, source_seq, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_seq, seq) AS rn
    FROM landed_work) z WHERE rn = 1""")
def _(v):
    return normalise.dedupe_works(v("landed_work")).select("id", "source_seq", "seq")


@check("cap_per_source", """
    SELECT id, source_seq, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_seq ORDER BY seq) AS rn
    FROM landed_work WHERE source_seq IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) z WHERE rn <= 100""")
def _(v):
    sources = v("nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("source_seq"))
    return normalise.cap_per_source(v("landed_work"), sources).select("id", "source_seq", "seq")


DIMS = {
    "keyed": """
        SELECT *, coalesce(orcid, author_name) AS akey FROM work_author WHERE coalesce(orcid, author_name) IS NOT NULL""",
    "uni_ids": """
        SELECT uni_name, row_number() OVER (ORDER BY spot) - 1 AS uid, any_id, cc FROM (
            SELECT uni_name, min((work_seq, a_pos, i_pos)) AS spot, any_value(uni_id) AS any_id,
                   arg_min(country_code, (work_seq, a_pos, i_pos)) AS cc FROM work_institution GROUP BY uni_name) z""",
    "dom_ids": """
        SELECT domain, row_number() OVER (ORDER BY w) - 1 AS did FROM (
            SELECT domain, min(work_seq) AS w FROM work_topic GROUP BY domain) z""",
    "dis_ids": """
        SELECT discipline, row_number() OVER (ORDER BY w) - 1 AS sid, w FROM (
            SELECT discipline, min(work_seq) AS w FROM work_topic GROUP BY discipline) z""",
    "sub_ids": """
        SELECT subfield, row_number() OVER (ORDER BY w) - 1 AS fid, w FROM (
            SELECT subfield, min(work_seq) AS w FROM work_topic GROUP BY subfield) z""",
    "jou_ids": """
        SELECT issn, row_number() OVER (ORDER BY w) - 1 AS jid, nm FROM (
            SELECT issn, min(work_seq) AS w, arg_min(journal_name, work_seq) AS nm FROM work_topic
            WHERE issn IS NOT NULL GROUP BY issn) z""",
    "aca_ids": """
        SELECT akey, row_number() OVER (ORDER BY spot) - 1 AS aid, nm, orc FROM (
            SELECT akey, min((work_seq, a_pos)) AS spot, arg_min(coalesce(author_name, '~'), (work_seq, a_pos)) AS nm,
                   max(orcid) AS orc FROM keyed GROUP BY akey) z""",
    "wrk_ids": "SELECT work_seq, row_number() OVER (ORDER BY work_seq) - 1 AS pid FROM work_topic",
}


@check("universities_dim", """
    SELECT uid AS id, uni_name AS name, any_id AS openalex_id, cc AS country_code FROM uni_ids""", **DIMS)
def _(v):
    return normalise.universities_dim(works(v)).select("id", "name", "openalex_id", "country_code")


@check("faculties_dim", "SELECT did AS id, domain AS name FROM dom_ids", **DIMS)
def _(v):
    return normalise.faculties_dim(works(v))


@check("disciplines_dim", """
    SELECT sid AS id, s.discipline AS name, d.did AS faculty_id FROM dis_ids s JOIN work_topic t ON t.work_seq = s.w
    JOIN dom_ids d ON d.domain IS NOT DISTINCT FROM t.domain""", **DIMS)
def _(v):
    return normalise.disciplines_dim(works(v))


@check("fields_dim", """
    SELECT fid AS id, s.subfield AS name, d.sid AS discipline_id FROM sub_ids s JOIN work_topic t ON t.work_seq = s.w
    JOIN dis_ids d ON d.discipline = t.discipline""", **DIMS)
def _(v):
    return normalise.fields_dim(works(v))


@check("journals_dim", "SELECT jid AS id, nm AS name, issn, -1 AS publisher_id FROM jou_ids", **DIMS)
def _(v):
    return normalise.journals_dim(works(v)).select("id", "name", "issn", "publisher_id")


@check("academics_dim", """
    WITH per AS (SELECT k.akey, string_agg(CAST(p.pid AS VARCHAR), '|' ORDER BY k.work_seq, k.a_pos) AS papers,
            string_agg(CAST(d.sid AS VARCHAR), '|' ORDER BY k.work_seq, k.a_pos) AS disciplines,
            string_agg(CAST(s.fid AS VARCHAR), '|' ORDER BY k.work_seq, k.a_pos) AS fields
        FROM keyed k JOIN wrk_ids p ON p.work_seq = k.work_seq JOIN work_topic t ON t.work_seq = k.work_seq
        JOIN dis_ids d ON d.discipline = t.discipline JOIN sub_ids s ON s.subfield = t.subfield GROUP BY k.akey),
    unis AS (SELECT akey, string_agg(CAST(uid AS VARCHAR), '|' ORDER BY spot) AS universities FROM (
            SELECT k.akey, u.uid, min((i.work_seq, i.a_pos, i.i_pos)) AS spot
            FROM keyed k JOIN work_institution i ON i.work_seq = k.work_seq AND i.a_pos = k.a_pos
            JOIN uni_ids u ON u.uni_name = i.uni_name GROUP BY ALL) z GROUP BY akey)
    SELECT a.aid AS id, a.nm AS name, a.orc AS orcid_url, per.papers, per.disciplines, per.fields,
           coalesce(unis.universities, '') AS universities
    FROM aca_ids a JOIN per ON per.akey = a.akey LEFT JOIN unis ON unis.akey = a.akey""", **DIMS)
def _(v):
    return normalise.academics_dim(works(v)).select(
        "id", F.coalesce("name", F.lit("~")).alias("name"), "orcid_url", joined("research_paper_ids").alias("papers"),
        joined("discipline_ids").alias("disciplines"), joined("field_ids").alias("fields"),
        joined("university_ids").alias("universities"))


@check("papers_fact", """
    WITH aca AS (SELECT work_seq, string_agg(CAST(aid AS VARCHAR), '|' ORDER BY p) AS academics FROM (
            SELECT k.work_seq, a.aid, min(k.a_pos) AS p FROM keyed k JOIN aca_ids a ON a.akey = k.akey GROUP BY ALL) z
            GROUP BY work_seq),
    uni AS (SELECT work_seq, string_agg(CAST(uid AS VARCHAR), '|' ORDER BY p) AS universities FROM (
            SELECT i.work_seq, u.uid, min((i.a_pos, i.i_pos)) AS p FROM work_institution i
            JOIN uni_ids u ON u.uni_name = i.uni_name GROUP BY ALL) z GROUP BY work_seq)
    SELECT p.pid AS id, t.work_id AS openalex_id,
           CASE WHEN first_page IS NOT NULL AND last_page IS NOT NULL THEN first_page || '-' || last_page
                ELSE first_page END AS page_numbers,
           'https://doi.org/10.1/w' || t.work_seq AS doi, t.status = 'O' AS is_open_access,
           t.status || '|' || t.raw_type AS keywords, j.jid AS journal_id, CAST(d.did AS VARCHAR) AS faculties,
           coalesce(aca.academics, '') AS academics, coalesce(uni.universities, '') AS universities,
           'https://openalex.org/W' || (t.work_seq + 1) || '|' || t.work_id AS outgoing
    FROM work_topic t JOIN wrk_ids p ON p.work_seq = t.work_seq LEFT JOIN jou_ids j ON j.issn = t.issn
    JOIN dom_ids d ON d.domain IS NOT DISTINCT FROM t.domain LEFT JOIN aca ON aca.work_seq = t.work_seq
    LEFT JOIN uni ON uni.work_seq = t.work_seq""", **DIMS)
def _(v):
    return normalise.papers_fact(works(v)).select(
        "id", "openalex_id", "page_numbers", "doi", "is_open_access", joined("keywords").alias("keywords"), "journal_id",
        joined("faculty_ids").alias("faculties"), joined("academic_ids").alias("academics"),
        joined("university_ids").alias("universities"), joined("outgoing_citations").alias("outgoing"))


@check("score_stub", """
    SELECT id AS research_paper_id, journal_id, 0.99e0 AS paper_authority_score, 0.99e0 AS academic_authority_score,
           0.99e0 AS publisher_authority_score, 0.99e0 AS journal_authenticity_score FROM research_paper""")
def _(v):
    return normalise.score_stub(v("research_paper")).select(
        "research_paper_id", "journal_id", "paper_authority_score", "academic_authority_score",
        "publisher_authority_score", "journal_authenticity_score")


@check("dense_ids", """
    SELECT academic_no, row_number() OVER (ORDER BY first_paper, academic_no) - 1 AS id FROM (
        SELECT academic_no, min(paper_no) AS first_paper FROM authorship GROUP BY academic_no) z""")
def _(v):
    first = v("authorship").groupBy("academic_no").agg(F.min("paper_no").alias("first_paper"))
    return dense_ids(first, ["first_paper", "academic_no"], "id", rows=5_000).select("academic_no", "id")


# --- scope ---

TARGETS = tuple(f"I{i}" for i in range(0, 25, 3))


def scoped(v: Views):
    unis = scope.target_universities(v("university"), TARGETS)
    people = scope.target_academics(v("academic"), unis)
    papers = scope.papers_in_scope(v("research_paper"), people)
    papers = cut_lineage(scope.paper_universities_backfill(papers, people, unis, seq="academic_no"))
    used = scope.used_academics(people, papers)
    return unis, people, papers, used


SCOPE = {
    "tuni": "SELECT * FROM university WHERE CAST(id AS INT) % 3 = 0",
    "taca": """
        SELECT * FROM academic a WHERE EXISTS (SELECT 1 FROM tuni WHERE list_contains(a.university_ids, tuni.id))""",
    "pa": """
        SELECT id, a, min(pos) AS pos FROM (
            SELECT id, unnest(academic_ids) AS a, generate_subscripts(academic_ids, 1) AS pos FROM research_paper) z
        WHERE a IN (SELECT id FROM taca) GROUP BY ALL""",
    "inpap": "SELECT id, string_agg(a, '|' ORDER BY pos) AS academics FROM pa GROUP BY id",
    "au": """
        SELECT id, academic_no, unnest(university_ids) AS u, generate_subscripts(university_ids, 1) AS pos FROM taca""",
    "pu": """
        SELECT id, u, (0, 0, pos) AS spot FROM (
            SELECT id, unnest(university_ids) AS u, generate_subscripts(university_ids, 1) AS pos FROM research_paper
            WHERE id IN (SELECT id FROM inpap)) z
        UNION ALL SELECT pa.id, au.u, (1, au.academic_no, au.pos) FROM pa JOIN au ON au.id = pa.a""",
    "puni": """
        SELECT id, string_agg(u, '|' ORDER BY spot) AS universities FROM (
            SELECT id, u, min(spot) AS spot FROM pu WHERE u IN (SELECT id FROM tuni) GROUP BY ALL) z GROUP BY id""",
}


@check("id_from_url", """
    SELECT id, nullif(string_split(rtrim(u, '/'), '/')[-1], '') AS tail FROM (
        SELECT id, coalesce(profile_url, '') || CASE WHEN academic_no % 2 = 0 AND profile_url IS NOT NULL THEN '//' ELSE '' END
        AS u FROM academic) z""")
def _(v):
    url = F.when(F.col("academic_no") % 2 == 0, F.concat(F.col("profile_url"), F.lit("//"))).otherwise(
        F.coalesce("profile_url", F.lit("")))
    return v("academic").select("id", scope.id_from_url(url).alias("tail"))


@check("target_universities", "SELECT id, name FROM tuni", **SCOPE)
def _(v):
    return scope.target_universities(v("university"), TARGETS).select("id", "name")


@check("target_academics", "SELECT id, name FROM taca", **SCOPE)
def _(v):
    return scope.target_academics(v("academic"), scope.target_universities(v("university"), TARGETS)).select("id", "name")


@check("papers_in_scope", "SELECT id, academics FROM inpap", **SCOPE)
def _(v):
    unis = scope.target_universities(v("university"), TARGETS)
    return scope.papers_in_scope(v("research_paper"), scope.target_academics(v("academic"), unis)).select(
        "id", joined("academic_ids").alias("academics"))


@check("paper_universities_backfill", "SELECT id, universities FROM puni", **SCOPE)
def _(v):
    return scoped(v)[2].select("id", joined("university_ids").alias("universities"))


@check("used_academics", "SELECT DISTINCT a AS id FROM pa", **SCOPE)
def _(v):
    return scoped(v)[3].select("id")


@check("prune_relations", """
    SELECT a.id, coalesce(string_agg(DISTINCT p.pid, '|' ORDER BY p.pid), '') AS papers FROM taca a
    LEFT JOIN (SELECT id, unnest(research_paper_ids) AS pid FROM taca) p ON p.id = a.id
        AND p.pid IN (SELECT id FROM inpap)
    WHERE a.id IN (SELECT a FROM pa) GROUP BY a.id""", **SCOPE)
def _(v):
    unis, _people, papers, used = scoped(v)
    return scope.prune_relations(used, papers, unis).select("id", joined(F.array_sort("research_paper_ids")).alias("papers"))


@check("scope_report", """
    SELECT (SELECT count(*) FROM inpap) AS papers, 0 AS papers_without_academics, 0 AS papers_without_universities,
           (SELECT count(*) FROM tuni) AS universities, (SELECT count(DISTINCT a) FROM pa) AS academics""", **SCOPE)
def _(v):
    unis, _people, papers, used = scoped(v)
    return scope.scope_report(unis, used, papers)


@check("unplaced_papers", """
    SELECT r.id AS paper_id, r.name, u.a AS academic_id, a.name AS academic_name,
           array_to_string(list_sort(coalesce(a.university_ids, [])), '|') AS universities
    FROM (SELECT id, name, unnest(academic_ids) AS a FROM research_paper WHERE CAST(id AS BIGINT) % 3 = 0) u
    JOIN research_paper r ON r.id = u.id JOIN academic a ON a.id = u.a""")
def _(v):
    # every third paper has lost its universities
    lost = F.col("id").cast("long") % 3 == 0
    papers = v("research_paper").withColumn("university_ids", F.when(lost, F.array().cast("array<string>")).otherwise(F.array(F.lit("u"))))
    found = scope.unplaced_papers(papers, v("academic"))
    return found.select("paper_id", "name", "academic_id", "academic_name", joined(F.array_sort("academic_universities")).alias("universities"))


# --- cleaning ---


@check("clean_string", "SELECT id, nullif(trim(issue), '') AS issue, nullif(trim(page_numbers), '') AS pages FROM research_paper")
def _(v):
    return v("research_paper").select(
        "id", clean.clean_string(F.col("issue")).alias("issue"), clean.clean_string(F.col("page_numbers")).alias("pages"))


@check("clean_issue", "SELECT id, TRY_CAST(trim(issue) AS INT) AS issue FROM research_paper")
def _(v):
    return v("research_paper").select("id", clean.clean_issue(F.col("issue")).alias("issue"))


@check("clean_page_numbers", """
    SELECT id, CASE WHEN page_numbers <> '' AND NOT contains(page_numbers, 'None') THEN page_numbers END AS pages
    FROM research_paper""")
def _(v):
    return v("research_paper").select("id", clean.clean_page_numbers(F.col("page_numbers")).alias("pages"))


@check("clean_papers", """
    SELECT id, trim(name) AS name, volume, TRY_CAST(trim(issue) AS INT) AS issue,
           CASE WHEN page_numbers <> '' AND NOT contains(page_numbers, 'None') THEN page_numbers END AS page_numbers,
           doi, open_access_url, primary_url, publication_type FROM research_paper""")
def _(v):
    return clean.clean_papers(v("research_paper")).select(
        "id", "name", "volume", "issue", "page_numbers", "doi", "open_access_url", "primary_url", "publication_type")


NS = clean.MINT_NAMESPACE


def sql_uuid5(material: str, namespace: str = NS) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({material}))"
    return (
        f"(substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' || "
        f"substring('89ab', CAST(('0x' || substring({h}, 17, 1)) AS INT) % 4 + 1, 1) || substring({h}, 18, 3) || '-' || "
        f"substring({h}, 21, 12))"
    )


def existing(v: Views) -> DataFrame:
    """Stored mappings: papers of open orders, all faculties."""
    return v("research_paper").where("is_open_access").select(
        F.lit("research_papers").alias("kind"), F.col("id").alias("local_id"),
        F.concat(F.lit("stored-"), F.col("id")).alias("uuid"))


def paper_map(v: Views) -> DataFrame:
    return clean.map_or_mint_ids(v("research_paper"), existing(v), "research_papers")


PMAP = {
    "pmap": f"""
        SELECT id AS local_id, CASE WHEN is_open_access THEN 'stored-' || id
               ELSE {sql_uuid5("'research_papers:' || id")} END AS uuid FROM research_paper""",
    "lastid": """
        SELECT ext, arg_max(id, paper_no) AS cited FROM (
            SELECT id, paper_no, 'W' || (paper_no % 5000) AS ext FROM research_paper) z GROUP BY ext""",
    "cite": """
        SELECT id, cited, min(pos) AS pos FROM (
            SELECT id, unnest(outgoing_citations) AS c, generate_subscripts(outgoing_citations, 1) AS pos FROM research_paper) z
        JOIN lastid l ON l.ext = 'W' || z.c WHERE l.cited <> z.id GROUP BY ALL""",
}


@check("map_or_mint_ids", "SELECT local_id, uuid FROM pmap", **PMAP)
def _(v):
    return paper_map(v).select("local_id", "uuid")


@check("map_id", """
    SELECT p.id, m.uuid AS journal_id FROM research_paper p LEFT JOIN (
        SELECT id AS local_id, 'j' || id AS uuid FROM journal WHERE type <> 'MACHINERY') m ON m.local_id = p.journal_id""")
def _(v):
    mapping = v("journal").where("type <> 'MACHINERY'").select(
        F.col("id").alias("local_id"), F.concat(F.lit("j"), F.col("id")).alias("uuid"))
    return clean.map_id(v("research_paper").select("id", "journal_id"), "journal_id", mapping)


@check("map_id_array", """
    SELECT p.id, coalesce(x.u, '') AS universities FROM research_paper p LEFT JOIN (
        SELECT id, string_agg(uu, '|' ORDER BY pos) AS u FROM (
            SELECT id, 'c' || m.n_regionkey AS uu, min(pos) AS pos FROM (
                SELECT id, unnest(university_ids) AS k, generate_subscripts(university_ids, 1) AS pos FROM research_paper) z
            JOIN nation m ON CAST(m.n_nationkey AS VARCHAR) = z.k AND m.n_regionkey <> 2 GROUP BY ALL) y GROUP BY id) x
    ON x.id = p.id""")
def _(v):
    mapping = v("nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").cast("string").alias("local_id"), F.concat(F.lit("c"), F.col("n_regionkey")).alias("uuid"))
    return clean.map_id_array(v("research_paper").select("id", "university_ids"), "university_ids", mapping).select(
        "id", joined("university_ids").alias("universities"))


def landed_papers(v: Views) -> DataFrame:
    """Papers whose external ids repeat, citing by external id."""
    ext = F.concat(F.lit("W"), F.col("paper_no") % 5000)
    cites = F.transform("outgoing_citations", lambda x: F.concat(F.lit("W"), x))
    return v("research_paper").withColumns({"openalex_id": ext, "outgoing_citations": cites, "seq": F.col("paper_no")})


@check("resolve_citations", """
    SELECT p.id, coalesce(string_agg(c.cited, '|' ORDER BY c.pos), '') AS outgoing
    FROM research_paper p LEFT JOIN cite c ON c.id = p.id GROUP BY p.id""", **PMAP)
def _(v):
    return clean.resolve_citations(landed_papers(v)).select("id", joined("outgoing_citations").alias("outgoing"))


def prefixed(v: Views, table: str, kind: str) -> DataFrame:
    return v(table).select(
        F.lit(kind).alias("kind"), F.col("id").cast("string").alias("local_id"),
        F.concat(F.lit(f"{kind[0]}-"), F.col("id")).alias("uuid"))


def all_maps(v: Views) -> dict[str, DataFrame]:
    return {
        "research_papers": paper_map(v), "universities": prefixed(v, "university", "universities"),
        "academics": prefixed(v, "academic", "academics"), "journals": prefixed(v, "journal", "journals"),
        "faculties": prefixed(v, "faculty", "faculties"), "disciplines": prefixed(v, "discipline", "disciplines"),
        "fields": prefixed(v, "field", "fields"),
    }


@check("export_papers", """
    SELECT m.uuid AS id, p.volume, TRY_CAST(trim(p.issue) AS INT) AS issue,
           coalesce((SELECT string_agg(mm.uuid, '|' ORDER BY c.pos) FROM cite c JOIN pmap mm ON mm.local_id = c.cited
                     WHERE c.id = p.id), '') AS outgoing,
           'j-' || j.id AS journal_id, 'f-' || p.faculty_ids[1] AS faculties,
           array_to_string(['a-' || x FOR x IN coalesce(p.academic_ids, [])], '|') AS academics,
           CASE WHEN p.university_ids[1] = p.university_ids[2] THEN 'u-' || p.university_ids[1]
                ELSE 'u-' || p.university_ids[1] || '|u-' || p.university_ids[2] END AS universities
    FROM research_paper p JOIN pmap m ON m.local_id = p.id LEFT JOIN journal j ON j.id = p.journal_id""", **PMAP)
def _(v):
    return clean.export_papers(landed_papers(v), all_maps(v)).select(
        "id", "volume", "issue", joined("outgoing_citations").alias("outgoing"), "journal_id",
        joined("faculty_ids").alias("faculties"), joined("academic_ids").alias("academics"),
        joined("university_ids").alias("universities"))


KEEP_D = tuple(f"d-{i}" for i in range(0, 29, 2))
KEEP_F = tuple(f"f-{i}" for i in range(0, 97, 3))


@check("export_academics", """
    SELECT 'a-' || a.id AS id, a.name,
           array_to_string([x FOR x IN ['d-' || y FOR y IN a.discipline_ids]
                            IF CAST(substring(x, 3) AS INT) % 2 = 0], '|') AS disciplines,
           array_to_string([x FOR x IN CASE WHEN a.field_ids[1] = a.field_ids[2] THEN ['f-' || a.field_ids[1]]
                            ELSE ['f-' || y FOR y IN a.field_ids] END
                            IF CAST(substring(x, 3) AS INT) % 3 = 0], '|') AS fields,
           len(a.research_paper_ids) AS n_papers
    FROM academic a""", **PMAP)
def _(v):
    a = v("academic").withColumn("academic_summary", F.lit(None).cast("string"))
    return clean.export_academics(a, all_maps(v), KEEP_D, KEEP_F).select(
        "id", "name", joined("discipline_ids").alias("disciplines"), joined("field_ids").alias("fields"),
        F.size("research_paper_ids").cast("long").alias("n_papers"))


def machinery_map(v: Views) -> DataFrame:
    """Mapping that misses one kind of journal and repeats uuids by nation."""
    return v("customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("local_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("uuid"))


@check("export_journals", """
    SELECT 'n' || c_nationkey AS id, c_name AS name, c_mktsegment AS type, 'ISSN-' || c_custkey AS issn
    FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def _(v):
    return clean.export_journals(v("journal"), machinery_map(v))


@check("export_journals_check", """
    SELECT count(*) AS source_rows, count(*) FILTER (c_mktsegment <> 'MACHINERY') AS exported_rows, true AS duplicate_ids,
           count(*) FILTER (c_mktsegment = 'MACHINERY') AS missing_mapping FROM customer""")
def _(v):
    return clean.export_check(v("journal"), machinery_map(v))


@check("export_faculties", "SELECT 'f-' || id AS id, name FROM faculty")
def _(v):
    return clean.export_faculties(v("faculty"), prefixed(v, "faculty", "faculties"))


@check("issue_profile", """
    SELECT CASE WHEN issue IS NULL THEN 'null' WHEN TRY_CAST(trim(issue) AS INT) IS NULL THEN 'text' ELSE 'number' END
           AS issue_class, count(*) AS n FROM research_paper GROUP BY ALL""")
def _(v):
    return clean.issue_profile(v("research_paper"))


@check("invalid_issues", """
    SELECT id, name, issue FROM research_paper WHERE issue IS NOT NULL AND TRY_CAST(trim(issue) AS INT) IS NULL""")
def _(v):
    return clean.invalid_issues(v("research_paper"))


@check("required_name_check", "SELECT count(*) AS without_name FROM profile WHERE name IS NULL OR name = ''")
def _(v):
    return clean.required_name_check(v("profile"))


@check("issue_presence", """
    SELECT count(TRY_CAST(trim(issue) AS INT)) AS with_issue, count(*) - count(TRY_CAST(trim(issue) AS INT)) AS without_issue
    FROM research_paper""")
def _(v):
    return clean.issue_presence(clean.clean_papers(v("research_paper")))


@check("paper_integrity_report", """
    WITH c AS (SELECT id, unnest(outgoing_citations) AS x FROM research_paper)
    SELECT count(*) AS papers, 0 AS missing_id, count(*) FILTER (academic_ids IS NULL) AS without_academics,
           0 AS without_universities, count(*) AS with_citations, (SELECT count(*) FROM c) AS citations,
           count(*) FILTER (list_contains(outgoing_citations, id)) AS self_citations,
           count(*) FILTER (outgoing_citations[1] = outgoing_citations[2]) AS duplicate_citations,
           (SELECT count(*) FROM c WHERE x NOT IN (SELECT id FROM research_paper)) AS dangling_citations
    FROM research_paper""")
def _(v):
    p = v("research_paper").withColumn("academic_ids", F.coalesce("academic_ids", F.array().cast("array<string>")))
    return clean.paper_integrity_report(p)


@check("uuid_v5", f"SELECT name, {sql_uuid5('name')} AS uuid FROM academic")
def _(v):
    return v("academic").select("name", uuid_v5(NS, F.col("name")).alias("uuid"))


# --- entity resolution and quality ---


@check("normalise_academic", """
    SELECT seq, name, academic_position, array_to_string(coalesce(research_interests, []), '|') AS interests,
           array_to_string(coalesce(areas_of_expertise, []), '|') AS expertise, profile_url, orcid_url, university_name
    FROM profile""")
def _(v):
    return resolve.normalise_academic(v("profile")).select(
        "seq", "name", "academic_position", joined("research_interests").alias("interests"),
        joined("areas_of_expertise").alias("expertise"), "profile_url", "orcid_url", "university_name")


@check("source_counts", """
    SELECT CASE seq % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS source, count(*) AS n FROM profile
    WHERE seq % 3 < 2 GROUP BY ALL""")
def _(v):
    p = v("profile")
    return resolve.source_counts(resolve.union_sources({"a": p.where("seq % 3 = 0"), "b": p.where("seq % 3 = 1"), "c": None}))


ENT = {
    "keyp": """
        SELECT *, CASE WHEN profile_url <> '' THEN 'p;' || trim(lower(profile_url))
                       WHEN name <> '' AND university_name <> '' THEN 'n;' || trim(lower(name)) || ';' || trim(lower(university_name))
                  END AS k FROM profile""",
    "items": """
        SELECT k, 'r' AS w, seq, unnest(research_interests) AS raw, generate_subscripts(research_interests, 1) AS pos FROM keyp
        UNION ALL SELECT k, 'e', seq, unnest(areas_of_expertise), generate_subscripts(areas_of_expertise, 1) FROM keyp""",
    "firsts": """
        SELECT k, w, lower(trim(raw)) AS l, min((seq, pos)) AS spot, arg_min(trim(raw), (seq, pos)) AS item FROM items
        WHERE trim(raw) <> '' GROUP BY ALL""",
    "lists": "SELECT k, w, string_agg(item, '|' ORDER BY spot) AS merged FROM firsts GROUP BY ALL",
}


@check("dedupe_academics", """
    SELECT min(p.seq) AS seq, arg_min(coalesce(name, '~'), p.seq) AS name,
           coalesce(arg_min(academic_position, p.seq) FILTER (academic_position <> ''),
                    nullif(arg_min(coalesce(academic_position, '~'), p.seq), '~')) AS academic_position,
           coalesce(arg_min(orcid_url, p.seq) FILTER (orcid_url <> ''),
                    nullif(arg_min(coalesce(orcid_url, '~'), p.seq), '~')) AS orcid_url,
           CASE WHEN count(*) = 1 THEN coalesce(any_value(array_to_string(research_interests, '|')), '')
                ELSE coalesce(any_value(r.merged), '') END AS interests,
           CASE WHEN count(*) = 1 THEN coalesce(any_value(array_to_string(areas_of_expertise, '|')), '')
                ELSE coalesce(any_value(e.merged), '') END AS expertise,
           count(*) AS n_rows
    FROM keyp p LEFT JOIN lists r ON r.k = p.k AND r.w = 'r' LEFT JOIN lists e ON e.k = p.k AND e.w = 'e'
    WHERE p.k IS NOT NULL GROUP BY p.k""", **ENT)
def _(v):
    return resolve.dedupe_academics(resolve.normalise_academic(v("profile"))).select(
        "seq", F.coalesce("name", F.lit("~")).alias("name"), "academic_position", "orcid_url",
        joined("research_interests").alias("interests"), joined("areas_of_expertise").alias("expertise"), "n_rows")


@check("merge_lists", """
    SELECT seq, coalesce((SELECT string_agg(item, '|' ORDER BY spot) FROM (
        SELECT lower(trim(x)) AS l, min(i) AS spot, arg_min(trim(x), i) AS item FROM (
            SELECT unnest(list_concat(coalesce(research_interests, []), coalesce(areas_of_expertise, []))) AS x,
                   generate_subscripts(list_concat(coalesce(research_interests, []), coalesce(areas_of_expertise, [])), 1) AS i) u
        WHERE trim(x) <> '' GROUP BY 1) y), '') AS merged FROM profile""")
def _(v):
    p = resolve.normalise_academic(v("profile"))
    return p.select("seq", joined(resolve.merge_lists(F.col("research_interests"), F.col("areas_of_expertise"))).alias("merged"))


NAME_SQL = """trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@check("normalise_name", f"""
    SELECT DISTINCT {NAME_SQL.format("t")} AS name_key FROM (
        SELECT name AS t FROM profile UNION ALL SELECT text FROM conversations) z""")
def _(v):
    names = v("profile").select("name").unionByName(v("conversations").select(F.col("text").alias("name")))
    return names.select(resolve.normalise_name(F.col("name")).alias("name_key")).distinct()


# base people whose names meet the collected ones
BASE_SQL = {
    "base": """
        SELECT academic_no, CASE WHEN academic_no % 2 = 0 THEN 'DR PER SON ' || CAST(academic_no % 4000 AS VARCHAR)
               ELSE name END AS name, academic_position, profile_url, orcid_url FROM academic""",
    "prof_one": f"""
        SELECT k, any_value(academic_position) AS pos, any_value(profile_url) AS pu, any_value(orcid_url) AS ou,
               any_value(research_interests) AS ri FROM (
            SELECT {NAME_SQL.format("name || ' ' || (seq % 7)")} AS k, p.* FROM profile p WHERE name IS NOT NULL) z
        GROUP BY k HAVING count(*) = 1""",
    "mrg": f"""
        SELECT b.academic_no, coalesce(nullif(pos, ''), b.academic_position) AS academic_position,
               coalesce(nullif(pu, ''), b.profile_url) AS profile_url, coalesce(nullif(ou, ''), b.orcid_url) AS orcid_url,
               CASE WHEN len(ri) > 0 THEN array_to_string(ri, ' ') END AS academic_summary, k IS NOT NULL AS matched
        FROM base b LEFT JOIN prof_one ON prof_one.k = {NAME_SQL.format("b.name || ' ' || (b.academic_no % 7)")}""",
}


def merged(v: Views):
    a = v("academic")
    name = F.when(F.col("academic_no") % 2 == 0, F.concat(F.lit("DR PER SON "), F.col("academic_no") % 4000)).otherwise(
        F.col("name"))
    base = a.select("academic_no", F.concat(name, F.lit(" "), F.col("academic_no") % 7).alias("name"), "academic_position",
                    "profile_url", "orcid_url")
    p = v("profile").withColumn("name", F.concat("name", F.lit(" "), F.col("seq") % 7))
    return resolve.merge_profiles(base, p), p


@check("merge_profiles", "SELECT * FROM mrg", **BASE_SQL)
def _(v):
    return merged(v)[0].drop("name")


@check("merge_report", """
    SELECT count(*) AS base, count(*) FILTER (matched) AS matched, count(academic_summary) AS with_summary,
           (SELECT count(*) FROM profile) AS profiles FROM mrg""", **BASE_SQL)
def _(v):
    m, p = merged(v)
    return resolve.merge_report(m, p)


SUSP = "|".join(quality.SUSPICIOUS_TERMS)


@check("coverage_by_university", """
    SELECT university_name, count(*) AS total, count(*) FILTER (academic_position <> '') AS position,
           count(*) FILTER (len(research_interests) > 0) AS interests, count(*) FILTER (len(areas_of_expertise) > 0) AS expertise,
           count(*) FILTER (orcid_url <> '') AS orcid,
           round(100e0 * count(*) FILTER (academic_position <> '') / count(*), 1) AS position_pct FROM profile GROUP BY 1""")
def _(v):
    return quality.coverage_by_university(v("profile")).drop("interests_pct", "expertise_pct", "orcid_pct")


@check("missing_fields", """
    SELECT seq, 'name' AS missing FROM profile WHERE coalesce(name, '') = ''
    UNION ALL SELECT seq, 'profile_url' FROM profile WHERE coalesce(profile_url, '') = ''""")
def _(v):
    return quality.missing_fields(v("profile")).select("seq", "missing")


@check("suspicious_positions", f"""
    SELECT name, university_name, academic_position, profile_url FROM profile
    WHERE regexp_matches(lower(academic_position), '{SUSP}')""")
def _(v):
    return quality.suspicious_positions(v("profile"))


@check("long_interests", """
    SELECT doc_id AS name, source AS university_name, substring(x, 1, 200) || '...' AS interest FROM (
        SELECT doc_id, source, unnest(string_split(text, '.')) AS x FROM documents) z WHERE length(x) > 250""")
def _(v):
    rows = v("documents").select(F.col("doc_id").alias("name"), F.col("source").alias("university_name"),
                                 F.split("text", r"\.").alias("research_interests"))
    return quality.long_interests(rows)


@check("duplicate_profiles", "SELECT profile_url, count(*) AS n FROM profile WHERE profile_url <> '' GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return quality.duplicate_profiles(v("profile"))


@check("duplicate_orcids", "SELECT orcid_url, count(*) AS n FROM profile WHERE orcid_url <> '' GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return quality.duplicate_orcids(v("profile"))


CROSS = """
    SELECT trim(lower(name)) AS name_key, count(*) AS n FROM profile WHERE name <> '' GROUP BY 1
    HAVING count(DISTINCT coalesce(university_name, '~')) > 1"""


@check("cross_university_names", CROSS)
def _(v):
    return quality.cross_university_names(v("profile"))


@check("dq_summary", f"""
    SELECT count(*) FILTER (coalesce(name, '') = '') AS missing_names,
           count(*) FILTER (coalesce(profile_url, '') = '') AS missing_profiles,
           count(*) FILTER (regexp_matches(lower(academic_position), '{SUSP}')) AS suspicious_positions, 0 AS long_interests,
           (SELECT count(*) FROM (SELECT 1 FROM profile WHERE profile_url <> '' GROUP BY profile_url HAVING count(*) > 1) z)
               AS duplicate_profiles,
           (SELECT count(*) FROM (SELECT 1 FROM profile WHERE orcid_url <> '' GROUP BY orcid_url HAVING count(*) > 1) z)
               AS duplicate_orcids,
           (SELECT count(*) FROM ({CROSS}) z) AS cross_university_names FROM profile""")
def _(v):
    return quality.dq_summary(v("profile"))


# --- reads and writes ---


def scratch(v: Views, name: str) -> str:
    return new_folder(v.spark, name)


@check("json_table", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(v):
    people = v("supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionAll(
        v("customer").select("c_nationkey", "c_custkey", "c_name"))
    path = scratch(v, "json_table")
    # one file per nation and id block, each a JSON array
    block = F.floor(F.col("id") / 1000)
    arrays = people.groupBy("s_nationkey", block.alias("b")).agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    arrays.select(F.concat_ws("-", "s_nationkey", "b").alias("part"), "value").write.partitionBy("part").text(path)
    return tables.json_table(v.spark, path, "id BIGINT, name STRING").select("id", "name")


@check("works_table", """
    SELECT t.work_seq, t.work_id AS id, t.subfield, count(a.work_seq) AS n_authors FROM work_topic t
    LEFT JOIN work_author a ON a.work_seq = t.work_seq GROUP BY ALL""")
def _(v):
    path = scratch(v, "works")
    sinks.write_json(works(v), path, "gzip")
    return tables.works_table(v.spark, path).select(
        "work_seq", "id", F.col("primary_topic.subfield.display_name").alias("subfield"),
        F.coalesce(F.size("authorships"), F.lit(0)).cast("long").alias("n_authors"))


@check("project_table", f"SELECT {', '.join(READABLE['journal'])} FROM journal")
def _(v):
    return project_table(v("journal"), "journal")


@check("bounded_scan", """
    SELECT id, name, (SELECT count(*) FROM academic) >= 4000 AS truncated FROM academic ORDER BY id LIMIT 4000""")
def _(v):
    return tables.bounded_scan(v("academic").select("id", "name"), 4_000)


@check("first_page", "SELECT id, name FROM academic ORDER BY id LIMIT 25")
def _(v):
    return tables.first_page(v("academic").select("id", "name"), 25)


@check("rows_by_ids", """
    SELECT id, name FROM academic WHERE id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) ORDER BY id""")
def _(v):
    ids = v("customer").select(F.concat(F.lit(" "), F.col("c_custkey")).alias("id"))
    return tables.rows_by_ids(v("academic").select("id", "name"), ids)


@check("rows_overlapping", """
    SELECT id, name FROM academic a WHERE EXISTS (
        SELECT 1 FROM nation n WHERE n.n_regionkey = 1 AND list_contains(a.university_ids, CAST(n.n_nationkey AS VARCHAR)))""")
def _(v):
    values = v("nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("value"))
    return tables.rows_overlapping(v("academic"), "university_ids", values).select("id", "name")


@check("eq_filter_read", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def _(v):
    return tables.eq_filter_read(v("orders"), ["o_orderkey", "o_custkey"], {"o_orderstatus": "F", "o_orderpriority": "5-LOW"})


@check("table_readiness", """
    SELECT t AS table_name, t <> 'score' AS present,
           CASE WHEN t = 'score' THEN 'id|paper_authority_score|academic_authority_score|citation_influence_score|author_authority_score|journal_authenticity_score|research_paper_id|academic_ids|journal_id'
                WHEN t = 'journal' THEN 'type|issn' ELSE '' END AS missing, t <> 'score' AS has_rows,
           t NOT IN ('score', 'journal') AS ready
    FROM (VALUES ('university'), ('faculty'), ('discipline'), ('field'), ('journal'), ('academic'), ('research_paper'),
                 ('score')) x(t)""")
def _(v):
    named = {t: v(t) for t in READABLE if t != "score"}
    named["journal"] = named["journal"].select("id", "name")
    return tables.table_readiness(named)


@check("pages_scan", "SELECT page_id, url, length(html) AS n FROM pages")
def _(v):
    return tables.pages_scan(v.spark, f"{v.folder}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"))


@check("write_json", "SELECT id, name, array_to_string(keywords, '|') AS keywords, doi FROM research_paper")
def _(v):
    path = scratch(v, "papers")
    sinks.write_json(v("research_paper").select("id", "name", "keywords", "doi"), path)
    back = v.spark.read.schema("id STRING, name STRING, keywords ARRAY<STRING>, doi STRING").json(path)
    return back.select("id", "name", joined("keywords").alias("keywords"), "doi")


SCORE_ROWS = """SELECT CAST(o_orderkey AS VARCHAR) AS research_paper_id, o_totalprice AS paper_authority_score"""


@check("write_csv", f"{SCORE_ROWS}, o_custkey AS citation_influence_score, o_orderstatus AS author_authority_score FROM orders")
def _(v):
    path = scratch(v, "scores")
    rows = v("orders").select(
        F.col("o_orderstatus").alias("author_authority_score"), F.col("o_orderkey").cast("string").alias("research_paper_id"),
        F.col("o_custkey").alias("citation_influence_score"), F.col("o_totalprice").alias("paper_authority_score"))
    sinks.write_csv(rows, path)
    return v.spark.read.option("header", True).schema(
        "research_paper_id STRING, paper_authority_score DOUBLE, citation_influence_score BIGINT, author_authority_score STRING"
    ).csv(path)


@check("write_provenance", """
    SELECT id AS research_paper_id, CASE WHEN is_open_access THEN 'imputed' ELSE 'observed' END AS author_authority_status,
           CASE WHEN is_open_access THEN 0.5e0 END AS author_authority_imputation_prior FROM research_paper""")
def _(v):
    path = scratch(v, "provenance")
    table = v("research_paper").select(
        F.col("id").alias("paper_id"), F.lit(0.5).alias("prior"),
        F.when(F.col("is_open_access"), "imputed").otherwise("observed").alias("authority_status"))
    sinks.write_provenance(table, path)
    return v.spark.read.schema(
        "research_paper_id STRING, author_authority_status STRING, author_authority_imputation_prior DOUBLE").json(path)
