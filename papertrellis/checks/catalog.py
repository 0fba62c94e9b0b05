"""The query catalogue over the works corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrellis.checks.registry import check, joined
from papertrellis.plans import catalog as c

PAPER = ("id", "name", "publication_date", "doi", "incoming_citation_count")
PAPER_SQL = "p.id, p.name, p.publication_date, p.doi, p.incoming_citation_count"
PEOPLE = ("id", "name", "academic_position", "profile_url")
PEOPLE_SQL = "a.id, a.name, a.academic_position, a.profile_url"


@check("universities_by_name", "SELECT id, name, country_code, ror_url, type FROM university ORDER BY name")
def _(v):
    return c.by_name(v("university").select("id", "name", "country_code", "ror_url", "type"))


@check("academics_by_name", f"SELECT {PEOPLE_SQL} FROM academic a ORDER BY a.name")
def _(v):
    return c.by_name(v("academic").select(*PEOPLE))


@check("academics_by_keyword", f"""
    SELECT {PEOPLE_SQL} FROM academic a WHERE a.name ILIKE '%RED%' OR EXISTS (
        SELECT 1 FROM field f WHERE list_contains(a.field_ids, f.id) AND f.name ILIKE '%area 1%')""")
def _(v):
    return c.academics_by_keyword(v("academic"), v("field"), "%RED%", "%area 1%").select(*PEOPLE)


@check("academics_of_university", f"""
    SELECT {PEOPLE_SQL} FROM academic a JOIN university u ON list_contains(a.university_ids, u.id)
    WHERE u.name ILIKE '%nation_1%'""")
def _(v):
    return c.related(v("academic"), "university_ids", v("university"), "%nation_1%").select(*PEOPLE)


@check("academics_in_discipline", f"""
    SELECT {PEOPLE_SQL} FROM academic a JOIN discipline d ON list_contains(a.discipline_ids, d.id)
    WHERE d.name ILIKE '%discipline 2%'""")
def _(v):
    return c.related(v("academic"), "discipline_ids", v("discipline"), "%discipline 2%").select(*PEOPLE)


@check("academics_in_field", f"""
    SELECT {PEOPLE_SQL} FROM academic a JOIN field f ON list_contains(a.field_ids, f.id) WHERE f.name ILIKE '%area 7'""")
def _(v):
    return c.related(v("academic"), "field_ids", v("field"), "%area 7").select(*PEOPLE)


@check("papers_newest_first", f"SELECT {PAPER_SQL} FROM research_paper p ORDER BY p.publication_date DESC NULLS FIRST")
def _(v):
    return c.newest_first(v("research_paper").select(*PAPER))


@check("papers_by_title_or_keyword", f"""
    SELECT {PAPER_SQL} FROM research_paper p WHERE p.name ILIKE '%blue%' OR EXISTS (
        SELECT 1 FROM (SELECT unnest(p.keywords) AS k) u WHERE u.k ILIKE '%topic 2%')""")
def _(v):
    return c.papers_by_title_or_keyword(v("research_paper"), "%blue%", "%topic 2%").select(*PAPER)


@check("papers_by_author", f"""
    SELECT {PAPER_SQL} FROM research_paper p JOIN academic a ON list_contains(p.academic_ids, a.id)
    WHERE a.name ILIKE '%red%9%'""")
def _(v):
    return c.papers_by_author(v("research_paper"), v("academic"), "%red%9%").select(*PAPER)


@check("authors_of_papers", f"""
    SELECT {PEOPLE_SQL} FROM academic a JOIN research_paper p ON list_contains(p.academic_ids, a.id)
    WHERE p.name ILIKE '%ring%7%'""")
def _(v):
    return c.authors_of_papers(v("academic"), v("research_paper"), "%ring%7%").select(*PEOPLE)


@check("papers_of_university", f"""
    SELECT {PAPER_SQL} FROM research_paper p JOIN university u ON list_contains(p.university_ids, u.id)
    WHERE u.name ILIKE '%nation_2%'""")
def _(v):
    return c.related(v("research_paper"), "university_ids", v("university"), "%nation_2%").select(*PAPER)


@check("papers_of_faculty", f"""
    SELECT {PAPER_SQL} FROM research_paper p JOIN faculty f ON list_contains(p.faculty_ids, f.id)
    WHERE f.name ILIKE '%studies 3%'""")
def _(v):
    return c.related(v("research_paper"), "faculty_ids", v("faculty"), "%studies 3%").select(*PAPER)


@check("papers_in_journal", f"""
    SELECT {PAPER_SQL} FROM research_paper p JOIN journal j ON p.journal_id = j.id WHERE j.name ILIKE '%00001%'""")
def _(v):
    return c.papers_in(v("research_paper"), "journal_id", v("journal"), "%00001%").select(*PAPER)


@check("papers_of_publisher", f"""
    SELECT {PAPER_SQL} FROM research_paper p JOIN publisher j ON p.publisher_id = j.id WHERE j.name ILIKE '%asi%'""")
def _(v):
    return c.papers_in(v("research_paper"), "publisher_id", v("publisher"), "%asi%").select(*PAPER)


@check("papers_with_venue", """
    SELECT p.name AS paper_name, p.publication_date, p.doi, j.name AS journal_name, b.name AS publisher_name
    FROM research_paper p LEFT JOIN journal j ON p.journal_id = j.id LEFT JOIN publisher b ON p.publisher_id = b.id
    ORDER BY p.publication_date DESC NULLS FIRST""")
def _(v):
    return c.papers_with_venue(v("research_paper"), v("journal"), v("publisher"))


@check("academics_with_university", """
    SELECT a.name AS academic_name, a.academic_position, u.name AS university_name
    FROM academic a JOIN university u ON list_contains(a.university_ids, u.id) ORDER BY a.name""")
def _(v):
    return c.academics_with(v("academic"), "university_ids", v("university"), "university_name", ("academic_position",))


@check("academics_with_discipline", """
    SELECT a.name AS academic_name, d.name AS discipline_name
    FROM academic a JOIN discipline d ON list_contains(a.discipline_ids, d.id) ORDER BY a.name""")
def _(v):
    return c.academics_with(v("academic"), "discipline_ids", v("discipline"), "discipline_name")


@check("most_cited", """
    SELECT name, publication_date, incoming_citation_count FROM research_paper
    ORDER BY incoming_citation_count DESC NULLS FIRST""")
def _(v):
    return c.most_cited(v("research_paper"))


@check("open_access", "SELECT name, publication_date, open_access_url FROM research_paper WHERE is_open_access")
def _(v):
    return c.open_access(v("research_paper"))


@check("topic_search", """
    SELECT DISTINCT id, name, academic_position, array_to_string(research_interests, '|') AS interests,
           array_to_string(areas_of_expertise, '|') AS expertise, profile_url FROM academic
    WHERE EXISTS (SELECT 1 FROM (SELECT unnest(research_interests) AS x) u WHERE x ILIKE '%brand#1%')
       OR EXISTS (SELECT 1 FROM (SELECT unnest(areas_of_expertise) AS x) u WHERE x ILIKE '%blue%')""")
def _(v):
    a = v("academic")
    first = c.topic_search(a, "%brand#1%")
    both = first.unionByName(c.topic_search(a, "%blue%")).distinct()
    return both.select("id", "name", "academic_position", joined("research_interests").alias("interests"),
                       joined("areas_of_expertise").alias("expertise"), "profile_url")


@check("seed_listing", """
    SELECT id, name, publication_date, doi, publication_type FROM research_paper
    ORDER BY publication_date DESC NULLS FIRST""")
def _(v):
    return c.newest_first(v("research_paper").select("id", "name", "publication_date", "doi", "publication_type"))
