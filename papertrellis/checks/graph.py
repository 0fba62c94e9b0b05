"""Graph operators over both corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrellis.checks.registry import check, joined, rounded
from papertrellis.checks.views import Views
from papertrellis.operators import graph
from papertrellis.operators.scores import METADATA_TABLES, namespaced
from papertrellis.session import new_folder

EDGE_SQL = {
    "rawedge": """
        SELECT 'AUTHORED' AS rel, 'academic:' || id AS s, 'research_paper:' || unnest(research_paper_ids) AS t,
               'academic:' || id AS me FROM {a}
        UNION SELECT 'AFFILIATED_WITH', 'academic:' || id, 'university:' || unnest(university_ids), 'academic:' || id FROM {a}
        UNION SELECT 'ACADEMIC_IN_DISCIPLINE', 'academic:' || id, 'discipline:' || unnest(discipline_ids), 'academic:' || id
            FROM {a}
        UNION SELECT 'EXPERTISE_IN_FIELD', 'academic:' || id, 'field:' || unnest(field_ids), 'academic:' || id FROM {a}
        UNION SELECT 'AUTHORED', 'academic:' || unnest(academic_ids), 'research_paper:' || id, 'research_paper:' || id
            FROM {p}
        UNION SELECT 'CITES', 'research_paper:' || id, 'research_paper:' || unnest(outgoing_citations),
            'research_paper:' || id FROM {p}
        UNION SELECT 'PAPER_AT_UNIVERSITY', 'research_paper:' || id, 'university:' || unnest(university_ids),
            'research_paper:' || id FROM {p}
        UNION SELECT 'PAPER_IN_FACULTY', 'research_paper:' || id, 'faculty:' || unnest(faculty_ids),
            'research_paper:' || id FROM {p}
        UNION SELECT 'PUBLISHED_IN', 'research_paper:' || id, 'journal:' || journal_id, 'research_paper:' || id FROM {p}
            WHERE journal_id IS NOT NULL""",
}


def edges_over(papers: str, academics: str) -> dict[str, str]:
    return {"rawedge": EDGE_SQL["rawedge"].replace("{p}", papers).replace("{a}", academics)}


BIG = edges_over("research_paper", "academic")
LIB = edges_over("lib_paper", "lib_academic")


@check("project_edges", """
    SELECT DISTINCT rel || ':' || s || ':' || t AS edge_id, s AS source_id, t AS target_id, rel AS relation
    FROM rawedge""", **BIG)
def _(v):
    return graph.project_edges(v("academic"), v("research_paper"))


@check("namespace_ids", """
    SELECT 'academic:' || id AS node_id, 'academic' AS tab, id AS raw_id,
           array_to_string(['research_paper:' || x FOR x IN research_paper_ids], '|') AS papers FROM academic""")
def _(v):
    node = namespaced("academic", "id")
    table, raw = graph.split_entity_id(node)
    return v("academic").select(
        node.alias("node_id"), table.alias("tab"), raw.alias("raw_id"),
        joined(graph.namespace_values("research_paper", F.col("research_paper_ids"))).alias("papers"))


@check("bounded_relations", """
    SELECT me AS node_id, string_agg(e, '|' ORDER BY e) AS edges, max(n) > 4 AS cut FROM (
        SELECT me, e, row_number() OVER (PARTITION BY me ORDER BY e) AS rn, count(*) OVER (PARTITION BY me) AS n
        FROM (SELECT me, rel || ':' || s || ':' || t AS e FROM rawedge) y) z WHERE rn <= 4 GROUP BY me""", **BIG)
def _(v):
    both = graph.bounded_relations(v("academic"), "academic", 4).unionByName(
        graph.bounded_relations(v("research_paper"), "research_paper", 4))
    return both.select("node_id", joined(F.transform("edges", lambda e: e["edge_id"])).alias("edges"), "cut")


def library(v: Views) -> dict[str, DataFrame]:
    tables = {t: v(t) for t in METADATA_TABLES}
    return {**tables, "academic": v("lib_academic"), "research_paper": v("lib_paper"), "score": v("lib_score")}


def one_seed_each(v: Views) -> DataFrame:
    """Every document seeds one query."""
    return v("documents").select(
        F.concat(F.lit("n"), F.col("doc_id")).alias("query_id"), namespaced("research_paper", "doc_id").alias("node_id"))


# One hop, at most 4 entities: the seed and its first three distinct targets by edge id.
NEAR = {
    **LIB,
    "refs": """
        SELECT me, CASE WHEN s = me THEN t ELSE s END AS o, min(rel || ':' || s || ':' || t) AS e
        FROM rawedge WHERE me LIKE 'research_paper:%' GROUP BY ALL""",
    "adm": """
        SELECT me, o FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY e) AS rn FROM refs WHERE o <> me) z
        WHERE rn <= 3""",
    "present": """
        SELECT 'research_paper:' || id AS nid FROM lib_paper UNION SELECT 'academic:' || id FROM lib_academic
        UNION SELECT 'university:' || id FROM university UNION SELECT 'faculty:' || id FROM faculty
        UNION SELECT 'journal:' || id FROM journal""",
}


@check("neighbourhood", """
    SELECT 'n' || replace(me, 'research_paper:', '') AS query_id, o AS node_id FROM adm
    WHERE o IN (SELECT nid FROM present)
    UNION ALL SELECT 'n' || doc_id, 'research_paper:' || doc_id FROM documents""", **NEAR)
def _(v):
    near = graph.neighbourhood(one_seed_each(v), library(v), graph.Budget(max_hops=1, max_entities=4))
    return near.nodes


@check("neighbourhood_truncated", """
    SELECT 'n' || replace(me, 'research_paper:', '') AS query_id FROM refs WHERE o <> me GROUP BY me HAVING count(*) > 3
    """, **NEAR)
def _(v):
    near = graph.neighbourhood(one_seed_each(v), library(v), graph.Budget(max_hops=1, max_entities=4))
    return near.truncated.select("query_id")


def walked(seeds: str) -> dict[str, str]:
    """Neighbourhood and paths at the default budgets (2 hops, 50 entities, 100 relations, 20 neighbours) of queries with one seed each.

    With one seed of score 1 and edges of one confidence the strongest path is the shortest: a walk takes the seed's neighbours, then
    those of its neighbours in the order of their ids, until 50 entities are reached.
    """
    return {
        **LIB,
        "gseed": seeds,
        "present": """
            SELECT 'research_paper:' || id AS nid FROM lib_paper UNION SELECT 'academic:' || id FROM lib_academic
            UNION SELECT 'university:' || id FROM university WHERE name <> '' UNION SELECT 'faculty:' || id FROM faculty WHERE name <> ''
            UNION SELECT 'discipline:' || id FROM discipline WHERE name <> '' UNION SELECT 'field:' || id FROM field WHERE name <> ''
            UNION SELECT 'journal:' || id FROM journal WHERE name <> ''""",
        "tord": """
            SELECT * FROM (VALUES ('university', 0), ('faculty', 1), ('discipline', 2), ('field', 3), ('journal', 4), ('academic', 5),
                                  ('research_paper', 6)) AS t(tab, k)""",
        "own": """
            SELECT me, e, s, t, o, row_number() OVER (PARTITION BY me ORDER BY e) AS rn, count(*) OVER (PARTITION BY me) AS n
            FROM (SELECT DISTINCT me, rel || ':' || s || ':' || t AS e, s, t, CASE WHEN s = me THEN t ELSE s END AS o FROM rawedge) y""",
        "load0": "SELECT q, nid FROM gseed WHERE nid IN (SELECT nid FROM present)",
        "ref1": """
            SELECT q, nid, row_number() OVER (PARTITION BY q ORDER BY k, raw, rn) AS place FROM (
                SELECT l.q, w.o AS nid, k, substr(l.nid, strpos(l.nid, ':') + 1) AS raw, w.rn,
                       row_number() OVER (PARTITION BY l.q, w.o ORDER BY k, substr(l.nid, strpos(l.nid, ':') + 1), w.rn) AS one
                FROM load0 l JOIN own w ON w.me = l.nid AND w.rn <= 20 JOIN tord ON tab = split_part(l.nid, ':', 1)
                WHERE NOT EXISTS (SELECT 1 FROM gseed g WHERE g.q = l.q AND g.nid = w.o)) z WHERE one = 1""",
        "ok1": "SELECT q, nid FROM ref1 WHERE place <= 49",
        "load1": "SELECT q, nid FROM ok1 WHERE nid IN (SELECT nid FROM present)",
        "room2": "SELECT q, least(49 - count(*), 100 - count(*)) AS room FROM ok1 GROUP BY q",
        "ref2": """
            SELECT q, nid, row_number() OVER (PARTITION BY q ORDER BY k, raw, rn) AS place FROM (
                SELECT l.q, w.o AS nid, k, substr(l.nid, strpos(l.nid, ':') + 1) AS raw, w.rn,
                       row_number() OVER (PARTITION BY l.q, w.o ORDER BY k, substr(l.nid, strpos(l.nid, ':') + 1), w.rn) AS one
                FROM load1 l JOIN own w ON w.me = l.nid AND w.rn <= 20 JOIN tord ON tab = split_part(l.nid, ':', 1)
                WHERE NOT EXISTS (SELECT 1 FROM gseed g WHERE g.q = l.q AND g.nid = w.o)
                AND NOT EXISTS (SELECT 1 FROM ok1 g WHERE g.q = l.q AND g.nid = w.o)) z WHERE one = 1""",
        "ok2": "SELECT r.q, r.nid FROM ref2 r JOIN room2 ON room2.q = r.q WHERE place <= room",
        "load2": "SELECT q, nid FROM ok2 WHERE nid IN (SELECT nid FROM present)",
        "gnode": "SELECT q, nid FROM load0 UNION ALL SELECT q, nid FROM load1 UNION ALL SELECT q, nid FROM load2",
        "gedge": "SELECT DISTINCT g.q, w.e, w.s, w.t FROM gnode g JOIN own w ON w.me = g.nid AND w.rn <= 20",
        "gcut": """
            SELECT g.q FROM gnode g JOIN own w ON w.me = g.nid WHERE w.n > 20 UNION SELECT q FROM ref1 WHERE place > 49
            UNION SELECT r.q FROM ref2 r JOIN room2 ON room2.q = r.q WHERE place > room""",
        "known": "SELECT q, nid FROM gnode UNION SELECT q, nid FROM gseed",
        "adj": """
            SELECT q, node, other, e, row_number() OVER (PARTITION BY q, node ORDER BY e) AS rn, count(*) OVER (PARTITION BY q, node) AS n
            FROM (SELECT q, s AS node, t AS other, e FROM gedge UNION ALL SELECT q, t, s, e FROM gedge) z""",
        "walk1": """
            SELECT a.q, a.other AS nid, min(a.e) AS e1 FROM adj a JOIN gseed g ON g.q = a.q AND g.nid = a.node
            JOIN known k ON k.q = a.q AND k.nid = a.other WHERE a.rn <= 20 AND a.other <> g.nid GROUP BY ALL""",
        "event2": """
            SELECT a.q, a.other AS nid, w.e1, a.e, row_number() OVER (PARTITION BY a.q ORDER BY w.nid, a.e) AS ev
            FROM walk1 w JOIN adj a ON a.q = w.q AND a.node = w.nid AND a.rn <= 20 JOIN known k ON k.q = a.q AND k.nid = a.other
            WHERE NOT EXISTS (SELECT 1 FROM gseed g WHERE g.q = a.q AND g.nid = a.other)
            AND NOT EXISTS (SELECT 1 FROM walk1 g WHERE g.q = a.q AND g.nid = a.other)""",
        "found2": """
            SELECT q, nid, min([e1, e]) AS path, row_number() OVER (PARTITION BY q ORDER BY min(ev)) AS place FROM event2 GROUP BY q, nid""",
        "left2": "SELECT q, 49 - count(*) AS room FROM walk1 GROUP BY q",
        "gpath": """
            SELECT q, nid, [] AS path, 1e0 AS rel FROM gseed UNION ALL SELECT q, nid, [e1], 1e0 * 0.8e0 FROM walk1
            UNION ALL SELECT f.q, f.nid, f.path, 1e0 * 0.8e0 * 0.8e0 FROM found2 f JOIN left2 l ON l.q = f.q WHERE place <= room""",
        "wcut": """
            SELECT a.q FROM adj a JOIN gseed g ON g.q = a.q AND g.nid = a.node WHERE a.n > 20
            UNION SELECT a.q FROM adj a JOIN walk1 w ON w.q = a.q AND w.nid = a.node WHERE a.n > 20
            UNION SELECT f.q FROM found2 f JOIN left2 l ON l.q = f.q WHERE place > room""",
    }


SEEDED = walked("SELECT 'n' || doc_id AS q, 'research_paper:' || doc_id AS nid FROM documents")


def seed_rows(v: Views) -> DataFrame:
    return one_seed_each(v).select(
        "query_id", F.col("node_id").alias("entity_id"), F.lit(1.0).alias("rrf_score"), F.lit(1).alias("fused_rank"),
        F.array().cast("array<string>").alias("evidence_ids"))


def adjacency(v: Views) -> graph.Adjacency:
    return graph.write_adjacency(library(v), new_folder(v.spark, "adjacency"))


@check("neighbourhood_default", "SELECT q AS query_id, nid AS node_id FROM gnode", **SEEDED)
def _(v):
    return graph.neighbourhood(one_seed_each(v), {}, adjacency=adjacency(v)).nodes


@check("neighbourhood_edges_default", "SELECT q AS query_id, e AS edge_id, s AS source_id, t AS target_id FROM gedge", **SEEDED)
def _(v):
    return graph.neighbourhood(one_seed_each(v), {}, adjacency=adjacency(v)).edges.drop("relation")


@check("expand", """
    SELECT q AS query_id, nid AS target_id, 'research_paper:' || substr(q, 2) AS seed_id, array_to_string(path, '|') AS edge_ids,
           round(rel, 6) AS relevance, q IN (SELECT q FROM wcut) AS truncated FROM gpath""", **SEEDED)
def _(v):
    near = graph.neighbourhood(one_seed_each(v), library(v))
    return graph.expand(seed_rows(v), near.nodes, near.edges).where("kind = 'path'").select(
        "query_id", "target_id", "seed_id", joined("edge_ids").alias("edge_ids"), rounded("relevance").alias("relevance"),
        "truncated")


@check("truncated_default", """
    SELECT q AS query_id, q IN (SELECT q FROM wcut) OR q IN (SELECT q FROM gcut) AS truncated FROM gseed""", **SEEDED)
def _(v):
    near = graph.neighbourhood(one_seed_each(v), {}, adjacency=adjacency(v))
    paths = graph.expand(seed_rows(v), near.nodes, near.edges)
    return graph.truncation_flag(paths, near.truncated, one_seed_each(v))


@check("prefer_path", """
    SELECT k AS target_id, split_part(best, ';', 2) AS edge_ids, rel AS relevance FROM (
        SELECT l_partkey AS k, max(l_quantity) AS rel,
               min(CASE WHEN l_quantity = mx THEN ';' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') END) AS best
        FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey) AS mx FROM lineitem) y GROUP BY l_partkey) z""")
def _(v):
    paths = v("lineitem").select(
        F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("relevance"),
        F.array(F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("edge_ids"))
    return graph.prefer_path(paths, ["target_id"]).select(
        "target_id", joined("edge_ids").alias("edge_ids"), "relevance")


@check("coauthors", """
    SELECT CAST(a.academic_no AS VARCHAR) AS academic_id, CAST(b.academic_no AS VARCHAR) AS coauthor_id,
           count(*) AS n_papers
    FROM authorship a JOIN authorship b ON a.paper_no = b.paper_no AND a.academic_no <> b.academic_no GROUP BY ALL""")
def _(v):
    links = v("authorship").select(
        F.col("paper_no").cast("string").alias("paper_id"), F.col("academic_no").cast("string").alias("academic_id"))
    return graph.coauthors(links)
