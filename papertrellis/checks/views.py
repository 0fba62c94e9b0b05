"""Scholarly views over the given tables.

The tables carry no scholarly data, so papers, academics and their relations
are derived from orders, line items, parts, documents and the rest by integer
arithmetic. The view text is plain SQL that both engines run; only array
syntax differs and is filled in per engine:

``{arr}(a, b)``    array literal            ``{agg}x{/agg}``  sorted array of a group
``{sfx}``          turns bigint into text
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    # --- works corpus: orders are papers, part/order pairs are academics ---
    "authorship": """
        SELECT DISTINCT l_orderkey AS paper_no, l_partkey * 50 + l_orderkey % 50 AS academic_no
        FROM lineitem""",
    "first_part": """
        SELECT l_orderkey, MIN(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey""",
    "paper_authors": """
        SELECT paper_no, {agg}academic_no{/agg} AS academic_nos FROM authorship GROUP BY paper_no""",
    "research_paper": """
        SELECT CAST(o.o_orderkey AS STRING) AS id,
               COALESCE(p.p_name, 'untitled') || ' ' || CAST(o.o_orderkey AS STRING) AS name,
               CAST(o.o_orderdate AS DATE) AS publication_date,
               CAST(o.o_orderkey % 40 + 1 AS STRING) AS volume,
               CASE o.o_orderkey % 5 WHEN 0 THEN '1-2' WHEN 1 THEN ' 7 ' WHEN 2 THEN 'S1'
                    WHEN 3 THEN CAST(o.o_orderkey % 12 AS STRING) END AS issue,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'None-10' WHEN 1 THEN '3-9' WHEN 2 THEN '' END AS page_numbers,
               CASE WHEN o.o_orderkey % 3 <> 0 THEN '10.1234/p' || CAST(o.o_orderkey AS STRING) END AS doi,
               o.o_orderstatus = 'O' AS is_open_access,
               CASE WHEN o.o_orderstatus = 'O'
                    THEN 'https://oa.example.org/' || CAST(o.o_orderkey AS STRING) END AS open_access_url,
               CASE WHEN o.o_orderkey % 4 = 0
                    THEN 'https://www.example.org/p/' || CAST(o.o_orderkey AS STRING) END AS primary_url,
               o.o_orderpriority AS publication_type,
               CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
                    ELSE CAST(FLOOR(o.o_totalprice / 1000) AS BIGINT) END AS incoming_citation_count,
               {arr}('topic ' || CAST(o.o_custkey % 23 AS STRING), COALESCE(p.p_type, 'MISC')) AS keywords,
               {arr}(CAST((o.o_orderkey * 7 + 1) % c.n AS STRING),
                     CAST((o.o_orderkey * 13 + 5) % c.n AS STRING)) AS outgoing_citations,
               CAST(o.o_custkey % 6 AS STRING) AS publisher_id,
               CAST(o.o_custkey AS STRING) AS journal_id,
               {arr}(CAST(o.o_custkey % 25 AS STRING), CAST(o.o_orderkey % 25 AS STRING)) AS university_ids,
               {arr}(CAST(o.o_custkey % 7 AS STRING)) AS faculty_ids,
               CAST(o.o_custkey % 97 AS STRING) AS field_id,
               {strs}a.academic_nos{/strs} AS academic_ids,
               o.o_orderkey AS paper_no
        FROM orders o
        CROSS JOIN (SELECT COUNT(*) AS n FROM orders) c
        LEFT JOIN first_part f ON f.l_orderkey = o.o_orderkey
        LEFT JOIN part p ON p.p_partkey = f.partkey
        LEFT JOIN paper_authors a ON a.paper_no = o.o_orderkey""",
    "academic_papers": """
        SELECT academic_no, {agg}paper_no{/agg} AS paper_nos FROM authorship GROUP BY academic_no""",
    "academic": """
        SELECT CAST(s.academic_no AS STRING) AS id,
               COALESCE(p.p_name, 'someone') || ' ' || CAST(s.academic_no AS STRING) AS name,
               p.p_type AS academic_position,
               CASE WHEN s.academic_no % 3 <> 0
                    THEN 'https://people.example.edu/' || CAST(s.academic_no AS STRING) END AS profile_url,
               CASE WHEN s.academic_no % 5 = 0
                    THEN 'https://orcid.org/' || CAST(s.academic_no AS STRING) END AS orcid_url,
               {strs}s.paper_nos{/strs} AS research_paper_ids,
               {arr}(CAST(s.academic_no % 25 AS STRING), CAST(s.academic_no % 24 AS STRING)) AS university_ids,
               {arr}(CAST(s.academic_no % 29 AS STRING)) AS discipline_ids,
               {arr}(CAST(s.academic_no % 97 AS STRING), CAST((s.academic_no * 3) % 97 AS STRING)) AS field_ids,
               {arr}(p.p_brand, p.p_type) AS research_interests,
               {arr}(p.p_name) AS areas_of_expertise,
               s.academic_no AS academic_no
        FROM academic_papers s
        LEFT JOIN part p ON p.p_partkey = CAST(FLOOR(s.academic_no / 50) AS BIGINT)""",
    "university": """
        SELECT CAST(n.n_nationkey AS STRING) AS id, n.n_name AS name, r.r_name AS country_code,
               'https://ror.org/' || CAST(n.n_nationkey AS STRING) AS ror_url, 'education' AS type,
               'https://openalex.org/I' || CAST(n.n_nationkey AS STRING) AS openalex_id
        FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "faculty": """
        SELECT DISTINCT CAST(o_custkey % 7 AS STRING) AS id,
               'Faculty of Studies ' || CAST(o_custkey % 7 AS STRING) AS name FROM orders""",
    "discipline": """
        SELECT DISTINCT CAST(o_custkey % 29 AS STRING) AS id,
               'Discipline ' || CAST(o_custkey % 29 AS STRING) AS name,
               CAST(o_custkey % 29 % 7 AS STRING) AS faculty_id FROM orders""",
    "field": """
        SELECT DISTINCT CAST(o_custkey % 97 AS STRING) AS id,
               'Research Area ' || CAST(o_custkey % 97 AS STRING) AS name,
               CAST(o_custkey % 97 % 29 AS STRING) AS discipline_id FROM orders""",
    "publisher": """
        SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name FROM region""",
    "journal": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, c_mktsegment AS type,
               'ISSN-' || CAST(c_custkey AS STRING) AS issn, CAST(c_nationkey % 6 AS STRING) AS publisher_id
        FROM customer""",
    "score": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey AS STRING) AS research_paper_id,
               CAST(o_totalprice / 390001 AS STRING) AS paper_authority_score,
               CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE CAST((o_orderkey % 100) / 80e0 AS STRING) END
                   AS academic_authority_score,
               CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST((o_custkey % 50) / 50e0 AS STRING) END
                   AS citation_influence_score,
               CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST((o_custkey % 20) / 19e0 AS STRING) END
                   AS author_authority_score,
               CASE WHEN o_orderkey % 4 <> 0 THEN CAST((o_orderkey % 10) / 9e0 AS STRING) END
                   AS journal_authenticity_score,
               {strs}a.academic_nos{/strs} AS academic_ids,
               CAST(o_custkey AS STRING) AS journal_id
        FROM orders LEFT JOIN paper_authors a ON a.paper_no = o_orderkey
        UNION ALL
        SELECT 'x' || CAST(o_orderkey AS STRING), CAST(o_orderkey AS STRING), '0.25', '0.75', '0.5', 'null', NULL,
               {arr}(CAST(o_custkey AS STRING)), CAST(o_custkey AS STRING)
        FROM orders WHERE o_orderstatus = 'P'""",
    # --- text corpus: documents are publications, parts are researchers ---
    "lib_paper": """
        SELECT CAST(d.doc_id AS STRING) AS id, d.text AS name,
               DATE '1999-03-01' + CAST((d.doc_id * 37) % 9000 AS INT) AS publication_date,
               CASE WHEN d.doc_id % 3 <> 0 THEN '10.5555/d' || CAST(d.doc_id AS STRING) END AS doi,
               d.doc_id % 2 = 0 AS is_open_access,
               CASE WHEN d.doc_id % 2 = 0 THEN 'https://oa.example.org/d' || CAST(d.doc_id AS STRING) END
                   AS open_access_url,
               CASE WHEN d.doc_id % 5 = 0 THEN 'http://www.example.org/d' || CAST(d.doc_id AS STRING)
                    WHEN d.doc_id % 5 < 3 THEN 'https://www.example.org/d' || CAST(d.doc_id AS STRING) END
                   AS primary_url,
               d.source AS publication_type,
               {arr}(d.lang, d.source) AS keywords,
               {arr}(CAST((d.doc_id * 7 + 1) % c.n AS STRING),
                     CAST((d.doc_id * 13 + 5) % c.n AS STRING)) AS outgoing_citations,
               CASE WHEN d.doc_id % 6 <> 0 THEN CAST(d.doc_id % 50 AS STRING) END AS journal_id,
               {arr}(CAST(d.doc_id % 25 AS STRING)) AS university_ids,
               {arr}(CAST(d.doc_id % 7 AS STRING)) AS faculty_ids,
               {arr}(CAST(d.doc_id % c.m AS STRING), CAST((d.doc_id * 3 + 1) % c.m AS STRING)) AS academic_ids
        FROM documents d
        CROSS JOIN (SELECT (SELECT COUNT(*) FROM documents) AS n, (SELECT COUNT(*) FROM part) AS m) c""",
    "lib_academic": """
        SELECT CAST(p_partkey AS STRING) AS id, p_name AS name, p_type AS academic_position,
               CASE WHEN p_partkey % 3 <> 0
                    THEN 'https://people.example.edu/' || CAST(p_partkey AS STRING) END AS profile_url,
               CASE WHEN p_partkey % 5 = 0
                    THEN 'https://orcid.org/' || CAST(p_partkey AS STRING) END AS orcid_url,
               {arr}(CAST(p_partkey % c.n AS STRING)) AS research_paper_ids,
               {arr}(CAST(p_size % 25 AS STRING)) AS university_ids,
               {arr}(CAST(p_partkey % 29 AS STRING)) AS discipline_ids,
               {arr}(CAST(p_partkey % 97 AS STRING)) AS field_ids
        FROM part CROSS JOIN (SELECT COUNT(*) AS n FROM documents) c""",
    "lib_score": """
        SELECT 's' || CAST(d.doc_id AS STRING) AS id, CAST(d.doc_id AS STRING) AS research_paper_id,
               CASE WHEN d.doc_id % 4 <> 0 THEN CAST((d.doc_id % 21) / 20e0 AS STRING) END AS paper_authority_score,
               CAST((d.doc_id % 16) / 15e0 AS STRING) AS academic_authority_score,
               CASE WHEN d.doc_id % 9 <> 0 THEN CAST((d.doc_id % 31) / 30e0 AS STRING) END AS citation_influence_score,
               CASE WHEN d.doc_id % 8 <> 0 THEN CAST((d.doc_id % 11) / 10e0 AS STRING) END AS author_authority_score,
               CASE WHEN d.doc_id % 3 <> 0 THEN CAST((d.doc_id % 13) / 12e0 AS STRING) END AS journal_authenticity_score,
               {arr}(CAST(d.doc_id % c.m AS STRING)) AS academic_ids, CAST(NULL AS STRING) AS journal_id
        FROM documents d CROSS JOIN (SELECT COUNT(*) AS m FROM part) c""",
    "lib_query": """
        SELECT 'q' || CAST(item_id AS STRING) AS query_id,
               CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Latest ' || text ELSE 'classic ' || text END AS text,
               DATE '2024-01-01' AS as_of, item_id
        FROM benchmark""",
    "evidence": """
        SELECT 'e' || CAST(l.doc_id AS STRING) AS evidence_id,
               'research_paper:' || CAST(l.doc_id AS STRING) AS entity_id,
               'https://proof.example.org/' || CAST(l.doc_id AS STRING) AS source_url,
               d.source || ' ' || d.lang AS excerpt,
               CASE WHEN l.toxic = 1 THEN 0.5 ELSE 1.0 END AS confidence
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1""",
    # --- landed works: one work per order, authors from its line items ---
    "work_topic": """
        SELECT o_orderkey AS work_seq, 'https://openalex.org/W' || CAST(o_orderkey AS STRING) AS work_id,
               CASE WHEN o_custkey % 50 <> 0 THEN 'Domain ' || CAST(o_custkey % 7 AS STRING) END AS domain,
               'Discipline ' || CAST(o_custkey % 29 AS STRING) AS discipline,
               'Subfield ' || CAST(o_custkey % 97 AS STRING) AS subfield,
               CASE WHEN o_orderkey % 6 <> 0 THEN 'ISSN-' || CAST(o_custkey AS STRING) END AS issn,
               'Journal ' || CAST(o_orderkey AS STRING) AS journal_name,
               CAST(o_orderdate AS DATE) AS publication_date,
               CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 300 AS STRING) END AS first_page,
               CASE WHEN o_orderkey % 8 <> 1 THEN CAST(o_orderkey % 300 + 9 AS STRING) END AS last_page,
               o_orderpriority AS raw_type, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS cited_by_count,
               o_orderstatus AS status, o_custkey AS cust
        FROM orders""",
    "work_author": """
        SELECT l_orderkey AS work_seq,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS a_pos,
               CASE WHEN l_partkey % 19 <> 0
                    THEN 'Author ' || CAST(l_partkey * 50 + l_orderkey % 50 AS STRING) END AS author_name,
               CASE WHEN l_partkey % 5 = 0
                    THEN 'https://orcid.org/' || CAST(l_partkey * 50 + l_orderkey % 50 AS STRING) END AS orcid,
               l_suppkey % 25 AS uni_a, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 25 END AS uni_b
        FROM lineitem""",
    "work_institution": """
        SELECT a.work_seq, a.a_pos, 0 AS i_pos, n.n_name AS uni_name,
               'https://openalex.org/I' || CAST(n.n_nationkey AS STRING) AS uni_id,
               'C' || CAST(a.work_seq % 3 AS STRING) AS country_code
        FROM work_author a JOIN nation n ON n.n_nationkey = a.uni_a
        UNION ALL
        SELECT a.work_seq, a.a_pos, 1, n.n_name, 'https://openalex.org/I' || CAST(n.n_nationkey AS STRING),
               'C' || CAST(a.work_seq % 3 AS STRING)
        FROM work_author a JOIN nation n ON n.n_nationkey = a.uni_b""",
    "landed_work": """
        SELECT o_custkey % 12 AS source_seq, o_orderkey AS seq,
               'https://openalex.org/W' || CAST(o_orderkey AS STRING) AS id, o_orderpriority AS title FROM orders
        UNION ALL
        SELECT (o_custkey + 5) % 12, o_orderkey, 'https://openalex.org/W' || CAST(o_orderkey AS STRING),
               o_orderpriority FROM orders WHERE o_orderkey % 3 = 0""",
    # --- one staff page per part ---
    "profile_page": """
        SELECT p_partkey AS page_id, 'https://staff.example.edu/people/' || CAST(p_partkey AS STRING) AS url,
               '<html><head><style>h1{}</style><script>var a="<h1>no</h1>";</script></head><body><!-- <h1>old</h1> --><nav>'
               || '<a href="/people/' || CAST(p_partkey % 50 AS STRING) || '?tab=1">Next</a><a href="/about">About</a></nav><h1>'
               || CASE p_partkey % 4 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'Associate Professor ' WHEN 2 THEN 'professor ' ELSE '' END
               || p_name || ' &amp;  <b>' || CAST(p_partkey AS STRING) || '</b></h1><p>'
               || CASE p_partkey % 5 WHEN 0 THEN 'Senior Lecturer in ' || p_type WHEN 1 THEN 'PhD student'
                       WHEN 2 THEN 'Professor' WHEN 3 THEN 'School manager' ELSE '' END
               || '</p>' || CASE WHEN p_partkey % 3 = 0 THEN '<h3>Interests</h3><p>' ELSE '<h2>Research Interests</h2><p>' END
               || p_type || ', ' || p_brand || ' Read more</p><ul><li>Area ' || CAST(p_partkey % 13 AS STRING) || '; area '
               || CAST(p_partkey % 13 AS STRING) || '</li></ul><h2>Biography</h2><p>My research interests include '
               || p_name || ' and ' || p_type || ', topic ' || CAST(p_partkey % 7 AS STRING) || '. More.</p>'
               || '<h2>Research fields</h2><p>4611 ' || p_type || '</p><p>46 Computing ' || CAST(p_partkey % 5 AS STRING)
               || '</p><p>Section</p>' || CASE WHEN p_partkey % 2 = 0 THEN
                    '<h2>Positions</h2><div>Acting Senior Research Fellow - Unit ' || CAST(p_partkey % 9 AS STRING)
                    || ' School of Things</div>' ELSE '' END
               || '<h2>Tags</h2><span class="keyword">' || p_brand || '</span> <span class="x concept">7 Clean Energy</span>'
               || '<div class="person-details">' || p_type || ' staff</div>'
               || CASE p_partkey % 3 WHEN 0 THEN '<a href="https://orcid.org/0000-0001-0000-'
                    || LPAD(CAST(p_partkey % 10000 AS STRING), 4, '0') || '">id</a>'
                    WHEN 1 THEN '<a href="//orcid.org/0000-0002-0000-' || LPAD(CAST(p_partkey % 1000 AS STRING), 3, '0')
                    || 'X">id</a>' ELSE '<p>ORCID 0000-0003-0000-000X</p>' END
               || '</body></html>' AS html
        FROM part""",
    # --- collected profiles: suppliers and customers under many spellings ---
    "profile": """
        SELECT k AS seq,
               CASE WHEN k % 41 = 0 THEN NULL
                    WHEN k % 2 = 0 THEN ' Dr. Per-Son ' || CAST(k % g.n AS STRING) || ' '
                    ELSE 'dr per son ' || CAST(k % g.n AS STRING) END AS name,
               CASE k % 6 WHEN 0 THEN 'Professor' WHEN 1 THEN '' WHEN 2 THEN 'PhD Candidate'
                    WHEN 3 THEN 'Senior Lecturer' WHEN 4 THEN NULL ELSE 'Research Assistant' END AS academic_position,
               CASE WHEN k % 4 = 0 THEN NULL
                    WHEN k % 4 = 1 THEN 'https://people.example.edu/P' || CAST(k % (g.n * 2) AS STRING)
                    ELSE ' https://people.example.edu/p' || CAST(k % (g.n * 2) AS STRING) END AS profile_url,
               CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL
                    ELSE 'https://orcid.org/' || CAST(k % (g.n * 3) AS STRING) END AS orcid_url,
               CASE WHEN k % 7 = 0 THEN NULL ELSE 'NATION_' || CAST(k % 9 AS STRING) END AS university_name,
               CASE WHEN k % 3 = 0 THEN NULL
                    ELSE {arr}('Topic ' || CAST(k % 11 AS STRING), ' topic ' || CAST(k % 11 AS STRING),
                               'Area ' || CAST(k % 13 AS STRING)) END AS research_interests,
               CASE WHEN k % 10 < 4 THEN {arr}('Skill ' || CAST(k % 6 AS STRING))
                    WHEN k % 10 = 4 THEN {arr}(t) END AS areas_of_expertise
        FROM (SELECT s_suppkey AS k, s_name AS t FROM supplier
              UNION ALL
              SELECT c.c_custkey + m.n, c.c_mktsegment FROM customer c
              CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) m) people
        CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) g""",
}

#: Views whose rows are much longer than those of the table they are made from: that table's key, and rows of it a task takes. A page of
#: text comes from 60 bytes, so a scan of one task would hold them all; dealt by key, pages stay where they are for all that groups by page.
SPREAD = {"profile_page": ("part", "p_partkey", 4000)}

_SPARK = {
    "{arr}": "array", "{agg}": "sort_array(collect_list(", "{/agg}": "))",
    "{strs}": "transform(", "{/strs}": ", x -> CAST(x AS STRING))",
}
_DUCK = {
    "{arr}": "list_value", "{agg}": "list_sort(list(", "{/agg}": "))",
    "{strs}": "CAST(", "{/strs}": " AS VARCHAR[])",
}


def _fill(text: str, marks: dict[str, str]) -> str:
    for mark, value in marks.items():
        text = text.replace(mark, value)
    return text


def _needed(text: str, known: dict[str, str]) -> list[str]:
    """Views a text refers to, dependencies first."""
    out: list[str] = []
    seen: set[str] = set()

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", body)):
            if word in known and word not in seen:
                seen.add(word)
                visit(known[word])
                out.append(word)

    visit(text)
    return out


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle SQL: the body behind the CTEs of every view it names."""
    known = {**VIEWS, **(extra or {})}
    ctes = [f"{name} AS ({_fill(known[name], _DUCK)})" for name in _needed(body, known)]
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    body = _fill(body, _DUCK).strip()
    if head and body.upper().startswith("WITH "):
        return head.rstrip() + ", " + body[5:]
    return head + body


class Views:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tasks(self, view: str) -> int:
        """Into how many tasks the rows of a view of SPREAD are dealt."""
        base, _key, rows = SPREAD[view]
        return max(1, -(-self.base(base).count() // rows))

    def dealt(self, name: str, used: list[str]) -> str:
        """The hint that deals a base table's rows out for the views of SPREAD."""
        for view, (base, key, _rows) in SPREAD.items():
            if view in used and base == name:
                return f"/*+ REPARTITION({self.tasks(view)}, {key}) */ "
        return ""

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        used = _needed(name, VIEWS)
        text = "".join(VIEWS[v] for v in used)
        ctes = [
            f"{b} AS (SELECT {self.dealt(b, used)}* FROM parquet.`{self.folder}/{b}.parquet`)"
            for b in BASE
            if re.search(rf"\b{b}\b", text)
        ]
        ctes += [f"{v} AS ({_fill(VIEWS[v], _SPARK)})" for v in used]
        return self.spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")
