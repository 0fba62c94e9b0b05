"""Hand-computed facts about text rules, urls, retrieval, fusion, ranking, evidence and curation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papertrellis.functions import text, urls
from papertrellis.functions.ids import uuid_v5
from papertrellis.operators import clean, evidence, factors, fusion, lexical, normalise, pages, ranking, resolve, scores

import uuid


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,want", [("\t a ", "a"), ("  ", ""), ("a b", "a b")])
def test_strip(spark, raw, want):
    assert one(spark, raw, text.strip) == want


def test_fold_and_tokens(spark):
    assert one(spark, "Straße ΣΑΣ", text.fold) == "strasse σασ".replace("ς", "σ")
    assert one(spark, "ç9 Robotics-Research", text.tokens) == ["9", "robotics", "research"]
    assert one(spark, None, text.tokens) == []


@pytest.mark.parametrize("raw,want", [("0.4", 0.4), ("-1", 0.0), ("7", 1.0), ("null", None), ("", None), ("x", None), ("nan", 1.0), ("5d", None)])
def test_clamp(spark, raw, want):
    assert one(spark, raw, text.clamp_score) == want


@pytest.mark.parametrize("raw,want", [("3", 3.0), ("-2", 0.0), ("inf", None), ("nan", None), ("abc", None), (None, None)])
def test_count(spark, raw, want):
    assert one(spark, raw, text.parse_count) == want


def test_term_counts(spark):
    got = one(spark, "b a b", lambda c: text.term_counts(text.tokens(c)))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 1), ("b", 2)]
    assert one(spark, "", lambda c: text.term_counts(text.tokens(c))) == []


@pytest.mark.parametrize("raw,want", [
    ("https://doi.org/https://doi.org/10.1234/AbC.", "https://doi.org/10.1234/AbC"), ("doi: 10.1234/a%2Fb", "https://doi.org/10.1234/a/b"),
    ("10.1234/a+b", "https://doi.org/10.1234/a+b"), ("not-a-doi", None), ("10.12/x", None),
])
def test_doi(spark, raw, want):
    assert one(spark, raw, urls.normalize_doi) == want


@pytest.mark.parametrize("raw,want", [
    ("https://Example.org", "https://example.org/"), ("http://example.org/", None), ("https://localhost/x", None),
    ("https://192.168.1.1/", None), ("https://8.8.8.8/a?b=1#c", "https://8.8.8.8/a?b=1"), ("https://[::1]/", None),
    ("https://[2606:4700::1]/", "https://[2606:4700::1]/"), ("https://u:p@example.org/", None), ("https://example.org:443/a", "https://example.org/a"),
    ("https://example.org:8443/a", "https://example.org:8443/a"), ("https://example.org:99999/", None), ("https://intranet/", None),
])
def test_public_url(spark, raw, want):
    assert one(spark, raw, urls.validate_public_https_url) == want


def test_uuid(spark):
    ns = "8f87b47c-c46f-4bcf-9404-b53674377058"
    assert one(spark, "paper:ü", lambda c: uuid_v5(ns, c)) == str(uuid.uuid5(uuid.UUID(ns), "paper:ü"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, doi string, publication_type string")


def plan(spark, *rows, **kw):
    df = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(rows)], "query_id string, text string")
    return lexical.plan_queries(df.withColumn("as_of", F.to_date(F.lit("2024-01-01"))), **kw)


def test_plan_profiles(spark):
    got = [r["profile"] for r in plan(spark, "Recent work", "concurrent systems", "seminal", "robots").orderBy("query_id").collect()]
    assert got == ["RECENT", "RECENT", "FOUNDATIONAL", "GENERAL"]
    with pytest.raises(Exception):
        plan(spark, "  ").collect()


def test_substring_match_and_star(spark):
    corpus = lexical.corpus_documents(docs(spark, [("1", "Robotics Research", None, None), ("2", "Trees", None, None), ("3", "été, ici", None, None)]), None)
    hits = lexical.retrieve(plan(spark, "BOTICS RESE", "*", "robotics", "é", "tree"), corpus).collect()
    by = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        by.setdefault(h["query_id"], []).append((h["entity_id"][-1], h["raw_score"] == 1.0))
    assert by["q0"] == [("1", True)]
    assert [i for i, _ in by["q1"]] == ["1", "2", "3"]
    assert by["q2"][0][0] == "1" and not by["q2"][0][1]
    assert by["q3"] == [("3", True)]
    assert by["q4"] == [("2", True)]


def test_fusion_prefers_shared(spark):
    hits = spark.createDataFrame(
        [("q", "shared", "lexical", 1, 3.0), ("q", "lex", "lexical", 2, 1.0), ("q", "den", "dense", 1, 0.9), ("q", "shared", "dense", 2, 0.8)],
        "query_id string, entity_id string, channel string, rank int, raw_score double")
    rows = fusion.rrf(hits).orderBy("fused_rank").collect()
    assert rows[0]["entity_id"] == "shared" and rows[0]["rrf_score"] == 1.0
    assert rows[0]["channel_ranks"] == {"dense": 2, "lexical": 1} and rows[0]["channel_raw_scores"] == {"dense": 0.8, "lexical": 3.0}
    assert rows[0]["raw_rrf_score"] == pytest.approx(1 / 61 + 1 / 62)


def candidate(spark, rows):
    entities = spark.createDataFrame(
        [(i, k, i, d, None, pa, pa is not None, aa, ja, ja is not None, None, None, ev, [], "q", 0.5, 0.0)
         for i, k, d, pa, aa, ja, ev in rows],
        "entity_id string, kind string, label string, publication_date date, citation_score double, paper_authority_score double, "
        "paper_authority_reproducible boolean, author_authority_score double, journal_authenticity_score double, "
        "journal_authenticity_reproducible boolean, academic_authority_score double, academic_authority_provenance string, "
        "evidence_ids array<string>, source_urls array<string>, query_id string, retrieval_score double, graph_score double")
    return entities


def ranked(spark, rows, **q):
    query = plan(spark, "robots").withColumn("query_id", F.lit("q"))
    for k, v in q.items():
        query = query.withColumn(k, F.lit(v))
    return ranking.rank(candidate(spark, rows), query, ranking.built_in_profiles(spark)).orderBy("rank").collect()


def test_ties_gates_and_authority(spark):
    pub = "publication"
    rows = ranked(spark, [("b", pub, None, None, 0.9, None, []), ("a", pub, None, None, 0.1, None, []), ("j", pub, None, 1.0, None, 0.2, [])])
    assert [r["entity_id"] for r in rows] == ["a", "b", "j"]
    assert rows[0]["final_score"] == rows[1]["final_score"]
    assert rows[2]["gate_reasons"] == ["journal_authenticity_gate"] and rows[2]["final_score"] == 0.0
    rows = ranked(spark, [("a", pub, None, None, None, None, []), ("b", pub, None, None, None, None, ["e"]), ("u", "university", None, None, None, None, ["e"])],
                  require_evidence=True)
    assert [(r["entity_id"], r["eligible"]) for r in rows] == [("b", True), ("a", False), ("u", False)]
    assert rows[2]["gate_reasons"] == ["unsupported_ranking_kind=university"]
    with pytest.raises(Exception):
        ranked(spark, [("a", pub, None, None, None, None, [])], profile="NOPE")


def test_recency_halves(spark):
    df = spark.createDataFrame([(dt.date(2018, 1, 1), dt.date(2026, 1, 1))], "a date, b date")
    assert df.select(ranking.recency(F.col("a"), F.col("b"), F.lit(8.0))).first()[0] == pytest.approx(0.5, abs=1e-3)


def test_profile_rules(spark):
    bad = spark.sql("SELECT 'x' AS profile, 0.5D AS w_pub_retrieval, 0D AS w_pub_graph, 0D AS w_citation, 0D AS w_recency, 0D AS w_paper_authority, "
                    "1D AS w_res_retrieval, 0D AS w_res_graph, 0D AS half_life_years, 2D AS min_journal_authenticity")
    assert ranking.validate_profiles(bad).count() == 3
    assert ranking.validate_profiles(ranking.built_in_profiles(spark)).count() == 0


def test_score_means(spark):
    s = spark.createDataFrame([("1", "p", "0.6", ["a", "a"]), ("2", "p", "0.8", ["b"]), ("3", "p", "", ["a"])],
                              "id string, research_paper_id string, academic_authority_score string, academic_ids array<string>")
    for f in scores.SCORE_FIELDS:
        if f not in s.columns:
            s = s.withColumn(f, F.lit(None).cast("string"))
    assert scores.score_by_paper(s).first()["academic_authority_score"] == pytest.approx(0.7)
    assert {r[0]: r[1] for r in scores.score_by_academic(s).collect()} == pytest.approx({"a": 0.6, "b": 0.8})


def test_pack_stops_at_limit(spark):
    r = spark.createDataFrame([("q", 1, "p1", True, ["e1", "e2"]), ("q", 2, "p2", True, ["e3"]), ("q", 3, "p3", True, []), ("r", 1, "p1", False, ["e1"])],
                              "query_id string, rank int, entity_id string, eligible boolean, evidence_ids array<string>")
    e = spark.createDataFrame([("e1", "p1", "u1", "x", 1.0), ("e2", "p9", "u2", "x", 1.0), ("e3", "p2", "u3", "x", 1.0)],
                              "evidence_id string, entity_id string, source_url string, excerpt string, confidence double")
    rows = {x["query_id"]: x for x in evidence.evidence_pack(r, e, limit=1).collect()}
    assert rows["q"]["entity_ids"] == ["p1"] and [i["evidence_id"] for i in rows["q"]["items"]] == ["e1"]
    assert rows["r"]["status"] == "insufficient_evidence"
    rows = {x["query_id"]: x for x in evidence.evidence_pack(r, e).collect()}
    assert rows["q"]["entity_ids"] == ["p1", "p2", "p3"] and len(rows["q"]["items"]) == 2


def test_cohorts(spark):
    def run(rows):
        p = spark.createDataFrame(rows, "id string, publication_date string, publication_type string, incoming_citation_count string, field_id string")
        d = factors.dedupe_papers(factors.factor_inputs(p))
        return {r["paper_id"]: r for r in factors.quality_percentile(factors.citation_influence(d)).collect()}

    rows = run([(str(i), "2020-01-01", "Article", str(c), None) for i, c in enumerate([0, 1, 10, 100, 10000])])
    got = [rows[str(i)]["influence"] for i in range(5)]
    assert got[0] == 0.0 and got[4] == 1.0 and got == sorted(got)
    assert {r["i_tier"] for r in rows.values()} == {"year_type"}
    assert [rows[str(i)]["quality"] for i in range(5)] == [0.0, 0.25, 0.5, 0.75, 1.0]
    rows = run([("x", "2020", "a", "5", None)])
    assert rows["x"]["influence"] == 1.0 and rows["x"]["quality"] == 0.5 and rows["x"]["i_tier"] == "global"
    rows = run([(str(i), str(2000 + i % 2), "a", str(i), None) for i in range(6)])
    assert {r["q_tier"] for r in rows.values()} == {"year_plus_minus_one"}


def test_conflicting_duplicates_fail(spark):
    p = spark.createDataFrame([("1", "2020", "a", "1"), ("1", "2020", "a", "2")], "id string, publication_date string, publication_type string, incoming_citation_count string")
    with pytest.raises(Exception):
        factors.dedupe_papers(factors.factor_inputs(p)).collect()
    assert factors.dedupe_papers(factors.factor_inputs(p), strict=False).first()["conflict"]


def test_distribution(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (None,)], "x double")
    row = factors.factor_distribution(df, "x").first()
    assert [row[k] for k, _ in factors.QUANTILES] == pytest.approx([0, 0.25, 0.5, 0.75, 0.9, 1.0])
    row = factors.factor_distribution(df.where("x is null"), "x").first()
    assert all(row[k] is None for k, _ in factors.QUANTILES)


def test_clean_values(spark):
    assert one(spark, " 7 ", clean.clean_issue) == 7 and one(spark, "1-2", clean.clean_issue) is None
    assert one(spark, "None-3", clean.clean_page_numbers) is None and one(spark, " 1-2 ", clean.clean_page_numbers) == "1-2"


def test_names(spark):
    assert one(spark, "  José  O'Néill-Ş ", resolve.normalise_name) == "jose o neill s"


def test_merge_needs_exactly_one_profile(spark):
    base = spark.createDataFrame([("1", "Ann Lee", None, None, None), ("2", "Bo Li", "Old", None, None)],
                                 "id string, name string, academic_position string, profile_url string, orcid_url string")
    prof = spark.createDataFrame([("ann  lée", "Prof", "", None, ["x", "y"]), ("Bo Li", "A", None, None, []), ("bo li", "B", None, None, [])],
                                 "name string, academic_position string, profile_url string, orcid_url string, research_interests array<string>")
    rows = {r["id"]: r for r in resolve.merge_profiles(base, prof).collect()}
    assert rows["1"]["academic_position"] == "Prof" and rows["1"]["academic_summary"] == "x y"
    assert rows["2"]["academic_position"] == "Old" and not rows["2"]["matched"]


def test_page_rules(spark):
    html = '<h1>A/Prof Ann</h1><p>Lecturer</p><script>x="<h2>no</h2>"</script><h2>Research Interests</h2><ul><li>AI; ai, robots</li></ul><h2>Next</h2><p>z</p>'
    b = pages.page_blocks(spark.createDataFrame([(1, "https://x.org/p", html)], "page_id long, url string, html string"))
    assert pages.page_name(b).first()["name"] == "Ann"
    assert pages.resolve_interests(b).first()["interests"] == ["AI", "robots"]
    assert one(spark, "Associate Professor of PhD student affairs", pages.directory_role) is None
    assert one(spark, "Honorary Associate Professor", pages.directory_role) == "honorary associate professor"
    assert one(spark, "Her research interests include AI and robots. More", lambda c: pages.cue_interests(c, "uts")) == ["AI", "robots"]
    assert one(spark, "nothing", lambda c: pages.cue_interests(c, "unsw")) == []


def test_first_encounter_numbering(spark):
    works = spark.read.schema(__import__("papertrellis.schemas", fromlist=["WORKS"]).WORKS).json(spark.sparkContext.parallelize([
        '{"work_seq":0,"id":"W0","primary_topic":{"domain":{"display_name":"D"},"field":{"display_name":"F"},"subfield":{"display_name":"S"}},'
        '"authorships":[{"author":{"display_name":"Ann"},"institutions":[{"display_name":"U2"},{"display_name":"U1"}]},{"author":{}}]}',
        '{"work_seq":1,"id":"W1","authorships":[{"author":{"display_name":"Bo","orcid":"o"},"institutions":[]},{"author":{"display_name":"Ann"},"institutions":[{"display_name":"U1"}]}]}',
    ]))
    assert [r["name"] for r in normalise.universities_dim(works).orderBy("id").collect()] == ["U2", "U1"]
    people = normalise.academics_dim(works).orderBy("id").collect()
    assert [(r["name"], r["research_paper_ids"], r["university_ids"]) for r in people] == [("Ann", [0, 1], [0, 1]), ("Bo", [1], [])]
    papers = normalise.papers_fact(works).orderBy("id").collect()
    assert [p["academic_ids"] for p in papers] == [[0], [1, 0]]
    assert [p["faculty_ids"] for p in papers] == [[0], [1]]


def test_dense_channel_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    d, q = rng.normal(size=(300, 8)), rng.normal(size=(4, 8))
    docs_ = spark.createDataFrame([(f"d{i:03d}", r.tolist()) for i, r in enumerate(d)], "entity_id string, vector array<double>").repartition(5)
    qs = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(q)], "query_id string, vector array<double>")
    rows = lexical.dense_channel(qs, docs_, 7).collect()
    sim = (q @ d.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(d, axis=1)[None, :]
    for i in range(4):
        got = [r["entity_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == f"q{i}"]
        assert got == [f"d{j:03d}" for j in np.argsort(-sim[i])[:7]]


def test_pairs_of_a_search_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    docs = spark.range(300).select(F.concat(F.lit("d"), "id").alias("entity_id"), F.lit("publication").alias("kind"), F.lit("tree leaf").alias("text"))
    q = lexical.plan_queries(spark.createDataFrame([("a", "tree"), ("b", "leaf tree")], "query_id string, text string"))
    index = lexical.index_documents(docs)
    whole = {tuple(r) for r in lexical.bm25(q, index).collect()}
    monkeypatch.setattr(lexical, "PAIRS", 100)
    dealt = lexical.bm25(q, index)
    assert dealt.rdd.getNumPartitions() == 9  # 300 documents, three asked terms
    assert {tuple(r) for r in dealt.collect()} == whole and len(whole) == 600
