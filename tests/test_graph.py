"""Bounded fetching equals a step-by-step restatement; facts about the walk."""

import random

import pytest
from pyspark.sql import functions as F

from papertrellis.operators import graph

ORDER = graph.TABLE_ORDER


def tables(spark, academics, papers, universities):
    a = spark.createDataFrame(
        [(i, f"A {i}", ps, us, [], []) for i, (ps, us) in academics.items()],
        "id string, name string, research_paper_ids array<string>, university_ids array<string>, "
        "discipline_ids array<string>, field_ids array<string>")
    p = spark.createDataFrame(
        [(i, f"P {i}", au, ci, us, [], None) for i, (au, ci, us) in papers.items()],
        "id string, name string, academic_ids array<string>, outgoing_citations array<string>, university_ids array<string>, "
        "faculty_ids array<string>, journal_id string")
    u = spark.createDataFrame([(i, n) for i, n in universities.items()], "id string, name string")
    return {"academic": a, "research_paper": p, "university": u}


def stated(node, academics, papers):
    table, raw = node.split(":")
    out = set()
    if table == "academic" and raw in academics:
        ps, us = academics[raw]
        out |= {(f"AUTHORED:{node}:research_paper:{p}", f"research_paper:{p}") for p in ps}
        out |= {(f"AFFILIATED_WITH:{node}:university:{u}", f"university:{u}") for u in us}
    if table == "research_paper" and raw in papers:
        au, ci, us = papers[raw]
        out |= {(f"AUTHORED:academic:{a}:{node}", f"academic:{a}") for a in au}
        out |= {(f"CITES:{node}:research_paper:{c}", f"research_paper:{c}") for c in ci}
        out |= {(f"PAPER_AT_UNIVERSITY:{node}:university:{u}", f"university:{u}") for u in us}
    return sorted(out)


def stepwise(seeds, academics, papers, universities, b):
    exists = lambda n: n.split(":")[1] in {"academic": academics, "research_paper": papers, "university": universities}[n.split(":")[0]]
    frontier, scheduled, fetched, cut, loaded, edges = set(seeds), set(seeds), 0, False, set(), set()
    for depth in range(b.max_hops + 1):
        following = set()
        for node in sorted(frontier, key=lambda n: (ORDER.index(n.split(":")[0]), n.split(":")[1])):
            if not exists(node):
                continue
            loaded.add(node)
            mine = stated(node, academics, papers)
            cut |= len(mine) > b.max_neighbors
            for edge, other in mine[: b.max_neighbors]:
                edges.add(edge)
                if depth == b.max_hops or other in scheduled:
                    continue
                if fetched >= b.max_relationships or len(scheduled) >= b.max_entities:
                    cut = True
                    continue
                scheduled.add(other)
                following.add(other)
                fetched += 1
        frontier = following
    return loaded, edges, cut


@pytest.mark.parametrize("seed,budget", [
    (1, graph.Budget()), (2, graph.Budget(max_neighbors=2, max_entities=6, max_relationships=4)),
    (3, graph.Budget(max_entities=5, max_relationships=9)),
])
def test_neighbourhood_matches_stepwise(spark, seed, budget):
    rnd = random.Random(seed)
    ids = [str(i) for i in range(14)]
    pick = lambda k: rnd.sample(ids, rnd.randint(0, k))
    academics = {i: (pick(3), pick(2)) for i in ids[:10]}
    papers = {i: (pick(3), pick(3), pick(2)) for i in ids[:12]}
    universities = {i: f"U {i}" for i in ids[:8]}
    queries = {f"q{i}": sorted({f"research_paper:{rnd.choice(ids)}", f"academic:{rnd.choice(ids)}"}) for i in range(6)}
    seeds = spark.createDataFrame([(q, s) for q, ss in queries.items() for s in ss], "query_id string, node_id string")
    near = graph.neighbourhood(seeds, tables(spark, academics, papers, universities), budget)
    nodes, edges = {}, {}
    for r in near.nodes.collect():
        nodes.setdefault(r[0], set()).add(r[1])
    for r in near.edges.collect():
        edges.setdefault(r[0], set()).add(r["edge_id"])
    cut = {r[0] for r in near.truncated.collect()}
    for q, ss in queries.items():
        want = stepwise(ss, academics, papers, universities, budget)
        assert nodes.get(q, set()) == want[0]
        assert edges.get(q, set()) == want[1]
        assert (q in cut) == want[2]


def walk(spark, seeds, nodes, edges, budget, limit=10):
    s = spark.createDataFrame([("q", i, float(x), n, []) for n, (i, x) in enumerate(seeds, 1)],
                              "query_id string, entity_id string, rrf_score double, fused_rank int, evidence_ids array<string>")
    n = spark.createDataFrame([("q", i) for i in nodes], "query_id string, node_id string")
    e = spark.createDataFrame([("q", f"{r}:{a}:{b}", a, b, r) for a, r, b in edges],
                              "query_id string, edge_id string, source_id string, target_id string, relation string")
    return graph.expand(s, n, e, budget, limit).collect()


def test_two_hops_reach_a_coauthor(spark):
    rows = walk(spark, [("academic:1", 1.0)], ["academic:1", "academic:2", "research_paper:1"],
                [("academic:1", "AUTHORED", "research_paper:1"), ("academic:2", "AUTHORED", "research_paper:1")], graph.Budget())
    paths = {r["target_id"]: r for r in rows if r["kind"] == "path"}
    assert len(paths["academic:2"]["edge_ids"]) == 2
    assert paths["academic:2"]["relevance"] == pytest.approx(0.64)
    assert not paths["academic:2"]["truncated"]


def test_budgets_truncate(spark):
    edges = [("p:1", "CITES", "p:2"), ("p:2", "CITES", "p:3")]
    rows = walk(spark, [("p:1", 1.0)], ["p:1", "p:2", "p:3"], edges, graph.Budget(max_entities=2))
    assert len([r for r in rows if r["kind"] == "path"]) == 2 and all(r["truncated"] for r in rows)
    rows = walk(spark, [("p:1", 1.0), ("p:3", 0.5)], ["p:1", "p:3"], [], graph.Budget(max_entities=1))
    assert [r["target_id"] for r in rows] == ["p:1"] and rows[0]["truncated"]


def test_unknown_and_weak_edges_are_skipped(spark):
    rows = walk(spark, [("p:1", 1.0)], ["p:1"], [("p:1", "CITES", "p:9"), ("p:1", "LIKES", "p:1")], graph.Budget())
    assert [r["target_id"] for r in rows] == ["p:1"]


def test_eight_relation_types(spark):
    a = spark.createDataFrame([("1", ["1"], ["u"], ["d"], ["f"])],
                              "id string, research_paper_ids array<string>, university_ids array<string>, discipline_ids array<string>, field_ids array<string>")
    p = spark.createDataFrame([("1", ["1"], ["2"], ["u"], ["y"], "j")],
                              "id string, academic_ids array<string>, outgoing_citations array<string>, university_ids array<string>, faculty_ids array<string>, journal_id string")
    out = graph.project_edges(a, p)
    assert {r["relation"] for r in out.collect()} == set(graph.RELATIONS)
    assert out.where(F.col("relation") == "AUTHORED").count() == 1


def test_stored_lists_give_the_same_neighbourhood(spark, tmp_path):
    people = spark.createDataFrame(
        [(str(i), f"P{i}", [str((i * k) % 40) for k in range(1, 1 + i % 9)], [str(i % 4)], [], [None, str(i % 3)]) for i in range(30)] + [(None, "x", ["1"], [], [], [])],
        "id string, name string, research_paper_ids array<string>, university_ids array<string>, discipline_ids array<string>, field_ids array<string>")
    papers = spark.createDataFrame(
        [(str(i), f"T{i}", [str(i % 30), str(i % 7)], [str((i + 1) % 40), str((i * 3) % 40)], [str(i % 4)], ["f"], "j") for i in range(40)],
        "id string, name string, academic_ids array<string>, outgoing_citations array<string>, university_ids array<string>, faculty_ids array<string>, journal_id string")
    tables = {"academic": people, "research_paper": papers, "university": spark.createDataFrame([("0", "U"), ("1", ""), ("2", None)], "id string, name string")}
    seeds = spark.createDataFrame([(f"q{i}", f"research_paper:{i}") for i in range(12)] + [("q1", "academic:3"), ("q2", "university:0"), ("q3", "research_paper:none")], "query_id string, node_id string")
    store = graph.write_adjacency(tables, str(tmp_path / "lists"), buckets=8)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for budget in (graph.Budget(), graph.Budget(max_hops=3, max_entities=9, max_neighbors=3), graph.Budget(max_hops=0)):
        a, b = graph.neighbourhood(seeds, tables, budget), graph.neighbourhood(seeds, {}, budget, store)
        assert rows(a.nodes) == rows(b.nodes) and rows(a.edges) == rows(b.edges) and rows(a.truncated) == rows(b.truncated)
    with pytest.raises(ValueError):
        graph.neighbourhood(seeds, {}, graph.Budget(max_neighbors=21), store)
    plan = store.load(seeds.limit(1), graph.Budget())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and plan.count("Scan parquet") == 1


def test_queries_are_walked_by_batches(spark):
    """Each query's own walk, with its proofs, though tasks are handed many queries at a time and not one call for each."""
    many = 700
    s = spark.createDataFrame([(f"q{i}", f"a:{i}", 1.0, 1, [f"s{i}"] if i % 2 else []) for i in range(many)] + [(None, "a:x", 1.0, 1, [])],
                              "query_id string, entity_id string, rrf_score double, fused_rank int, evidence_ids array<string>")
    n = spark.createDataFrame([(f"q{i}", f"p:{j}") for i in range(many) for j in range(i % 3)], "query_id string, node_id string")
    e = spark.createDataFrame([(f"q{i}", f"AUTHORED:a:{i}:p:{j}", f"a:{i}", f"p:{j}", "AUTHORED", None, [f"e{j}", None] if j else None)
                               for i in range(many) for j in range(2) for _ in range(2)],
                              "query_id string, edge_id string, source_id string, target_id string, relation string, confidence double, evidence_ids array<string>")
    out = graph.expand(s, n, e)
    got = {(r["query_id"], r["target_id"]): (r["relevance"], r["evidence_ids"]) for r in out.where("kind = 'path'").collect()}
    want = {(f"q{i}", f"a:{i}"): (1.0, [f"s{i}"] if i % 2 else []) for i in range(many)} | {(None, "a:x"): (1.0, [])}
    want |= {(f"q{i}", f"p:{j}"): (0.8, ([f"s{i}"] if i % 2 else []) + (["e1", None] if j else [])) for i in range(many) for j in range(i % 3)}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
