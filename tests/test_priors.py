"""The linear prior equals its definition: recompute everything without the paper, take the median."""

import math
import random
from statistics import median

import pytest

from papertrellis.operators import factors, priors

TIERS = (("field", "year", "type"), ("year", "type"), ("year",), ())


def influence(papers):
    """Definition of I over a dict id -> paper."""
    cited = {i: p for i, p in papers.items() if p["c"] is not None}
    out = {}
    for i, p in cited.items():
        for keys in TIERS:
            if any(p[k] is None for k in keys):
                continue
            group = [q["c"] for q in cited.values() if all(q[k] == p[k] for k in keys)]
            if len(group) >= 5 or not keys:
                top = max(group)
                out[i] = 0.0 if top <= 0 else math.log1p(p["c"]) / math.log1p(top)
                break
    return out


def authorities(papers, links, values):
    out = {}
    for a in {a for _p, a in links}:
        mine = sorted((values[p] for p, b in links if b == a and p in papers and p in values), reverse=True)[:5]
        if mine:
            out[a] = sum(mine) / len(mine)
    return out


def expected(papers, links):
    values = influence(papers)
    out = {}
    for i in papers:
        mine = [a for p, a in links if p == i]
        if any(p != i and b in mine and p in values for p, b in links):
            continue
        rest = {k: p for k, p in papers.items() if k != i}
        left = authorities(rest, [(p, a) for p, a in links if p != i], influence(rest))
        out[i] = median(left.values()) if left else None
    return out


def corpus(seed, n, spread):
    rnd = random.Random(seed)
    papers = {
        f"p{i:03d}": {
            "field": rnd.choice([None, "f1", "f2", "f3"]), "year": rnd.choice([None, 2000, 2001, 2002]),
            "type": rnd.choice([None, "a", "b"]), "c": rnd.choice([None, 0, 0, 1, 2, 5, 9, 30, rnd.randint(0, 200)]),
        }
        for i in range(n)
    }
    links = set()
    for p in papers:
        for _ in range(rnd.randint(0, 3)):
            links.add((p, f"a{rnd.randint(0, spread):03d}"))
    return papers, sorted(links)


def flat(n):
    """All papers alike and uncited but one: every authority is the same, but for one sole maximum."""
    papers = {f"p{i:03d}": {"field": "f1", "year": 2000, "type": "a", "c": 0 if i else 7} for i in range(n)}
    return papers, sorted({(p, f"a{i:03d}") for i, p in enumerate(papers)} | {(p, f"b{i:03d}") for i, p in enumerate(papers)})


def dominant(n):
    """One cohort whose only cited paper sets the maximum for everyone."""
    papers = {f"p{i:03d}": {"field": "f1", "year": 2000, "type": "a", "c": 100 if i == 0 else 1 + i % 7} for i in range(n)}
    return papers, sorted((p, f"a{i:03d}") for i, p in enumerate(papers))


@pytest.mark.parametrize("papers,links", [
    corpus(1, 50, 90), corpus(2, 24, 60), corpus(3, 7, 9), flat(40), dominant(40)], ids=["wide", "middle", "small", "flat", "dominant"])
@pytest.mark.parametrize("places", [3, 4096])
def test_prior_matches_definition(spark, monkeypatch, papers, links, places):
    monkeypatch.setattr(priors, "_PLACES", places)
    rows = [(i, p["year"], p["type"], None if p["c"] is None else float(p["c"]), p["field"],
             [a for q, a in links if q == i]) for i, p in papers.items()]
    df = spark.createDataFrame(
        rows, "paper_id string, year int, ptype string, citations double, field_id string, authors array<string>")
    df = df.withColumn("n_rows", factors.F.lit(1))
    table = priors.all_factors(df, factors.authorship(df)).collect()
    got = {r["paper_id"]: r["prior"] for r in table if r["authority_status"] != "observed"}
    want = expected(papers, links)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None), k
        if v is not None:
            assert got[k] == pytest.approx(v, abs=1e-9), k
    values = influence(papers)
    for r in table:
        assert (r["influence"] is None) == (r["paper_id"] not in values)
        if r["influence"] is not None:
            assert r["influence"] == pytest.approx(values[r["paper_id"]], abs=1e-12)
