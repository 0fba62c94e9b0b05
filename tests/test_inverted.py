"""The stored corpus against the forward index and plain Python."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrellis.functions.relations import dense_ids
from papertrellis.operators import inverted, lexical

WORDS = "tree search graph model neural paper open data set rank seed edge path score field journal vector index block term".split()
PLANNED = "query_id string, text string, filters map<string,string>"


def documents(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(1, 30)), p=np.arange(len(WORDS), 0, -1) / 210))
        if i % 50 == 7:
            text = f"x{i}tree9 (§ {i}) " + text
        if i % 83 == 5:
            text = ""
        rows.append((f"{i:04d}", text if i % 97 else None, ["u1"] if i % 3 else ["u2", "u1"], None if i % 4 else "Article", i % 5 == 0))
    papers = spark.createDataFrame(rows[::2], "id string, name string, university_ids array<string>, publication_type string, is_open_access boolean").withColumn("doi", F.lit(None).cast("string"))
    people = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[1::2]], "id string, name string, university_ids array<string>").withColumn("academic_position", F.lit(None).cast("string"))
    return lexical.corpus_documents(papers, people)


@pytest.fixture(scope="module")
def corpus(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def store(spark, corpus, tmp_path_factory):
    kept = inverted.CELL_BITS, inverted.CELL
    inverted.CELL_BITS, inverted.CELL = 6, 64  # several cells even here
    yield inverted.write_store(corpus, str(tmp_path_factory.mktemp("store") / "s"), buckets=16)
    inverted.CELL_BITS, inverted.CELL = kept


@pytest.fixture(scope="module")
def questions(spark):
    rows = [("a", "tree search", None), ("b", "Graph neural MODEL paper index block", None), ("c", "block", None), ("d", "ree9", None), ("e", "§", None),
            ("f", "nothing known", None), ("g", "*", None), ("h", "tree tree tree open data set", {"university": "U TWO"}), ("i", "rank", {"publication_type": "article", "is_open_access": "true"}),
            ("j", "paper seed", {"kind": "researcher", "university_id": "u2"}), ("k", "ee9", {"university": "u1"}), ("l", "*", {"university": "u2"}), ("m", "tree", {"field": "none"})]
    return lexical.plan_queries(spark.createDataFrame(rows, PLANNED), seed_limit=7).cache()


def lookups(spark):
    return {"university": spark.createDataFrame([("u2", "u Two"), ("u1", None)], "id string, name string")}


def rows(df):
    return sorted((r["query_id"], r["rank"], r["entity_id"], round(r["raw_score"], 9)) for r in df.collect())


def test_retrieval_from_the_store_is_retrieval(spark, corpus, store, questions):
    want = rows(lexical.retrieve(questions, corpus, None, lookups(spark)))
    got = rows(inverted.retrieve(questions, corpus, store, lookups(spark)))
    assert got == want and {r[0] for r in got} == set("abcdeghijkl")


@pytest.mark.parametrize("cells", [1, 100])
def test_blocks_left_out_hold_no_better_document(questions, corpus, store, monkeypatch, cells):
    monkeypatch.setattr(inverted, "FIRST_CELLS", cells)
    plain = questions.where(F.size("filters") == 0)
    want = rows(lexical.top_seeds(lexical.bm25(plain, lexical.index_documents(corpus)), plain))
    assert rows(lexical.top_seeds(store.best(plain), plain)) == want


def test_only_folders_of_the_terms_are_read(spark, store):
    one = lexical.plan_queries(spark.createDataFrame([("q", "tree")], "query_id string, text string"))
    blocks = store.within("blocks", store.weights(one))
    folders = lambda df: {os.path.dirname(r[0]) for r in df.select(F.input_file_name()).distinct().collect()}
    assert len(folders(blocks)) == 1 and len(folders(store.table("blocks"))) > 5
    plan = blocks.select("term", "max_tf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "postings" not in plan.split("ReadSchema")[1]


def test_filters_are_words_of_bits(spark, corpus, store, questions):
    accepted = lexical.resolve_filter_ids(questions, lookups(spark))
    want = {(r[0], r[1]) for r in lexical.apply_filters(questions, corpus, accepted).collect()}
    eligible = store.eligible(questions, accepted)
    assert {(r[0], r[1]) for r in store.members(eligible).collect()} == want
    index = lexical.index_documents(corpus).select("entity_id", "doc_len")
    mean = {r[0]: (r[1], round(r[2], 9)) for r in lexical.apply_filters(questions, corpus, accepted).join(index, "entity_id").groupBy("scope_id").agg(F.count("*"), F.avg("doc_len")).collect()}
    assert {r["scope_id"]: (r["n"], round(r["avgdl"], 9)) for r in store.scope_stats(eligible).collect()} == mean
    plan = eligible._jdf.queryExecution().optimizedPlan().toString()
    assert "entity_id" not in plan  # scopes never meet the documents


def test_pieces_are_ranges_of_suffixes(spark, corpus, store):
    terms = [r[0] for r in lexical.term_document_frequency(lexical.index_documents(corpus)).select("term").collect()]
    pieces = ["e", "tr", "ree", "search", "9", "zz", "x107tree9", "a", "z", "0", ""]
    found = store.terms_containing(spark.createDataFrame([(p,) for p in pieces + pieces[:2]], "word string"))
    assert sorted(map(tuple, found.collect())) == sorted((p, t) for p in pieces for t in terms if p and p in t)


def test_empty_corpus(spark, corpus, questions, tmp_path):
    nothing = corpus.where(F.lit(False))
    assert inverted.retrieve(questions, nothing, inverted.write_store(nothing, str(tmp_path / "s"), buckets=4), {}).count() == 0


def test_dense_ids_of_spread_and_equal_keys(spark):
    keys = [i * 10**6 for i in range(500)] + [-5, -5, None] + [3] * 200
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long").repartition(5)
    out = dense_ids(df, ["k", "n"], "id", rows=80)
    want = sorted(((k is not None, k or 0), n) for n, k in enumerate(keys))
    assert [(r["k"], r["n"]) for r in out.orderBy("id").collect()] == [((k[1] if k[0] else None), n) for k, n in want]
    assert sorted(r["id"] for r in out.collect()) == list(range(len(keys)))
    same = dense_ids(spark.range(300).select(F.lit("x").alias("k")), ["k"], "id", rows=60)
    assert sorted(r["id"] for r in same.collect()) == list(range(300))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_made_and_scored_where_their_cell_is(spark, store, corpus, tmp_path):
    """Texts, not postings, move while a store is written, and no scored pair moves by document."""
    q = lexical.plan_queries(spark.createDataFrame([("q", "a b")], "query_id string, text string"))
    weights = F.broadcast(store.weights(q))
    cells = spark.createDataFrame([("q", 0)], "query_id string, cell long")
    plan = store._scored(cells, weights, store.table("blocks"), 1.2, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cell" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "at#" in x.split("hashpartitioning(")[1].split(")")[0]]
    stored = inverted.write_store(corpus, str(tmp_path / "s"), buckets=4)
    want = {(r["term"], r["kind"], r["entity_id"], r["tf"], r["doc_len"]) for r in lexical.postings(lexical.index_documents(corpus)).collect()}
    rows = stored.table("blocks").select("term", "kind", "max_tf", "min_len", "n", F.size("postings").alias("many"),
                                         ((F.col("cell") * inverted.CELL)).alias("base"), F.inline("postings"))
    rows = stored.named(rows.withColumn("doc", F.col("base") + F.col("at"))).collect()
    assert {(r["term"], r["kind"], r["entity_id"], r["tf"], r["doc_len"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["n"] == r["many"] and r["tf"] <= r["max_tf"] and r["doc_len"] >= r["min_len"] for r in rows)


def test_a_text_is_folded_once_for_all_needles(spark, corpus):
    """Needles of a text meet it as one list; its folding and tokens are worked out before they do, and signs are sought among signs."""
    texts = ["x1tree9 (§ 1) Tree", "tree,", "Éa b", "", None]
    docs = corpus.limit(0).unionByName(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "entity_id string, text string").withColumn(
        "kind", F.lit("publication")), allowMissingColumns=True)
    q = lexical.plan_queries(spark.createDataFrame([("tree", "tree"), ("ree", "REE"), ("par", "("), ("sec", "§ "), ("com", ","), ("e", "e,")], "query_id string, text string"))
    short = lexical.short_needles(q)
    every = short.select("query_id").crossJoin(docs.select("entity_id"))
    found = lexical.holding(every, short, docs, unscored=True)
    assert sorted(map(tuple, found.collect())) == [("com", "d1"), ("e", "d1"), ("par", "d0"), ("ree", "d0"), ("ree", "d1"), ("sec", "d0")]
    joined = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x or "Filter" in x]
    assert not any("regexp_extract_all" in x or "lower(" in x for x in joined)
    signs = lexical.sign_candidates(short, docs)
    assert sorted(map(tuple, signs.collect())) == [("com", "d1"), ("par", "d0"), ("sec", "d0")]
    assert "regexp_replace" in signs._jdf.queryExecution().executedPlan().toString()
