"""Shape of the plans that matter at scale."""

from pyspark.sql import functions as F

from papertrellis.operators import apps, lexical
from papertrellis.plans import catalog


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_need_no_exchange_and_top_k_is_cut_first(spark):
    docs = spark.range(50).select(
        F.concat(F.lit("d"), "id").alias("entity_id"),
        F.when(F.col("id") % 2 == 0, "publication").otherwise("researcher").alias("kind"), F.lit("a b c").alias("text"))
    q = lexical.plan_queries(spark.createDataFrame([("q", "a b")], "query_id string, text string"))
    text = plan_text(lexical.top_seeds(lexical.bm25(q, lexical.index_documents(docs)), q, most=10))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    cut = next(i for i, line in enumerate(text.splitlines()) if "WindowGroupLimit" in line and line.rstrip().endswith("Partial"))
    below = text.splitlines()[cut:]
    spread = next(i for i, line in enumerate(below) if "REPARTITION_BY_COL" in line)
    # from the cut down to the move by document there is no other exchange
    assert not any("Exchange" in line for line in below[:spread])


def test_array_relations_join_by_key(spark):
    left = spark.createDataFrame([("1", ["a", "a"])], "id string, ids array<string>")
    right = spark.createDataFrame([("a", "Name")], "id string, name string")
    out = catalog.related(left, "ids", right, "%nam%")
    assert out.count() == 1
    text = plan_text(out)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_directory_lists_need_no_nested_loop(spark):
    people = spark.createDataFrame([(str(i), f"Name {i % 7}", "prof tree", ["f1"] if i % 2 else [], ["u1"] if i % 3 else None, ["d1"]) for i in range(120)],
                                   "id string, name string, academic_position string, field_ids array<string>, university_ids array<string>, discipline_ids array<string>")
    people = people.withColumn("profile_url", F.lit(None).cast("string")).withColumn("orcid_url", F.lit(""))
    tables = {"field": spark.createDataFrame([("f1", "Trees"), ("f2", None)], "id string, name string"),
              "university": spark.createDataFrame([("u1", "U One")], "id string, name string"), "discipline": spark.createDataFrame([("d1", "D")], "id string, name string")}
    asked = spark.createDataFrame([("a", " ", None, None), ("b", "", "U One", "D"), ("c", None, "U Two", None), ("d", "tree", "U One", None), ("e", "name 3", None, ""), ("f", "", "U One", "D")],
                                  "query_id string, text string, university string, discipline string")
    out = apps.researcher_results(asked, people, tables)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["truncated"]))
    key = lambda i: (f"name {int(i) % 7}", f"academic:{i}")
    holders = sorted((str(i) for i in range(1, 120, 2)), key=key)
    here = [i for i in holders if int(i) % 3]
    assert got["a"] == [(i, True) for i in holders[:25]] and got["b"] == got["f"] == [(i, len(here) > 25) for i in here[:25]]
    assert "c" not in got and got["d"] == got["b"] and {i for i, _ in got["e"]} <= {str(i) for i in range(120)} and len(got["e"]) == 25
    assert "NestedLoop" not in plan_text(out) and "Cartesian" not in plan_text(out)
    nobody = {**tables, "field": tables["field"].where("id = 'f2'")}
    assert apps.researcher_results(asked.where("query_id = 'a'"), people, nobody).count() == 25


def test_profile_heads_need_no_walk(spark, monkeypatch):
    from papertrellis.checks import QUERIES
    from papertrellis.operators import graph

    def walked(*_a, **_k):
        raise AssertionError("walked")

    monkeypatch.setattr(graph, "neighbourhood", walked)
    rows = QUERIES["academic_profile"](spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert rows.where("name is null or institution is null").count() == 0


def test_holders_of_fields_are_paired_last(spark):
    from papertrellis.operators import apps

    people = spark.createDataFrame([("1", ["a", "b", "a"]), ("2", ["b", "a"]), ("3", ["c"]), ("4", None), ("5", ["c", "b"])], "id string, field_ids array<string>")
    matched = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "b"), ("s", "z")], "query_id string, field_id string")
    held = apps._holders(matched, people)
    want = [("q", "1"), ("q", "2"), ("q", "5"), ("r", "1"), ("r", "2"), ("r", "5")]
    assert sorted((r["query_id"], r["id"]) for r in held.collect()) == want
    assert "HashAggregate(keys=[query_id" not in held._jdf.queryExecution().executedPlan().toString()  # pairs don't move to be told apart
    twice = people.unionByName(spark.createDataFrame([("1", ["b"])], people.schema))
    assert sorted((r["query_id"], r["id"]) for r in apps._holders(matched, twice).collect()) == want
