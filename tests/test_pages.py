"""Page rules on nested, broken and hostile markup; reads and scores that lose nothing."""

import pytest
from pyspark.sql import functions as F

from papertrellis.checks import pages as page_checks
from papertrellis.checks.views import Views
from papertrellis.functions import markup
from papertrellis.operators import clean, lexical, pages
from papertrellis.sources import tables


def page(spark, *bodies):
    return spark.createDataFrame([(i, "https://x.example/p", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")


def by_page(df, column):
    return {r["page_id"]: r[column] for r in df.collect()}


def test_class_texts_follow_nesting_and_take_the_first_element(spark):
    df = page(
        spark,
        '<div class="person-details"><div>Group</div> Senior <b>Lecturer</b></div><div class="person-details">Dean</div>',
        '<div class="person-details"> </div><div class="person-details">Dean</div><p class="relations">Fellow</p>',
        '<div class="person-details">open <p>until the end',
        None,
    )
    assert by_page(pages.position_by_class(df), "position") == {0: "Group Senior Lecturer", 1: "Fellow", 2: "open until the end"}
    words = page(spark, '<span class="keyword">a <span class="keyword">b</span></span>')
    assert by_page(pages.keyword_values(words), "values") == {0: ["a b", "b"]}


@pytest.mark.parametrize("body", ["<a " + "x" * 1_000_000, "<a " + '"" ' * 200_000, "<p>" * 5_000 + "deep", "<!-- never closed", "<a href='" + "x" * 100_000])
def test_hostile_markup_ends_nothing(spark, body):
    df = page(spark, body + "<p>text</p>", "<p>fine</p>")
    assert {"fine"} <= {r["text"] for r in pages.page_blocks(df).collect()}
    assert len(markup.tree(body).kids) <= 2 or body.startswith("<p>")
    assert pages.position_by_class(df).count() == 0


def test_tags_of_any_length_are_cut_whole(spark):
    many = " ".join(f"a{i}='x>y'" for i in range(20_000))
    df = page(spark, f"<p>before <b {many}>bold</b> after</p>")
    assert [r["text"] for r in pages.page_blocks(df).collect()] == ["before bold after"]


def test_tags_with_quoted_signs_are_cut_whole(spark):
    df = page(spark, """<p title="a > b" data-x='">'>kept</p>""")
    assert [r["text"] for r in pages.page_blocks(df).collect()] == ["kept"]


def test_references_without_their_semicolon_stay(spark):
    df = page(spark, "<h1>a&amp;b and&amp</h1>", "<p>&amp;lt; &#233;&#xe9; &copy &nosuch; &ampx; x&copy;</p>")
    assert by_page(pages.page_blocks(df), "text") == {0: "a&b and&amp", 1: "&lt; éé &copy &nosuch; &ampx; x©"}


def test_position_counts_strings_and_falls_back_to_the_directory(spark):
    far = "<h1>Ann</h1>" + "<p>x <b>y</b> z</p>" * 10 + "<p>Professor of Trees</p>"
    farther = "<h1>Ann</h1>" + "<p>x <b>y</b> z</p>" * 11 + "<p>Professor of Trees</p>"
    df = page(spark, far[:12] + far[12:].replace("x", "", 1), farther, "<p>no heading, Lecturer</p>")
    assert by_page(pages.position_near_heading(df), "position") == {0: "Professor of Trees"}
    listed = spark.createDataFrame([(1, "senior lecturer"), (0, "lecturer"), (2, None)], "page_id long, role string")
    assert by_page(pages.position_near_heading(df, listed), "position") == {0: "Professor of Trees", 1: "Senior Lecturer"}


def test_sibling_section(spark):
    body = ("<h2>Research interests</h2><div>Trees<ul><li>old</li></ul></div><ul><li>a <b>b</b></li><li>A B</li></ul><span>skipped</span>"
            "<h5>also skipped</h5><p>last</p><h3>Next</h3><p>not this</p>")
    df = page(spark, body, "<p>none</p>")
    assert by_page(pages.sibling_section(df, ("research interests",)), "values") == {0: ["Trees old", "a b", "last"]}


def test_about_section_names_interests(spark):
    text = "My research primarily focuses on trees, and roots; leaves. More."
    assert spark.range(1).select(pages.cue_interests(F.lit(text), "rmit")).first()[0]
    blocks = pages.page_blocks(page(spark, f"<h2>About</h2><p>{text}</p>", "<h2>Interests</h2><p>stars</p><h2>About</h2><p>My research focuses on x.</p>", "<p>n</p>"))
    got = by_page(pages.resolve_interests(blocks, about=True), "interests")
    assert got == {0: ["trees", "and roots", "leaves"], 1: ["stars"], 2: []}
    assert by_page(pages.resolve_interests(blocks), "interests")[0] == []


def test_bounded_scan_gives_one_stated_row_per_id(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("a", 1), ("c", 3), (None, 0)], "id string, n int")
    for part in (df, df.repartition(5)):
        assert [tuple(r) for r in tables.bounded_scan(part, 2).collect()] == [("a", 1, True), ("b", 2, True)]
    assert [r["truncated"] for r in tables.bounded_scan(df, 10).collect()] == [False] * 3


def test_invalid_issues_are_all_shown(spark):
    df = spark.createDataFrame([(str(i), "n", "x") for i in range(50)], "id string, name string, issue string")
    assert clean.invalid_issues(df).count() == 50 and clean.invalid_issues(df, 3).count() == 3


def test_a_term_of_every_document_still_matches(spark):
    tiny = lexical._steady(F.col("s"))
    rows = spark.createDataFrame([(2.9e-11,), (1.23456789012345e-7,), (3.0,), (12.345678901234,)], "s double").select(tiny).collect()
    assert [r[0] for r in rows] == [pytest.approx(2.9e-11, rel=1e-9), pytest.approx(1.23456789e-7, rel=1e-9), 3.0, 12.3456789012]
    docs = spark.range(400).select(F.concat(F.lit("d"), "id").alias("entity_id"), F.lit("publication").alias("kind"), F.lit("tree " * 3).alias("text"))
    q = lexical.plan_queries(spark.createDataFrame([("q", "tree")], "query_id string, text string"))
    assert lexical.bm25(q, lexical.index_documents(docs)).where("score > 0").count() == 400


def test_pages_made_from_a_small_table_are_dealt_out(spark, tmp_path):
    many = spark.range(9000).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").coalesce(1)
    many.write.parquet(f"{tmp_path}/part.parquet")
    v = Views(spark, str(tmp_path))
    rows = v("profile_page")
    assert rows.rdd.getNumPartitions() == 3 and rows.select("page_id").distinct().count() == 9000
    each = page_checks.blocks_by_page(v).rdd.mapPartitions(lambda part: [{r["page_id"] for r in part}]).collect()
    assert len(each) == 3 and sum(map(len, each)) == 9000
