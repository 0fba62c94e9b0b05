"""Retrieval, fusion and ranking over the text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrellis.checks.registry import check, joined, rounded
from papertrellis.checks.views import Views
from papertrellis.functions.text import CASE_FOLDS, tokens
from papertrellis.operators import fusion, inverted, lexical, ranking, scores
from papertrellis.session import cut_lineage, new_folder


def sql_fold(expr: str) -> str:
    out = f"lower({expr})"
    for source, target in CASE_FOLDS:
        out = f"replace({out}, '{source}', '{target}')"
    return out


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all({sql_fold(expr)}, '[a-z0-9]+')"


def sql_unit(expr: str) -> str:
    """Stored score to [0, 1]."""
    value = f"TRY_CAST({expr} AS DOUBLE)"
    return f"CASE WHEN {value} IS NOT NULL THEN greatest(0e0, least(1e0, {value})) END"


def sql_mean(expr: str) -> str:
    """Mean of values in [0, 1], added as decimals."""
    return f"CAST(sum(CAST({expr} AS DECIMAL(38,15))) AS DOUBLE) / count({expr})"


def corpus(v: Views) -> DataFrame:
    return lexical.corpus_documents(v("lib_paper"), v("lib_academic"))


def indexed(v: Views, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The tokenised corpus, computed once."""
    return cut_lineage(lexical.index_documents(corpus(v), stop_words))


def planned(v: Views, **limits) -> DataFrame:
    return lexical.plan_queries(v("lib_query").select("query_id", "text", "as_of"), **limits)


def filtered_queries(v: Views) -> DataFrame:
    """Every benchmark text under a filter chosen by its number."""
    q = v("lib_query")
    flt = (
        F.when(F.col("item_id") % 5 == 0, F.create_map(F.lit("university"), F.concat(F.lit("nation_"), F.col("item_id") % 25)))
        .when(F.col("item_id") % 5 == 1, F.create_map(F.lit("faculty_id"), (F.col("item_id") % 7).cast("string")))
        .when(F.col("item_id") % 5 == 2, F.create_map(F.lit("publication_type"), F.concat(F.lit("SRC"), F.col("item_id") % 20),
                                                      F.lit("is_open_access"), F.lit("true")))
        .when(F.col("item_id") % 5 == 3, F.create_map(F.lit("kind"), F.lit("publication")))
        .otherwise(F.create_map(F.lit("discipline"), F.concat(F.lit("DISCIPLINE "), F.col("item_id") % 29)))
    )
    return lexical.plan_queries(q.select("query_id", "text", "as_of", flt.alias("filters")))


FILTER_SQL = """
    SELECT query_id, text, key, expected FROM (
        SELECT query_id, text, item_id,
               CASE item_id % 5 WHEN 0 THEN 'university' WHEN 1 THEN 'faculty_id' WHEN 2 THEN 'publication_type'
                    WHEN 3 THEN 'kind' ELSE 'discipline' END AS key,
               CASE item_id % 5 WHEN 0 THEN 'nation_' || (item_id % 25) WHEN 1 THEN CAST(item_id % 7 AS VARCHAR)
                    WHEN 2 THEN 'SRC' || (item_id % 20) WHEN 3 THEN 'publication'
                    ELSE 'DISCIPLINE ' || (item_id % 29) END AS expected FROM lib_query
        UNION ALL SELECT query_id, text, item_id, 'is_open_access', 'true' FROM lib_query WHERE item_id % 5 = 2) z"""

TEXT = {
    "corp": """
        SELECT 'research_paper:' || id AS entity_id, 'publication' AS kind,
               concat_ws(' ', name, array_to_string(keywords, ' '), doi, publication_type) AS txt FROM lib_paper
        UNION ALL
        SELECT 'academic:' || id, 'researcher', concat_ws(' ', name, academic_position) FROM lib_academic""",
    "toks": f"SELECT entity_id, kind, txt, {sql_tokens('txt')} AS tk FROM corp",
    "posts": """
        SELECT entity_id, kind, dl, term, count(*) AS tf
        FROM (SELECT entity_id, kind, len(tk) AS dl, unnest(tk) AS term FROM toks) u GROUP BY ALL""",
    "dfs": "SELECT term, count(*) AS df FROM posts GROUP BY term",
    "stat": "SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM toks",
    "qterm": f"""
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM lib_query) u GROUP BY ALL""",
    "bm": """
        SELECT q.query_id, p.entity_id,
               round(sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * (1.2e0 + 1)
                     / (p.tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * p.dl / s.avgdl))), 10) AS sc
        FROM qterm q JOIN posts p ON p.term = q.term JOIN dfs d ON d.term = q.term CROSS JOIN stat s
        GROUP BY q.query_id, p.entity_id""",
    "lexhits": """
        SELECT query_id, entity_id, rk, sc FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, entity_id) AS rk FROM bm) z
        WHERE rk <= 10""",
    "qv": """
        SELECT q.query_id, e.embedding AS v FROM lib_query q JOIN embeddings e ON e.vec_id = q.item_id""",
    "densehits": """
        SELECT query_id, entity_id, rk, sc FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, entity_id) AS rk FROM (
                SELECT q.query_id, 'research_paper:' || e.vec_id AS entity_id,
                       round(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
                         / sqrt(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])))
                         / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 10) AS sc
                FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id CROSS JOIN qv q) s) z
        WHERE rk <= 10""",
    "allhits": """
        SELECT query_id, entity_id, 'lexical' AS channel, rk, sc FROM lexhits
        UNION ALL SELECT query_id, entity_id, 'dense', rk, sc FROM densehits""",
    "fusedraw": """
        SELECT query_id, entity_id, round(sum(1e0 / (60 + rk)), 15) AS raw, count(*) AS nch
        FROM allhits GROUP BY ALL""",
    "fused": """
        SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS rrf FROM fusedraw""",
    "pscore": f"""
        SELECT research_paper_id AS pid,
               {sql_mean(sql_unit('paper_authority_score'))} AS pa, {sql_mean(sql_unit('academic_authority_score'))} AS aa,
               {sql_mean(sql_unit('citation_influence_score'))} AS ci, {sql_mean(sql_unit('author_authority_score'))} AS au,
               {sql_mean(sql_unit('journal_authenticity_score'))} AS ja
        FROM lib_score GROUP BY research_paper_id""",
    "prof": """
        SELECT * FROM (VALUES ('GENERAL', 0.65e0, 0.2e0, 0.07e0, 0.03e0, 0.05e0, 0.75e0, 8e0),
                              ('RECENT', 0.6e0, 0.18e0, 0.04e0, 0.18e0, 0e0, 0.75e0, 2e0),
                              ('FOUNDATIONAL', 0.65e0, 0.2e0, 0.12e0, 0e0, 0.03e0, 0.75e0, 25e0))
        AS t(pname, wr, wg, wc, wt, wa, rr, hl)""",
    "qplan": """
        SELECT query_id, as_of, CASE
            WHEN regexp_matches(lower(text), 'latest|recent|newest|current') THEN 'RECENT'
            WHEN regexp_matches(lower(text), 'foundational|seminal|classic') THEN 'FOUNDATIONAL'
            ELSE 'GENERAL' END AS pname FROM lib_query""",
    "compon": """
        SELECT f.query_id, f.entity_id, f.rrf,
               CASE WHEN f.entity_id LIKE 'academic:%' THEN 'researcher' ELSE 'publication' END AS kind,
               coalesce(s.ci, 0e0) AS cit, coalesce(s.pa, 0e0) AS pa, coalesce(s.au, 0e0) AS au, s.ja, s.aa,
               CASE WHEN p.publication_date IS NULL THEN 0e0 ELSE
                   power(0.5e0, greatest(0, date_diff('day', p.publication_date, q.as_of)) / 365.25e0 / r.hl) END AS rec, r.*
        FROM fused f JOIN qplan q ON q.query_id = f.query_id JOIN prof r ON r.pname = q.pname
        LEFT JOIN lib_paper p ON 'research_paper:' || p.id = f.entity_id
        LEFT JOIN pscore s ON 'research_paper:' || s.pid = f.entity_id""",
    "finals": """
        SELECT *, coalesce(kind = 'publication' AND ja < 0.5, false) AS gated,
               CASE WHEN coalesce(kind = 'publication' AND ja < 0.5, false) THEN 0e0
                    WHEN kind = 'publication' THEN round(wr * rrf + wg * 0 + wc * cit + wt * rec + wa * pa, 12)
                    ELSE round(rr * rrf, 12) END AS fin FROM compon""",
    "ranked": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY NOT gated DESC, fin DESC, entity_id) AS rnk FROM finals) z WHERE rnk <= 10""",
}


@check("plan_queries", """
    SELECT q.query_id, q.as_of, p.pname AS profile, 10 AS limit_n, 10 AS seed_n, 'publication|researcher' AS kinds
    FROM lib_query q JOIN qplan p ON p.query_id = q.query_id""", **TEXT)
def _(v):
    return planned(v).select(
        "query_id", "as_of", "profile", F.col("limit").alias("limit_n"), F.col("seed_limit").alias("seed_n"),
        joined("target_kinds").alias("kinds"),
    )


@check("corpus_documents", "SELECT entity_id, kind, md5(txt) AS text_md5 FROM corp", **TEXT)
def _(v):
    return corpus(v).select("entity_id", "kind", F.md5("text").alias("text_md5"))


@check("tokenize", "SELECT entity_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS token_md5 FROM toks", **TEXT)
def _(v):
    toks = tokens(F.col("text"))
    return corpus(v).select(
        "entity_id", F.size(toks).cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", toks)).alias("token_md5")
    )


@check("corpus_stats", "SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM stat", **TEXT)
def _(v):
    return lexical.corpus_stats(indexed(v)).select("n_docs", rounded("avgdl").alias("avgdl"))


@check("term_document_frequency", "SELECT term, df FROM dfs", **TEXT)
def _(v):
    return lexical.term_document_frequency(indexed(v))


@check("bm25", "SELECT query_id, entity_id, round(sc, 6) AS score FROM bm", **TEXT)
def _(v):
    return lexical.bm25(planned(v), indexed(v)).select(
        "query_id", "entity_id", rounded("score").alias("score")
    )


STOP_SQL = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
VARIANT = {
    "toks": f"SELECT entity_id, kind, [x FOR x IN {sql_tokens('txt')} IF x NOT IN ({STOP_SQL})] AS tk FROM corp",
    "qterm": TEXT["qterm"].replace("GROUP BY ALL", f"WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL"),
    "bm": TEXT["bm"].replace("1.2e0", "1.5e0").replace("s.avgdl", "greatest(1e0, s.avgdl)"),
}


@check("bm25_variant", "SELECT query_id, entity_id, round(sc, 6) AS score FROM bm", **{**TEXT, **VARIANT})
def _(v):
    index = indexed(v, lexical.STOP_WORDS)
    return lexical.bm25(
        planned(v), index, k1=1.5, stop_words=lexical.STOP_WORDS, minimum_average=1.0
    ).select("query_id", "entity_id", rounded("score").alias("score"))


@check("top_seeds", "SELECT query_id, entity_id, rk AS rank, round(sc, 6) AS raw_score FROM lexhits", **TEXT)
def _(v):
    q = planned(v)
    scored = lexical.bm25(q, indexed(v))
    return lexical.top_seeds(scored, q).select(
        "query_id", "entity_id", F.col("rank").cast("long").alias("rank"), rounded("raw_score").alias("raw_score")
    )


def short_queries(v: Views) -> DataFrame:
    """Two halves of part names and other short texts that only a substring match finds."""
    q = v("part").where("p_name IS NOT NULL").select(
        F.substring_index("p_name", " ", -1).alias("w")
    ).distinct().select(F.concat(F.lit("s"), F.col("w")).alias("query_id"), F.expr("substring(w, 2)").alias("text"))
    signs = v("documents").select("lang").distinct().select(
        F.concat(F.lit("z"), F.col("lang")).alias("query_id"),
        F.when(F.col("lang") == "en", ",").when(F.col("lang") == "fr", "é").otherwise(", ").alias("text"),
    )
    return lexical.plan_queries(q.unionByName(signs).withColumn("as_of", F.to_date(F.lit("2024-01-01"))))


@check("substring_fallback", f"""
    WITH sq AS (
        SELECT DISTINCT 's' || string_split(p_name, ' ')[-1] AS query_id,
               substring(string_split(p_name, ' ')[-1], 2) AS needle FROM part WHERE p_name IS NOT NULL
        UNION SELECT 'z' || lang, CASE lang WHEN 'en' THEN ',' WHEN 'fr' THEN 'é' ELSE ',' END FROM documents)
    SELECT sq.query_id, c.entity_id, 1e0 AS score FROM sq JOIN corp c
    ON contains({sql_fold('c.txt')}, trim({sql_fold('sq.needle')}))""", **TEXT)
def _(v):
    docs = corpus(v)
    return lexical.substring_fallback(short_queries(v), docs, indexed(v)).withColumn(
        "score", F.lit(1.0)
    )


@check("match_all", """
    SELECT query_id, entity_id, 1e0 AS score, rk AS rank FROM (
        SELECT q.query_id, c.entity_id, row_number() OVER (PARTITION BY q.query_id ORDER BY c.entity_id) AS rk
        FROM corp c CROSS JOIN (SELECT query_id FROM lib_query) q) z WHERE rk <= 10""", **TEXT)
def _(v):
    q = planned(v).withColumn("text", F.lit("*"))
    return lexical.top_seeds(lexical.match_all(q, corpus(v)), q).select(
        "query_id", "entity_id", F.col("raw_score").alias("score"), F.col("rank").cast("long").alias("rank")
    )


LOOKUPS = ("university", "faculty", "discipline", "field")

FILTERED = {
    **TEXT,
    "flt": FILTER_SQL,
    "lookup_names": """
        SELECT 'university' AS t, id, name FROM university UNION ALL SELECT 'faculty', id, name FROM faculty
        UNION ALL SELECT 'discipline', id, name FROM discipline UNION ALL SELECT 'field', id, name FROM field""",
    "accepted": f"""
        SELECT query_id, key, CASE WHEN key = 'publication_type' THEN {sql_fold('expected')} ELSE expected END AS val
        FROM flt
        UNION SELECT f.query_id, f.key, l.id FROM flt f JOIN lookup_names l
        ON l.t = replace(f.key, '_id', '') AND {sql_fold('l.name')} = {sql_fold('f.expected')}""",
    "attrs": """
        SELECT 'research_paper:' || id AS entity_id, 'university' AS key, unnest(university_ids) AS val FROM lib_paper
        UNION ALL SELECT 'research_paper:' || id, 'faculty_id', unnest(faculty_ids) FROM lib_paper
        UNION ALL SELECT 'research_paper:' || id, 'publication_type', lower(publication_type) FROM lib_paper
        UNION ALL SELECT 'research_paper:' || id, 'is_open_access', CAST(is_open_access AS VARCHAR) FROM lib_paper
        UNION ALL SELECT 'research_paper:' || id, 'kind', 'publication' FROM lib_paper
        UNION ALL SELECT 'academic:' || id, 'university', unnest(university_ids) FROM lib_academic
        UNION ALL SELECT 'academic:' || id, 'discipline', unnest(discipline_ids) FROM lib_academic""",
    "elig": """
        SELECT a.query_id, t.entity_id FROM accepted a JOIN attrs t ON t.key = a.key AND t.val = a.val
        GROUP BY a.query_id, t.entity_id
        HAVING count(DISTINCT a.key) = (SELECT count(*) FROM flt WHERE flt.query_id = a.query_id)""",
    "estat": """
        SELECT e.query_id, count(*) AS n, avg(len(t.tk)) AS avgdl FROM elig e
        JOIN toks t ON t.entity_id = e.entity_id GROUP BY e.query_id""",
    "edf": """
        SELECT e.query_id, p.term, count(*) AS df FROM elig e JOIN posts p ON p.entity_id = e.entity_id GROUP BY ALL""",
    "ebm": """
        SELECT q.query_id, p.entity_id,
               round(sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * (1.2e0 + 1)
                     / (p.tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * p.dl / s.avgdl))), 10) AS sc
        FROM qterm q JOIN elig e ON e.query_id = q.query_id
        JOIN posts p ON p.term = q.term AND p.entity_id = e.entity_id
        JOIN edf d ON d.term = q.term AND d.query_id = q.query_id JOIN estat s ON s.query_id = q.query_id
        GROUP BY q.query_id, p.entity_id""",
}


@check("resolve_filter_ids", "SELECT DISTINCT key, val AS value FROM accepted", **FILTERED)
def _(v):
    q = filtered_queries(v)
    return lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS}).select("key", "value").distinct()


@check("apply_filters", "SELECT query_id, entity_id FROM elig", **FILTERED)
def _(v):
    q = filtered_queries(v)
    accepted = lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS})
    eligible = lexical.apply_filters(q, corpus(v), accepted)
    return lexical.scope_key(q).select("query_id", "scope_id").join(eligible, "scope_id").drop("scope_id")


@check("bm25_filtered", "SELECT query_id, entity_id, round(sc, 6) AS score FROM ebm", **FILTERED)
def _(v):
    q, docs = filtered_queries(v), corpus(v)
    eligible = lexical.apply_filters(q, docs, lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS}))
    return lexical.bm25_filtered(q, indexed(v), eligible).select(
        "query_id", "entity_id", rounded("score").alias("score")
    )


# --- the stored corpus ---


def stored(v: Views, *parts: str) -> inverted.Store:
    return inverted.write_store(corpus(v), new_folder(v.spark, "corpus"), parts=parts)


@check("stored_bm25", "SELECT query_id, entity_id, rk AS rank, round(sc, 6) AS raw_score FROM lexhits", **TEXT)
def _(v):
    q = planned(v)
    return lexical.top_seeds(stored(v, "postings").best(q), q).select(
        "query_id", "entity_id", F.col("rank").cast("long").alias("rank"), rounded("raw_score").alias("raw_score")
    )


@check("stored_bm25_filtered", """
    SELECT query_id, entity_id, rk AS rank, round(sc, 6) AS raw_score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, entity_id) AS rk FROM ebm) z WHERE rk <= 10""", **FILTERED)
def _(v):
    q, store = filtered_queries(v), stored(v, "postings", "bitmaps")
    eligible = store.eligible(q, lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS}))
    return lexical.top_seeds(store.best_filtered(q, eligible), q).select(
        "query_id", "entity_id", F.col("rank").cast("long").alias("rank"), rounded("raw_score").alias("raw_score")
    )


@check("eligible_documents", "SELECT query_id, entity_id FROM elig", **FILTERED)
def _(v):
    q, store = filtered_queries(v), stored(v, "bitmaps")
    members = store.members(store.eligible(q, lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS})))
    return lexical.scope_key(q).select("query_id", "scope_id").join(members, "scope_id").drop("scope_id")


@check("scope_stats", "SELECT query_id, n AS n_docs, round(avgdl, 6) AS avgdl FROM estat", **FILTERED)
def _(v):
    q, store = filtered_queries(v), stored(v, "bitmaps")
    stats = store.scope_stats(store.eligible(q, lexical.resolve_filter_ids(q, {t: v(t) for t in LOOKUPS})))
    return lexical.scope_key(q).select("query_id", "scope_id").join(stats, "scope_id").select(
        "query_id", F.col("n").alias("n_docs"), rounded("avgdl").alias("avgdl"))


@check("terms_containing", """
    SELECT DISTINCT w.word, d.term FROM (
        SELECT DISTINCT substring(string_split(p_name, ' ')[-1], 2) AS word FROM part WHERE p_name IS NOT NULL
        UNION SELECT n_regionkey || '' FROM nation UNION SELECT lower(left(n_name, 1)) FROM nation UNION SELECT lower(left(n_name, 2)) FROM nation) w
    JOIN dfs d ON contains(d.term, w.word) WHERE w.word <> ''""", **TEXT)
def _(v):
    nation = v("nation")
    words = v("part").where("p_name IS NOT NULL").select(F.expr("substring(substring_index(p_name, ' ', -1), 2)").alias("word"))
    for piece in (F.col("n_regionkey").cast("string"), F.lower(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 1, 2))):
        words = words.unionByName(nation.select(piece.alias("word")))
    return stored(v, "suffixes").terms_containing(words)


@check("stored_substring", f"""
    WITH sq AS (
        SELECT DISTINCT 's' || string_split(p_name, ' ')[-1] AS query_id,
               substring(string_split(p_name, ' ')[-1], 2) AS needle FROM part WHERE p_name IS NOT NULL
        UNION SELECT 'z' || lang, CASE lang WHEN 'en' THEN ',' WHEN 'fr' THEN 'é' ELSE ',' END FROM documents)
    SELECT sq.query_id, c.entity_id FROM sq JOIN corp c
    ON contains({sql_fold('c.txt')}, trim({sql_fold('sq.needle')})) JOIN toks t ON t.entity_id = c.entity_id
    WHERE NOT list_has_any(t.tk, {sql_tokens('sq.needle')})""", **TEXT)
def _(v):
    return stored(v, "postings", "suffixes").containing(short_queries(v), corpus(v))


def dense_hits(v: Views) -> DataFrame:
    vectors = v("embeddings")
    q = v("lib_query").join(vectors, F.col("item_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    d = vectors.join(v("documents").select("doc_id"), F.col("vec_id") == F.col("doc_id")).select(
        scores.namespaced("research_paper", "vec_id").alias("entity_id"), F.col("embedding").alias("vector")
    )
    return lexical.dense_channel(q, d)


@check("dense_channel", "SELECT query_id, entity_id, rk AS rank, round(sc, 6) AS raw_score FROM densehits", **TEXT)
def _(v):
    return dense_hits(v).select(
        "query_id", "entity_id", F.col("rank").cast("long").alias("rank"), rounded("raw_score").alias("raw_score")
    )


def both_channels(v: Views) -> DataFrame:
    q = planned(v)
    return lexical.retrieve(q, corpus(v), indexed(v), with_filters=False).unionByName(dense_hits(v))


@check("rrf", """
    SELECT query_id, entity_id, round(raw, 6) AS raw_rrf, round(rrf, 6) AS rrf_score, nch AS n_channels,
           row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, nch DESC, entity_id) AS fused_rank
    FROM fused""", **TEXT)
def _(v):
    return fusion.rrf(both_channels(v)).select(
        "query_id", "entity_id", rounded("raw_rrf_score").alias("raw_rrf"), rounded("rrf_score").alias("rrf_score"),
        "n_channels", F.col("fused_rank").cast("long").alias("fused_rank"),
    )


@check("channel_maps", """
    SELECT query_id, entity_id, string_agg(channel || '=' || rk, '|' ORDER BY channel) AS ranks,
           string_agg(channel || '=' || printf('%.4f', sc), '|' ORDER BY channel) AS raw_scores
    FROM allhits GROUP BY query_id, entity_id""", **TEXT)
def _(v):
    def shown(col, fmt):
        return F.array_join(
            F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), fmt(e["value"]))), "|"
        )

    return fusion.channel_maps(both_channels(v)).select(
        "query_id", "entity_id", shown("channel_ranks", lambda x: x.cast("string")).alias("ranks"),
        shown("channel_raw_scores", lambda x: F.format_string("%.4f", x)).alias("raw_scores"),
    )


@check("validate_hits", """
    SELECT 'q' || l_orderkey % 10 AS query_id, 'e' || l_partkey AS entity_id, violation FROM (
        SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'empty channel' END AS violation FROM lineitem
        UNION ALL SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber < 2 THEN 'rank below one' END FROM lineitem
        UNION ALL SELECT l_orderkey, l_partkey, CASE WHEN
            min(l_linestatus) OVER (PARTITION BY l_orderkey % 10, l_partkey)
            <> max(l_linestatus) OVER (PARTITION BY l_orderkey % 10, l_partkey) THEN 'conflicting kind' END FROM lineitem) z
    WHERE violation IS NOT NULL GROUP BY ALL""")
def _(v):
    hits = v("lineitem").select(
        F.concat(F.lit("q"), F.col("l_orderkey") % 10).alias("query_id"),
        F.concat(F.lit("e"), F.col("l_partkey")).alias("entity_id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise("lexical").alias("channel"),
        (F.col("l_linenumber") - 1).alias("rank"),
        F.lit(1.0).alias("raw_score"),
        F.col("l_linestatus").alias("kind"),
    )
    return fusion.validate_hits(hits)


def entities(v: Views) -> DataFrame:
    s = v("lib_score")
    papers = scores.paper_entity(v("lib_paper"), scores.score_by_paper(s).drop("score_rows"))
    return papers.unionByName(scores.academic_entity(v("lib_academic"), scores.score_by_academic(s)))


def candidates(v: Views) -> DataFrame:
    fused = fusion.rrf(both_channels(v)).select("query_id", "entity_id", F.col("rrf_score").alias("retrieval_score"))
    return fused.join(entities(v), "entity_id").withColumn("graph_score", F.lit(0.0))


def ranked(v: Views) -> DataFrame:
    return ranking.rank(candidates(v), planned(v), ranking.built_in_profiles(v.spark))


RANKED_SQL = """
    SELECT query_id, rnk AS rank, entity_id, NOT gated AS eligible, round(fin, 6) AS final_score FROM ranked"""


@check("rank", RANKED_SQL, **TEXT)
def _(v):
    return ranked(v).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "entity_id", "eligible",
        rounded("final_score").alias("final_score"),
    )


def spread_candidates(v: Views) -> DataFrame:
    """Every entity once, its query and its retrieval and graph scores taken from its number."""
    n = F.substring_index("entity_id", ":", -1).cast("long")
    return entities(v).withColumns({
        "query_id": F.concat(F.lit("q"), n % 40),
        "retrieval_score": (n % 101) / F.lit(100.0),
        "graph_score": (n % 51) / F.lit(50.0),
    })


def scored(v: Views) -> DataFrame:
    return ranking.score_candidates(spread_candidates(v), planned(v), ranking.built_in_profiles(v.spark))


SPREAD = {
    **TEXT,
    "ents": """
        SELECT 'research_paper:' || id AS entity_id, CAST(id AS BIGINT) AS n FROM lib_paper
        UNION ALL SELECT 'academic:' || id, CAST(id AS BIGINT) FROM lib_academic""",
    "fused": "SELECT 'q' || (n % 40) AS query_id, entity_id, (n % 101) / 1e2 AS rrf, (n % 51) / 5e1 AS gr FROM ents",
    "compon": TEXT["compon"].replace("f.rrf,", "f.rrf, f.gr,"),
    "finals": TEXT["finals"].replace("wg * 0", "wg * gr").replace("rr * rrf", "rr * rrf + (1 - rr) * gr"),
}


@check("recency", "SELECT query_id, entity_id, round(rec, 6) AS recency FROM compon", **SPREAD)
def _(v):
    return scored(v).select("query_id", "entity_id", rounded("c_recency").alias("recency"))


@check("publication_score", """
    SELECT query_id, entity_id, round(fin, 6) AS final_score FROM finals WHERE kind = 'publication'""", **SPREAD)
def _(v):
    return scored(v).where("kind = 'publication'").select(
        "query_id", "entity_id", rounded("final_score").alias("final_score"))


@check("researcher_score", """
    SELECT query_id, entity_id, round(fin, 6) AS final_score FROM finals WHERE kind = 'researcher'""", **SPREAD)
def _(v):
    return scored(v).where("kind = 'researcher'").select(
        "query_id", "entity_id", rounded("final_score").alias("final_score"))


@check("gates", """
    SELECT query_id, entity_id,
           concat_ws('|', CASE WHEN item_no % 2 = 0 AND NOT proven THEN 'missing_evidence' END,
                          CASE WHEN gated THEN 'journal_authenticity_gate' END) AS reasons
    FROM (SELECT f.*, CAST(substring(f.query_id, 2) AS INT) AS item_no,
                 EXISTS (SELECT 1 FROM evidence e WHERE e.entity_id = f.entity_id) AS proven FROM finals f) z""", **SPREAD)
def _(v):
    proven = v("evidence").groupBy("entity_id").agg(F.collect_list("evidence_id").alias("_ids"))
    c = spread_candidates(v).join(proven, "entity_id", "left")
    c = c.withColumn("evidence_ids", F.coalesce("_ids", "evidence_ids")).drop("_ids")
    q = planned(v).withColumn("require_evidence", F.expr("cast(substring(query_id, 2) as int) % 2 = 0"))
    return ranking.score_candidates(c, q, ranking.built_in_profiles(v.spark)).select(
        "query_id", "entity_id", joined("gate_reasons").alias("reasons"))


@check("score_breakdown", """
    SELECT query_id, entity_id, CASE WHEN kind = 'publication' THEN concat_ws('|',
        printf('author_authority=%.4f', au), printf('citation=%.4f', cit), printf('graph=%.4f', gr),
        printf('paper_authority=%.4f', pa), printf('recency=%.4f', rec), printf('retrieval=%.4f', rrf))
        ELSE concat_ws('|', printf('graph=%.4f', gr), printf('retrieval=%.4f', rrf)) END AS breakdown,
        CASE WHEN kind = 'publication' AND aa IS NOT NULL OR kind = 'researcher' AND EXISTS (
            SELECT 1 FROM lib_score s WHERE s.academic_ids[1] = replace(finals.entity_id, 'academic:', ''))
        THEN 'academic_authority_score' ELSE '' END AS ignored
    FROM finals""", **SPREAD)
def _(v):
    entries = F.array_sort(F.map_entries("score_breakdown"))
    return scored(v).select(
        "query_id", "entity_id",
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), "|")
        .alias("breakdown"),
        joined("ignored_signals").alias("ignored"),
    )


@check("profiles", """
    SELECT s_name AS profile, violation FROM (
        SELECT s_name, CASE WHEN s_suppkey % 5 <> 0 THEN 'weights do not sum to one' END AS violation FROM supplier
        UNION ALL SELECT s_name, CASE WHEN s_nationkey = 0 THEN 'half-life not positive' END FROM supplier
        UNION ALL SELECT s_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'gate outside [0, 1]' END FROM supplier) z
    WHERE violation IS NOT NULL
    UNION ALL SELECT p_profile, 'built in' FROM (VALUES ('GENERAL'), ('RECENT'), ('FOUNDATIONAL')) t(p_profile)""")
def _(v):
    user = v("supplier").select(
        F.col("s_name").alias("profile"), F.lit(0.6).alias("w_pub_retrieval"), F.lit(0.2).alias("w_pub_graph"),
        F.lit(0.1).alias("w_citation"), ((F.col("s_suppkey") % 5) / 10.0).alias("w_recency"),
        F.lit(0.1).alias("w_paper_authority"), F.lit(0.75).alias("w_res_retrieval"), F.lit(0.25).alias("w_res_graph"),
        F.col("s_nationkey").cast("double").alias("half_life_years"),
        (F.col("s_suppkey") % 3).cast("double").alias("g"),
    ).withColumn("min_journal_authenticity", F.when(F.col("g") == 0, F.lit(None)).otherwise(F.col("g") + 1)).drop("g")
    bad = ranking.validate_profiles(user)
    good = ranking.checked_profiles(ranking.built_in_profiles(v.spark)).where("half_life_years > 0").select(
        "profile", F.lit("built in").alias("violation"))
    return bad.unionByName(good)


# --- stored scores and entities ---


@check("score_by_paper", f"""
    SELECT research_paper_id AS paper_id, round({sql_mean(sql_unit('paper_authority_score'))}, 6) AS paper_authority_score,
           round({sql_mean(sql_unit('academic_authority_score'))}, 6) AS academic_authority_score,
           round({sql_mean(sql_unit('citation_influence_score'))}, 6) AS citation_influence_score,
           round({sql_mean(sql_unit('author_authority_score'))}, 6) AS author_authority_score,
           round({sql_mean(sql_unit('journal_authenticity_score'))}, 6) AS journal_authenticity_score, count(*) AS score_rows
    FROM score GROUP BY research_paper_id""")
def _(v):
    return scores.score_by_paper(v("score")).select(
        "paper_id", *[rounded(f).alias(f) for f in scores.SCORE_FIELDS], "score_rows")


@check("score_by_academic", f"""
    SELECT academic_id, round({sql_mean('x')}, 6) AS academic_authority_score FROM (
        SELECT {sql_unit('academic_authority_score')} AS x, unnest(academic_ids) AS academic_id FROM score) z
    WHERE x IS NOT NULL GROUP BY academic_id""")
def _(v):
    return scores.score_by_academic(v("score")).select(
        "academic_id", rounded("academic_authority_score").alias("academic_authority_score"))


@check("paper_entity", f"""
    WITH ps AS (SELECT research_paper_id AS pid, {sql_mean(sql_unit('paper_authority_score'))} AS pa,
                       {sql_mean(sql_unit('journal_authenticity_score'))} AS ja,
                       {sql_mean(sql_unit('citation_influence_score'))} AS ci FROM score GROUP BY 1)
    SELECT 'research_paper:' || p.id AS entity_id, p.name AS label, p.publication_date,
           round(ci, 6) AS citation_score, round(pa, 6) AS paper_authority_score, pa IS NOT NULL AS pa_ok,
           round(ja, 6) AS journal_score, ja IS NOT NULL AS ja_ok,
           concat_ws('|', p.primary_url, p.open_access_url, 'https://doi.org/' || p.doi) AS urls
    FROM research_paper p LEFT JOIN ps ON ps.pid = p.id""")
def _(v):
    return scores.paper_entity(v("research_paper"), scores.score_by_paper(v("score")).drop("score_rows")).select(
        "entity_id", "label", "publication_date", rounded("citation_score").alias("citation_score"),
        rounded("paper_authority_score").alias("paper_authority_score"),
        F.col("paper_authority_reproducible").alias("pa_ok"),
        rounded("journal_authenticity_score").alias("journal_score"),
        F.col("journal_authenticity_reproducible").alias("ja_ok"), joined("source_urls").alias("urls"))


@check("academic_entity", f"""
    WITH au AS (SELECT academic_id, {sql_mean('x')} AS s FROM (
        SELECT {sql_unit('academic_authority_score')} AS x, unnest(academic_ids) AS academic_id FROM score) z
        WHERE x IS NOT NULL GROUP BY academic_id)
    SELECT 'academic:' || a.id AS entity_id, a.name AS label, round(s, 6) AS academic_authority_score,
           concat_ws('|', a.profile_url, a.orcid_url) AS urls
    FROM academic a LEFT JOIN au ON au.academic_id = a.id""")
def _(v):
    return scores.academic_entity(v("academic"), scores.score_by_academic(v("score"))).select(
        "entity_id", "label", rounded("academic_authority_score").alias("academic_authority_score"),
        joined("source_urls").alias("urls"))


@check("metadata_entity", """
    SELECT 'university:' || id AS entity_id, 'university' AS kind, name AS label, ror_url AS urls FROM university
    UNION ALL SELECT 'faculty:' || id, 'faculty', name, '' FROM faculty
    UNION ALL SELECT 'discipline:' || id, 'discipline', name, '' FROM discipline
    UNION ALL SELECT 'field:' || id, 'field', name, '' FROM field
    UNION ALL SELECT 'journal:' || id, 'journal', name, '' FROM journal""")
def _(v):
    tables = {t: v(t) for t in scores.METADATA_TABLES}
    return scores.metadata_entity(tables).select("entity_id", "kind", "label", joined("source_urls").alias("urls"))


@check("validate_entities", """
    SELECT entity_id, violation FROM (
        SELECT 'part:' || p_partkey AS entity_id,
               CASE WHEN p_size % 4 = 0 THEN 'missing id or label' END AS violation FROM part
        UNION ALL SELECT 'part:' || p_partkey,
               CASE WHEN p_retailprice > 1000 THEN 'citation_score outside [0, 1]' END FROM part) z
    WHERE violation IS NOT NULL""")
def _(v):
    e = scores.academic_entity(v("lib_academic"))
    p = v("part").select(
        F.concat(F.lit("part:"), F.col("p_partkey")).alias("entity_id"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_name")).otherwise("").alias("label"),
        (F.col("p_retailprice") / 1000).alias("citation_score"),
        *[F.lit(None).cast("double").alias(f) for f in scores.SCORE_FIELDS if f != "citation_influence_score"])
    good = scores.validate_entities(e)
    return scores.validate_entities(p).unionByName(good)
