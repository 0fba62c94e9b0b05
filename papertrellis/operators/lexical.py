"""Query planning, the searchable corpus, BM25 and the other retrieval rules.

Everything is batched: a table of queries meets a table of documents. Postings
are built inside each document row, so only postings of terms that some query
uses ever leave their task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.functions.text import fold, id_array, strip, term_counts, tokens
from papertrellis.operators.scores import PUBLICATION, RESEARCHER, namespaced
from papertrellis.session import cut_lineage, is_small

# Words that choose a ranking profile, matched anywhere in the text.
RECENT_WORDS = ("latest", "recent", "newest", "current")
FOUNDATIONAL_WORDS = ("foundational", "seminal", "classic")

# Stop list of the alternative scorer.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "of", "on", "or",
    "that", "the", "to", "what", "with",
)

# Filter keys that read a relation, the table that names its ids, and the kinds that carry it.
RELATION_FILTERS = {
    "university": ("university", "university_ids", (PUBLICATION, RESEARCHER)),
    "university_id": ("university", "university_ids", (PUBLICATION, RESEARCHER)),
    "institution": ("university", "university_ids", (PUBLICATION, RESEARCHER)),
    "faculty": ("faculty", "faculty_ids", (PUBLICATION,)),
    "faculty_id": ("faculty", "faculty_ids", (PUBLICATION,)),
    "discipline": ("discipline", "discipline_ids", (RESEARCHER,)),
    "discipline_id": ("discipline", "discipline_ids", (RESEARCHER,)),
    "field": ("field", "field_ids", (RESEARCHER,)),
    "field_id": ("field", "field_ids", (RESEARCHER,)),
}

PLAIN_FILTERS = (
    "id", "name", "doi", "journal_id", "open_access_url", "primary_url", "academic_position",
    "profile_url", "orcid_url",
)


def plan_queries(
    queries: DataFrame,
    *,
    limit: int = 10,
    seed_limit: int = 10,
    target_kinds: tuple[str, ...] = (PUBLICATION, RESEARCHER),
) -> DataFrame:
    """Complete a table of (query_id, text, as_of, ...) to full query rows.

    Optional columns given by the caller win over the defaults. A blank text,
    an empty kind list or a limit below one fails the job.
    """
    defaults: dict[str, Column] = {
        "as_of": F.current_date(),
        "target_kinds": F.array(*[F.lit(k) for k in target_kinds]),
        "filters": F.create_map().cast("map<string,string>"),
        "limit": F.lit(limit),
        "seed_limit": F.lit(seed_limit),
        "require_evidence": F.lit(False),
    }
    lowered = F.lower("text")
    profile = (
        F.when(lowered.rlike("|".join(RECENT_WORDS)), "RECENT")
        .when(lowered.rlike("|".join(FOUNDATIONAL_WORDS)), "FOUNDATIONAL")
        .otherwise("GENERAL")
    )
    out = queries
    for name, value in defaults.items():
        given = F.coalesce(F.col(name), value) if name in queries.columns else value
        out = out.withColumn(name, given)
    if "profile" in queries.columns:
        profile = F.coalesce(F.col("profile"), profile)
    broken = (
        F.when(F.coalesce(strip(F.col("text")), F.lit("")) == "", "query text is empty")
        .when(F.size("target_kinds") == 0, "no target kind")
        .when((F.col("limit") <= 0) | (F.col("seed_limit") <= 0), "limits must be positive")
    )
    return out.withColumn(
        "text", F.when(broken.isNull(), F.col("text")).otherwise(F.raise_error(broken))
    ).select(
        "query_id", "text", "as_of", "target_kinds", "filters", profile.alias("profile"),
        "limit", "seed_limit", "require_evidence",
    )


def corpus_documents(papers: DataFrame | None, academics: DataFrame | None) -> DataFrame:
    """Searchable text of papers and academics with the columns filters read."""
    parts = []
    if papers is not None:
        parts.append(_documents(
            papers, "research_paper", PUBLICATION,
            F.concat_ws(" ", "name", F.concat_ws(" ", id_array(F.col("keywords"))), "doi", "publication_type")
            if "keywords" in papers.columns else F.concat_ws(" ", "name", "doi", "publication_type"),
        ))
    if academics is not None:
        parts.append(_documents(
            academics, "academic", RESEARCHER, F.concat_ws(" ", "name", "academic_position")
        ))
    out = parts[0]
    for extra in parts[1:]:
        out = out.unionByName(extra)
    return out


def _documents(df: DataFrame, table: str, kind: str, text: Column) -> DataFrame:
    def optional(name: str, kind_ddl: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind_ddl)

    relations = ("university_ids", "faculty_ids", "discipline_ids", "field_ids")
    return df.where(F.col("id").isNotNull()).select(
        namespaced(table, "id").alias("entity_id"),
        F.lit(kind).alias("kind"),
        text.alias("text"),
        *[id_array(optional(r, "array<string>")).alias(r) for r in relations],
        optional("is_open_access", "boolean").alias("is_open_access"),
        optional("publication_type", "string").alias("publication_type"),
        F.map_filter(
            F.create_map(*[x for c in PLAIN_FILTERS for x in (F.lit(c), optional(c, "string"))]),
            lambda _k, v: v.isNotNull(),
        ).alias("attributes"),
    )


def index_documents(docs: DataFrame, stop_words: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: length and array<struct<term,tf>>, besides the columns ``keep`` of ``docs``.

    Write the result once (``write_index``) when several batches search the
    same corpus; tokenising is the expensive part. Texts never move: a scan that
    has too few tasks is split by spark.sql.files.maxPartitionBytes.
    """
    toks = tokens(F.col("text"))
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*stop_words))
    return docs.withColumn("_tokens", toks).select(
        "entity_id", "kind", *keep, F.size("_tokens").alias("doc_len"), term_counts(F.col("_tokens")).alias("terms")
    )


def write_index(docs: DataFrame, path: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    index_documents(docs, stop_words).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def postings(index: DataFrame) -> DataFrame:
    return index.select("entity_id", "kind", "doc_len", F.inline("terms"))


def term_document_frequency(index: DataFrame) -> DataFrame:
    """In how many documents each term occurs."""
    return postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: document count and average length (1 for an empty corpus)."""
    mean = F.avg("doc_len")
    return index.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.when(F.coalesce(mean, F.lit(0.0)) == 0.0, 1.0).otherwise(mean).alias("avgdl"),
    )


def query_terms(queries: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, term, qtf): how often each query asks for each term."""
    toks = tokens(F.col("text"))
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*stop_words))
    return queries.select("query_id", F.inline(term_counts(toks))).withColumnRenamed("tf", "qtf")


#: Pairs of a query and a document's term that a task adds up.
PAIRS = 250_000


def _tasks(matches: DataFrame) -> int:
    """How many tasks the pairs of ``matches`` (asked terms with their ``df``) are dealt over, so that a task's share doesn't grow with them."""
    return max(1, -(-(matches.agg(F.sum("df")).first()[0] or 0) // PAIRS))


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def query_kinds(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct("target_kinds")).alias("kind"))


def bm25(
    queries: DataFrame,
    index: DataFrame,
    *,
    k1: float = 1.2,
    b: float = 0.75,
    stop_words: tuple[str, ...] = (),
    minimum_average: float = 0.0,
) -> DataFrame:
    """(query_id, entity_id, score) for every document that shares a term with the query.

    Statistics cover the documents of the query's own kinds. Scores are rounded
    to 10 digits, so equal documents tie whatever order their terms are summed in.

    One shuffle moves the matching postings by document, into as many tasks as
    the pairs they will make need; the per-(query, document) sums then need none,
    and the caller's top-k filter trims each task's output before it is shuffled
    by query.
    """
    terms = query_terms(queries, stop_words)
    small = is_small(terms)
    wanted = postings(index).join(_hint(terms.select("term").distinct(), small), "term")
    kinds = query_kinds(queries)
    df_by_kind = cut_lineage(wanted.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")))
    totals = index.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len"))
    stats = (
        kinds.join(totals, "kind").groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        .select("query_id", "n", _average(F.col("len") / F.col("n"), minimum_average).alias("avgdl"))
    )
    matches = terms.join(kinds, "query_id").join(df_by_kind, ["kind", "term"])
    weights = (
        matches
        .groupBy("query_id", "term").agg(F.first("qtf").alias("qtf"), F.sum("df").alias("df"))
        .join(stats, "query_id")
        .select("query_id", "term", (F.col("qtf") * _idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl")
        .join(kinds, "query_id")
    )
    return _score(wanted, weights, ["kind", "term"], small, k1, b, _tasks(matches))


def _average(mean: Column, minimum: float) -> Column:
    if minimum:
        return F.greatest(F.lit(minimum), mean)
    return F.when(mean == 0, 1.0).otherwise(mean)


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _score(wanted: DataFrame, weights: DataFrame, on: list[str], small: bool, k1: float, b: float, tasks: int) -> DataFrame:
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("doc_len") / F.col("avgdl"))
    part = F.col("weight") * F.col("tf") * (k1 + 1.0) / norm
    return (
        wanted.repartition(tasks, "entity_id")
        .join(_hint(weights, small), on)
        .groupBy("query_id", "entity_id")
        .agg(F.sum(part).alias("score"))
        .where(F.col("score") > 0)
        .withColumn("score", _steady(F.col("score")))
    )


def _steady(score: Column) -> Column:
    """Rounded to 10 digits behind the point, or to 10 significant ones where that would lose a small score."""
    scale = F.pow(F.lit(10.0), 9.0 - F.floor(F.log10(score)))
    return F.when(score >= 1e-3, F.round(score, 10)).otherwise(F.round(score * scale) / scale)


# --- filters ---


def scope_key(queries: DataFrame) -> DataFrame:
    """Queries with the same kinds and filters share one scope, hence one set of statistics."""
    kinds = F.array_sort(F.array_distinct("target_kinds"))
    pairs = F.array_sort(F.map_entries("filters"))
    return queries.withColumn("scope_id", F.sha1(F.to_json(F.struct(kinds.alias("k"), pairs.alias("f")))))


def resolve_filter_ids(queries: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """(scope_id, key, value): every value a filter accepts.

    A relation filter accepts the value itself and each id whose name equals it
    without regard to case.
    """
    scoped = scope_key(queries)
    raw = scoped.select("scope_id", F.explode("filters").alias("key", "expected")).distinct()
    raw = raw.withColumn("key", F.when(F.lower("key").isin(*RELATION_FILTERS, "kind", "entity_type",
                                                          "is_open_access", "publication_type"),
                                       F.lower("key")).otherwise(F.col("key")))
    table_of = F.create_map(*[F.lit(x) for k, (t, _c, _n) in RELATION_FILTERS.items() for x in (k, t)])
    own = raw.select(
        "scope_id", "key",
        F.when(F.col("key") == "publication_type", fold(F.col("expected")))
        .when(F.col("key") == "is_open_access",
              F.when(F.lower("expected").isin("true", "1", "yes"), "true").otherwise("false"))
        .otherwise(F.col("expected")).alias("value"),
    )
    names = None
    for table, df in lookups.items():
        part = df.where(F.col("id").isNotNull()).select(
            F.lit(table).alias("table"), fold(F.coalesce(F.col("name"), F.lit(""))).alias("folded"),
            F.col("id").cast("string").alias("value"),
        )
        names = part if names is None else names.unionByName(part)
    if names is None:
        return own.distinct()
    named = (
        raw.withColumn("table", F.try_element_at(table_of, F.col("key")))
        .withColumn("folded", fold(F.col("expected")))
        .join(names, ["table", "folded"])
        .select("scope_id", "key", "value")
    )
    return own.unionByName(named).distinct()


def _keyed(key: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))


def document_attributes(docs: DataFrame) -> DataFrame:
    """(entity_id, kind, key, value) rows a filter can match."""
    entries = [
        F.array(
            F.struct(F.lit("kind").alias("key"), F.col("kind").alias("value")),
            F.struct(F.lit("entity_type").alias("key"), F.col("kind").alias("value")),
        )
    ]
    for key, (_table, column, kinds) in RELATION_FILTERS.items():
        ids = F.when(F.col("kind").isin(*kinds), F.col(column)).otherwise(F.array().cast("array<string>"))
        entries.append(_keyed(key, ids))
    is_pub = F.col("kind") == PUBLICATION
    entries.append(
        F.filter(
            F.array(
                F.struct(
                    F.lit("is_open_access").alias("key"),
                    F.when(is_pub, F.coalesce(F.col("is_open_access"), F.lit(False)).cast("string")).alias("value"),
                ),
                F.struct(
                    F.lit("publication_type").alias("key"),
                    F.when(is_pub, fold(F.coalesce(F.col("publication_type"), F.lit("")))).alias("value"),
                ),
            ),
            lambda s: s["value"].isNotNull(),
        )
    )
    entries.append(F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return docs.select("entity_id", "kind", F.inline(F.concat(*entries)))


def apply_filters(queries: DataFrame, docs: DataFrame, accepted: DataFrame) -> DataFrame:
    """(scope_id, entity_id) of every document that meets all filters of a filtered scope."""
    scoped = scope_key(queries).where(F.size("filters") > 0)
    scopes = scoped.select("scope_id", F.size("filters").alias("n_keys"),
                           F.array_distinct("target_kinds").alias("target_kinds")).dropDuplicates(["scope_id"])
    rules = accepted.join(scopes, "scope_id")
    matched = document_attributes(docs).join(_hint(rules, is_small(accepted)), ["key", "value"]).where(
        F.array_contains("target_kinds", F.col("kind"))
    )
    # All rows of a document sit in one task, so this combines before the shuffle.
    met = matched.groupBy("scope_id", "entity_id", "n_keys").agg(F.size(F.collect_set("key")).alias("n_met"))
    return met.where(F.col("n_met") == F.col("n_keys")).select("scope_id", "entity_id")


def bm25_filtered(
    queries: DataFrame, index: DataFrame, eligible: DataFrame, *, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """BM25 whose statistics cover the eligible documents of each query's scope."""
    scoped = scope_key(queries).where(F.size("filters") > 0).select("query_id", "scope_id", "text")
    terms = query_terms(scoped).join(scoped.select("query_id", "scope_id"), "query_id")
    small = is_small(terms)
    in_scope = index.join(eligible, "entity_id")
    stats = in_scope.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n"), _average(F.avg("doc_len"), 0.0).alias("avgdl")
    )
    wanted = in_scope.select("scope_id", "entity_id", "doc_len", F.inline("terms")).join(
        _hint(terms.select("scope_id", "term").distinct(), small), ["scope_id", "term"]
    )
    df = cut_lineage(wanted.groupBy("scope_id", "term").agg(F.count(F.lit(1)).alias("df")))
    matches = terms.join(df, ["scope_id", "term"])
    weights = (
        matches.join(stats, "scope_id")
        .select("query_id", "scope_id", "term", (F.col("qtf") * _idf(F.col("n"), F.col("df"))).alias("weight"),
                "avgdl")
    )
    return _score(wanted, weights, ["scope_id", "term"], small, k1, b, _tasks(matches))


# --- rules beside BM25 ---


def grams(term: Column) -> Column:
    """The distinct one-, two- and three-letter pieces of a term: a text that occurs in it begins with one of them."""

    def of(n: int) -> Column:
        return F.when(
            F.length(term) >= n,
            F.transform(F.sequence(F.lit(1), F.length(term) - (n - 1)), lambda i: F.substring(term, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def terms_containing(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term): terms that contain a word; ``words`` and ``vocabulary`` are distinct and not blank. No pair without a shared key is tried."""
    keyed = vocabulary.select("term", F.explode(grams(F.col("term"))).alias("key"))
    asked = words.select("word", F.substring("word", 1, 3).alias("key"))
    return keyed.join(asked, "key").where(F.col("term").contains(F.col("word"))).select("word", "term")


def short_needles(queries: DataFrame) -> DataFrame:
    """(query_id, target_kinds, needle, toks): the queries of two tokens at most, which alone can stand in a text that BM25 leaves unscored."""
    return queries.where(strip(F.col("text")) != "*").select(
        "query_id", "target_kinds", strip(fold(F.col("text"))).alias("needle"), tokens(F.col("text")).alias("toks")
    ).where((F.col("needle") != "") & (F.size("toks") <= 2))


def longest_token(toks: Column) -> Column:
    return F.array_max(F.transform(toks, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def sign_candidates(short: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, entity_id): texts that hold the first character of a needle without tokens."""
    wordless = short.where(F.size("toks") == 0).withColumn("key", F.substring("needle", 1, 1))
    if wordless.isEmpty():
        return wordless.select("query_id", F.col("key").alias("entity_id"))
    # a needle without tokens begins with none of the characters of tokens, nor with a blank, so runs of these need no looking at
    signs = F.regexp_replace(fold(F.col("text")), "[a-z0-9 ]+", "")
    return (
        docs.select("entity_id", F.explode(F.array_distinct(F.split(signs, ""))).alias("key"))
        .join(_hint(wordless.select("query_id", "key"), is_small(short)), "key")
        .select("query_id", "entity_id")
    )


def holding(candidates: DataFrame, short: DataFrame, docs: DataFrame, unscored: bool = False) -> DataFrame:
    """The candidates whose text holds the needle, of the query's kinds; with ``unscored`` only those that share no token with the query.

    Candidates travel to the texts while they are few; texts of others never move.
    """
    small = is_small(short)
    asked = cut_lineage(candidates.join(_hint(short.select("query_id", "needle", "target_kinds", "toks"), small), "query_id"))
    few = is_small(asked)
    texts = docs.select("entity_id", "kind", "text")
    if not few:
        texts = texts.join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
    # a text is folded and cut into tokens once, whatever the number of its needles
    own = tokens(F.col("text")) if unscored else F.array().cast("array<string>")
    texts = texts.select("entity_id", "kind", fold(F.col("text")).alias("_folded"), own.alias("_own"))
    needles = asked.groupBy("entity_id").agg(F.collect_list(F.struct("query_id", "needle", "target_kinds", "toks")).alias("_asked"))
    held = lambda n: (
        F.col("_folded").contains(n["needle"]) & F.array_contains(n["target_kinds"], F.col("kind")) & ~F.arrays_overlap(F.col("_own"), n["toks"]))
    return texts.join(_hint(needles, few), "entity_id").select("entity_id", F.explode(F.filter("_asked", held)).alias("_n")).select("_n.query_id", "entity_id")


def substring_fallback(queries: DataFrame, docs: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, entity_id) where the folded query text occurs inside the folded document text.

    Only pairs BM25 leaves unscored matter to the caller, and a query of three
    or more tokens cannot leave one: its inner tokens stand whole in any text
    that contains it. So only shorter queries are looked up.

    No document is compared with every query. A query with a token is matched
    against the vocabulary through shared three-letter keys, then through
    postings; a query without one through its first character. A stored corpus
    (inverted.Store) looks pieces up as ranges of sorted suffixes instead.
    """
    q = short_needles(queries)
    if q.isEmpty():
        return q.select("query_id").join(docs.select("entity_id").limit(0), F.lit(True))
    worded = q.where(F.size("toks") > 0).withColumn("piece", longest_token(F.col("toks"))).withColumn("key", F.substring("piece", 1, 3))
    vocabulary = postings(index).select("term").distinct()
    keyed = vocabulary.select("term", F.explode(grams(F.col("term"))).alias("key"))
    found_terms = keyed.join(_hint(worded, is_small(q)), "key").where(F.col("term").contains(F.col("piece")))
    by_term = (
        postings(index).join(found_terms.select("term", "query_id"), "term").select("query_id", "entity_id").distinct()
    )
    return holding(by_term.unionByName(sign_candidates(q, docs)), q, docs)


def match_all(queries: DataFrame, docs: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """Hits of the text '*': every eligible entity scores 1, in id order.

    Queries of one scope share one list, cut at the largest seed limit any of
    them asks for, so nothing is multiplied by the number of queries.
    """
    stars = scope_key(queries).where(strip(F.col("text")) == "*")
    scopes = stars.groupBy("scope_id").agg(
        F.max("seed_limit").alias("most"), F.first("target_kinds").alias("target_kinds"),
        F.first(F.size("filters")).alias("n_filters"),
    )
    plain = scopes.where(F.col("n_filters") == 0)
    members = docs.select("entity_id", "kind").join(
        plain.select("scope_id", "most", F.explode(F.array_distinct("target_kinds")).alias("kind")), "kind"
    ).select("scope_id", "entity_id", "most")
    if eligible is not None:
        members = members.unionByName(
            eligible.join(scopes.where(F.col("n_filters") > 0), "scope_id").select("scope_id", "entity_id", "most")
        )
    # one constant for the batch, so every task's list is cut before it is shuffled
    most = int(stars.agg(F.max("seed_limit")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy("scope_id").orderBy("entity_id"))
    listed = members.withColumn("rank", place).where(F.col("rank") <= most).where(F.col("rank") <= F.col("most"))
    return stars.join(listed, "scope_id").where(F.col("rank") <= F.col("seed_limit")).select(
        "query_id", "entity_id", F.lit(1.0).alias("score")
    )


def top_seeds(scored: DataFrame, queries: DataFrame, channel: str = "lexical", most: int | None = None) -> DataFrame:
    """Hits: score descending, id ascending, the first ``seed_limit`` of each query.

    The first cut uses one constant, the largest seed limit of the batch, so
    Spark can trim every task's output before it moves rows by query.
    """
    if most is None:
        most = queries.agg(F.max("seed_limit")).first()[0] or 0
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    cut = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= int(most))
    return cut.join(queries.select("query_id", "seed_limit"), "query_id").where(
        F.col("rank") <= F.col("seed_limit")
    ).select("query_id", "entity_id", F.lit(channel).alias("channel"), "rank", F.col("score").alias("raw_score"))


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    index: DataFrame | None = None,
    lookups: dict[str, DataFrame] | None = None,
    *,
    with_filters: bool = True,
) -> DataFrame:
    """The lexical channel: BM25, then the substring rule, or everything for '*'."""
    # read by four branches below, so the tokens are written once unless an index is given
    index = cut_lineage(index_documents(docs)) if index is None else index
    text_queries = queries.where(strip(F.col("text")) != "*")
    plain = text_queries.where(F.size("filters") == 0) if with_filters else text_queries
    scored = bm25(plain, index)
    inside = substring_fallback(plain, docs, index)
    eligible = None
    if with_filters:
        eligible = apply_filters(queries, docs, resolve_filter_ids(queries, lookups or {}))
        filtered = text_queries.where(F.size("filters") > 0)
        scored = scored.unionByName(bm25_filtered(filtered, index, eligible))
        scopes = scope_key(filtered).select("query_id", "scope_id")
        found = substring_fallback(filtered, docs, index).join(scopes, "query_id")
        inside = inside.unionByName(
            found.join(eligible, ["scope_id", "entity_id"], "left_semi").select("query_id", "entity_id")
        )
    extra = inside.distinct().join(scored, ["query_id", "entity_id"], "left_anti").withColumn("score", F.lit(1.0))
    everything = match_all(queries, docs, eligible)
    return top_seeds(scored.unionByName(extra).unionByName(everything), queries)


# Rows of a block of query vectors and of document vectors, and columns of the grid that blocks of many queries are dealt to.
QUERY_BLOCK, VECTOR_BLOCK, GRID_COLUMNS = 512, 4_096, 256

_BLOCK = "ids array<string>, dim int, matrix binary"


def _unit(vectors: list) -> np.ndarray:
    m = np.asarray(vectors, dtype="float64")
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _packed(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """Vectors of unit length in blocks of at most ``rows``, packed where they lie; vectors of one length to a block."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, found = held.pop(dim)
            return pd.DataFrame({"ids": [ids], "dim": [dim], "matrix": [_unit(found).tobytes()]})

        for batch in batches:
            for i, v in zip(batch[name], batch["vector"]):
                ids, found = held.setdefault(len(v), ([], []))
                ids.append(i)
                found.append(v)
                if len(ids) == rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return vectors.select(F.col(name).cast("string").alias(name), "vector").mapInPandas(run, _BLOCK)


def dense_channel(
    query_vectors: DataFrame, doc_vectors: DataFrame, seed_limit: int = 10, channel: str = "dense"
) -> DataFrame:
    """Exact cosine of every (query_id, vector) against all (entity_id, vector) rows.

    Blocks of query vectors meet blocks of document vectors on a grid, one matrix product each; neither side passes through the driver,
    and the plan is the same for any number of queries. Few query blocks, by a count of their rows and bytes, are broadcast and document
    blocks stay where they are; more of them are dealt with the document blocks over the columns of the grid. A task hands on its best
    ``seed_limit`` of each query at its end. Vectors of unlike length do not meet.
    """
    asked = cut_lineage(_packed(query_vectors, "query_id", QUERY_BLOCK)).select(F.col("ids").alias("q_ids"), "dim", F.col("matrix").alias("q_matrix"))
    blocks = _packed(doc_vectors, "entity_id", VECTOR_BLOCK)
    if is_small(asked):
        pairs = blocks.join(F.broadcast(asked), "dim")
    else:
        column = F.pmod(F.xxhash64("ids"), F.lit(GRID_COLUMNS))
        pairs = blocks.withColumn("column", column).join(
            asked.withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_COLUMNS - 1).cast("long")))), ["dim", "column"])
    best = pairs.select("ids", "dim", "matrix", "q_ids", "q_matrix").mapInPandas(_best_of_task(seed_limit), "query_id string, entity_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= seed_limit).select(
        "query_id", "entity_id", F.lit(channel).alias("channel"), "rank", F.col("score").alias("raw_score")
    )


def _best_of_task(k: int):
    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, dim, matrix, q_ids, q_matrix in batch.itertuples(index=False):
                docs, queries = (np.frombuffer(m).reshape(-1, dim) for m in (matrix, q_matrix))
                entity = np.asarray(ids, dtype=object)
                scores = np.round(docs @ queries.T, 10)
                floor = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
                for j, (query_id, least) in enumerate(zip(q_ids, floor)):
                    some = np.flatnonzero(scores[:, j] >= least)
                    best, names = scores[some, j], entity[some]
                    if query_id in held:
                        best, names = np.concatenate([held[query_id][0], best]), np.concatenate([held[query_id][1], names])
                    order = np.lexsort((names.astype(str), -best))[:k]
                    held[query_id] = best[order], names[order]
        for query_id, (best, names) in held.items():
            yield pd.DataFrame({"query_id": query_id, "entity_id": names, "score": best})

    return run
