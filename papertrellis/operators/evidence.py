"""Evidence packs, answer context and grounding of stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.functions.text import has_text, strip
from papertrellis.functions.urls import context_url, normalize_doi, validate_public_https_url

EVIDENCE_LIMIT = 8
CONTEXT_PAPERS = 10
CONTEXT_URLS = 3

# Url fetch outcomes that count as success.
FETCHED = ("success", "succeeded", "retrieved")

# Texts shown when no grounded answer exists.
NO_EVIDENCE_ANSWER = (
    "Ranked research papers were found, but validated evidence is not available to synthesize a reliable answer."
)
NO_PAPERS_ANSWER = "No ranked research papers were found for this question."


def evidence_items(ranked: DataFrame, evidence: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """(query_id, item_no, rank, evidence columns): evidence of eligible results in rank order.

    An item counts only for its own entity and only once; the first ``limit`` stay.
    Ranked results are bounded per query, so their ids are what is joined.
    """
    wanted = ranked.where("eligible").select(
        "query_id", "rank", "entity_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    found = wanted.join(evidence, ["evidence_id", "entity_id"])
    once = found.groupBy("query_id", "evidence_id").agg(
        F.min_by(F.struct("rank", "pos", "entity_id", "source_url", "excerpt", "confidence"), F.struct("rank", "pos")).alias("_i"))
    once = once.select("query_id", "evidence_id", "_i.*")
    order = Window.partitionBy("query_id").orderBy("rank", "pos")
    return once.withColumn("item_no", F.row_number().over(order)).where(F.col("item_no") <= limit).drop("pos")


def evidence_pack(ranked: DataFrame, evidence: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Per query: status, items, and entity ids met up to the stop."""
    if limit <= 0:
        raise ValueError("evidence limit must be positive")
    items = evidence_items(ranked, evidence, limit)
    packed = items.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "item_no", "evidence_id", "entity_id", "source_url", "excerpt", "confidence"))).alias("items"),
        F.max(F.when(F.col("item_no") == limit, F.col("rank"))).alias("_stop"))
    entities = (
        ranked.where("eligible").select("query_id", "rank", "entity_id")
        .join(packed.select("query_id", "_stop"), "query_id", "left")
        .where(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop")))
        .groupBy("query_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "entity_id"))), lambda s: s["entity_id"]).alias("entity_ids")))
    out = ranked.select("query_id").distinct().join(packed.drop("_stop"), "query_id", "left").join(entities, "query_id", "left")
    return out.select(
        "query_id", F.when(F.col("items").isNotNull(), "ready").otherwise("insufficient_evidence").alias("status"),
        "items", F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"))


def answer_status(packs: DataFrame, papers: DataFrame, outcomes: DataFrame | None = None, external: bool = False) -> DataFrame:
    """(query_id, evidence_status, answer_status): whether an answer may be generated and how it went.

    ``outcomes`` (query_id, outcome) holds recorded results of the generation
    step: 'generated', 'insufficient_evidence' or 'provider_error'.
    """
    counts = papers.groupBy("query_id").agg(F.count(F.lit(1)).alias("_papers"))
    out = packs.join(counts, "query_id", "left")
    may = (F.col("status") == "ready") | (F.lit(external) & (F.coalesce("_papers", F.lit(0)) > 0))
    done = F.lit(None).cast("string")
    if outcomes is not None:
        out = out.join(outcomes.select("query_id", "outcome"), "query_id", "left")
        done = F.col("outcome")
    return out.select(
        "query_id", F.col("status").alias("evidence_status"),
        F.when(~may, "insufficient_evidence").otherwise(F.coalesce(done, F.lit("generate"))).alias("answer_status"))


def ranked_context(publications: DataFrame) -> DataFrame:
    """Per query the ranked papers an answer may refer to, as an array in rank order.

    ``publications``: query_id, rank, paper_id, entity_id, title,
    publication_date, doi, final_score, score_breakdown, has_quality,
    has_influence, has_authority, source_urls.
    """
    b = F.col("score_breakdown")
    row = F.struct(
        "rank", "paper_id", "entity_id", "title", F.year("publication_date").alias("year"),
        normalize_doi(F.col("doi")).alias("doi"), "final_score",
        F.struct(
            b["retrieval"].alias("H_hybrid_relevance"), b["paper_authority"].alias("Q_quality"),
            b["citation"].alias("I_citation_influence"), b["recency"].alias("T_temporal_validity"),
            b["author_authority"].alias("A_author_authority")).alias("factor_scores"),
        F.struct(F.col("has_quality").alias("Q"), F.col("has_influence").alias("I"), F.col("has_authority").alias("A")).alias(
            "factor_availability"),
        "source_urls")
    return publications.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("papers"))


def candidate_urls(papers: DataFrame, most: int = CONTEXT_URLS) -> DataFrame:
    """(query_id, url_no, url): the first distinct valid urls across the ranked papers."""
    rows = papers.where(F.col("rank") <= CONTEXT_PAPERS).select(
        "query_id", "rank", F.posexplode("source_urls").alias("pos", "raw"))
    valid = rows.withColumn("url", context_url(F.col("raw"))).where(F.col("url").isNotNull())
    first = valid.groupBy("query_id", "url").agg(F.min(F.struct("rank", "pos")).alias("_at"))
    order = Window.partitionBy("query_id").orderBy("_at")
    return first.withColumn("url_no", F.row_number().over(order)).where(F.col("url_no") <= most).select(
        "query_id", "url_no", "url")


def grounding_context(contexts: DataFrame, packs: DataFrame, urls: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, context): one JSON text per query with papers, marked evidence, urls and the question.

    Factors that are not available are nulled; papers show only the chosen
    urls, and none where internal evidence exists.
    """
    chosen = urls.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("url_no", "url"))), lambda s: s["url"]).alias("_urls"))
    rows = questions.select("query_id", "text").join(contexts, "query_id", "left").join(
        packs.select("query_id", "items"), "query_id", "left").join(chosen, "query_id", "left")
    none = F.array().cast("array<string>")
    allowed = F.when(F.col("items").isNull(), F.coalesce("_urls", none)).otherwise(none)

    def safe(p: Column) -> Column:
        s, a = p["factor_scores"], p["factor_availability"]
        shown = F.struct(
            s["H_hybrid_relevance"].alias("H_hybrid_relevance"), F.when(a["Q"], s["Q_quality"]).alias("Q_quality"),
            F.when(a["I"], s["I_citation_influence"]).alias("I_citation_influence"),
            s["T_temporal_validity"].alias("T_temporal_validity"),
            F.when(a["A"], s["A_author_authority"]).alias("A_author_authority"))
        return F.struct(
            p["paper_id"].alias("paper_id"), p["entity_id"].alias("entity_id"), p["title"].alias("title"),
            p["year"].alias("year"), F.regexp_replace(p["doi"], "^https://doi.org/", "").alias("doi"),
            p["rank"].alias("rank"), p["final_score"].alias("final_score"), shown.alias("factor_scores"),
            a.alias("factor_availability"),
            F.array_intersect(p["source_urls"], F.col("_allowed")).alias("source_urls"))

    def marked(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("[S"), i["item_no"].cast("string"), F.lit("]")).alias("citation_marker"),
            i["evidence_id"].alias("evidence_id"), i["entity_id"].alias("paper_id"), i["source_url"].alias("source_url"),
            i["excerpt"].alias("validated_excerpt"))

    return rows.withColumn("_allowed", allowed).select(
        "query_id",
        F.to_json(
            F.struct(
                F.transform(F.slice("papers", 1, CONTEXT_PAPERS), safe).alias("ranked_papers_discovery_context_only"),
                F.transform("items", marked).alias("validated_internal_evidence"),
                F.col("_allowed").alias("bounded_url_context_candidates"), F.col("text").alias("user_question")),
            {"ignoreNullFields": "false"},
        ).alias("context"))


OUTPUT_SCHEMA = (
    "steps ARRAY<STRUCT<type: STRING, url: STRING, status: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING, "
    "url: STRING, status: STRING, annotations: ARRAY<STRUCT<type: STRING, url: STRING, title: STRING>>>>>>"
)


def ground_citations(
    outputs: DataFrame, items: DataFrame, titles: DataFrame, urls: DataFrame, external: bool = True
) -> DataFrame:
    """Citations of stored answers; an answer without any is withheld.

    outputs: query_id and ``steps`` (OUTPUT_SCHEMA); items: evidence items per
    query; titles: (query_id, entity_id, paper_id, title); urls: chosen
    candidate urls per query. Gives one row per query with answer, status and
    an array of citations.
    """
    steps = outputs.select("query_id", F.posexplode("steps").alias("s_pos", "s"))
    blocks = steps.where(F.col("s.type") == "model_output").select(
        "query_id", "s_pos", F.posexplode("s.content").alias("b_pos", "b")).where(F.col("b.type") == "text")
    trimmed = strip(F.coalesce(F.col("b.text"), F.lit("")))
    answers = blocks.where(trimmed != "").groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s_pos", "b_pos", trimmed.alias("t")))), lambda s: s["t"]), "\n").alias("answer"))
    notes = blocks.select("query_id", "s_pos", "b_pos", F.posexplode("b.annotations").alias("n_pos", "n")).select(
        "query_id", F.struct("s_pos", "b_pos", "n_pos").alias("note_at"), F.col("n.type").alias("type"),
        F.col("n.title").alias("title"), validate_public_https_url(F.col("n.url")).alias("url"),
    ).where(F.col("url").isNotNull())

    named = items.join(titles, ["query_id", "entity_id"], "left")
    internal = F.struct(
        F.coalesce(F.col("title"), F.col("evidence_id")).alias("source_title"), F.col("source_url"),
        F.lit("internal").alias("source_origin"), F.col("evidence_id"),
        F.coalesce(F.col("paper_id"), F.col("entity_id")).alias("paper_id"), F.col("excerpt").alias("evidence"))
    marker = F.concat(F.lit("[S"), F.col("item_no").cast("string"), F.lit("]"))
    zero = F.struct(F.lit(0).alias("s_pos"), F.lit(0).alias("b_pos"), F.lit(0).alias("n_pos"))
    by_marker = named.join(answers, "query_id").where(F.col("answer").contains(marker)).select(
        "query_id", F.lit(0).alias("side"), F.col("item_no"), zero.alias("note_at"), internal.alias("c"))
    # where items share a url, the last one stands for it
    last = Window.partitionBy("query_id", "source_url").orderBy(F.desc("item_no"))
    by_url_item = named.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    by_url = by_url_item.join(notes.select("query_id", "note_at", F.col("url").alias("source_url")), ["query_id", "source_url"]).select(
        "query_id", F.lit(1).alias("side"), F.lit(0).alias("item_no"), "note_at", internal.alias("c"))
    cites = by_marker.unionByName(by_url)
    if external:
        none = F.lit(None).cast("string")
        statuses = _fetch_statuses(steps)
        chosen = urls.select("query_id", "url", F.lit(True).alias("_chosen")).distinct()
        outside = notes.where("type = 'url_citation'").join(statuses, ["query_id", "url"], "left").where(
            F.col("fetched").isNull() | F.col("fetched")
        ).join(chosen, ["query_id", "url"], "left").select(
            "query_id", F.lit(2).alias("side"), F.lit(0).alias("item_no"), "note_at",
            F.struct(
                F.when(has_text(F.col("title")), F.col("title")).otherwise("External source").alias("source_title"),
                F.col("url").alias("source_url"),
                F.when(F.col("_chosen"), "external_url_context").otherwise("external_google_search").alias("source_origin"),
                none.alias("evidence_id"), none.alias("paper_id"), F.lit("").alias("evidence")).alias("c"))
        cites = cites.unionByName(outside)
    place = F.struct("side", "item_no", "note_at")
    once = cites.groupBy("query_id", "c.source_origin", "c.source_url").agg(
        F.min_by("c", place).alias("c"), F.min(place).alias("_at"))
    lists = once.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "c"))), lambda s: s["c"]).alias("citations"))
    out = outputs.select("query_id").join(answers, "query_id", "left").join(lists, "query_id", "left")
    grounded = has_text(F.col("answer")) & F.col("citations").isNotNull()
    return out.select(
        "query_id", F.when(grounded, F.col("answer")).otherwise("").alias("answer"),
        F.when(grounded, F.col("citations")).alias("citations"),
        F.when(grounded, "generated").otherwise("insufficient_evidence").alias("status"))


def _fetch_statuses(steps: DataFrame) -> DataFrame:
    """(query_id, url, fetched): last recorded fetch outcome of each url."""
    own = F.array(F.struct(F.col("s.url").alias("url"), F.col("s.status").alias("status")))
    nested = F.transform("s.content", lambda b: F.struct(b["url"].alias("url"), b["status"].alias("status")))
    rows = steps.where(F.col("s.type") == "url_context_result").select(
        "query_id", "s_pos",
        F.posexplode(F.when(F.col("s.url").isNotNull() & F.col("s.status").isNotNull(), own).otherwise(nested)).alias("pos", "r"))
    rows = rows.select("query_id", F.struct("s_pos", "pos").alias("at"), validate_public_https_url(F.col("r.url")).alias("url"),
                       F.lower("r.status").alias("status")).where(F.col("url").isNotNull() & has_text(F.col("status")))
    return rows.groupBy("query_id", "url").agg(F.max_by("status", "at").isin(*FETCHED).alias("fetched"))


def ask_payload(grounded: DataFrame, papers: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, answer, status, citations): the generated answer, or a fixed text that cites the papers.

    papers: query_id, rank, title, url.
    """
    record = F.struct("rank", F.struct(
        F.col("title").alias("source_title"), F.col("url").alias("source_url"),
        F.lit("internal_database_record").alias("source_origin")).alias("c"))
    listed = papers.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), record))), lambda s: s["c"]).alias("_records"))
    slim = F.transform("citations", lambda c: F.struct(
        c["source_title"].alias("source_title"), c["source_url"].alias("source_url"), c["source_origin"].alias("source_origin")))
    rows = questions.select("query_id").join(grounded, "query_id", "left").join(listed, "query_id", "left")
    ok = F.coalesce((F.col("status") == "generated") & has_text(F.col("answer")), F.lit(False))
    return rows.select(
        "query_id",
        F.when(ok, F.col("answer")).when(F.coalesce("_n", F.lit(0)) > 0, NO_EVIDENCE_ANSWER).otherwise(NO_PAPERS_ANSWER).alias(
            "answer"),
        F.when(ok, "generated").otherwise("insufficient_information").alias("status"),
        F.when(ok, slim).otherwise(F.col("_records")).alias("citations"))


def unique_citations(citations: DataFrame) -> DataFrame:
    """By url, else title: first position, last value. citations: query_id, pos, source_url, source_title, ..."""
    key = F.when(has_text(F.col("source_url")), F.col("source_url")).otherwise(F.col("source_title"))
    rest = [c for c in citations.columns if c not in ("query_id", "pos")]
    rows = citations.withColumn("_key", key)
    return rows.groupBy("query_id", "_key").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct(*rest), "pos").alias("_c")).select("query_id", "pos", "_c.*")
