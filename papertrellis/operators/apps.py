"""Application queries: directory, publications, profiles and their payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.functions.relations import explode_ids
from papertrellis.functions.text import blank_to_null, fold, has_text, id_array, strip
from papertrellis.functions.urls import normalize_doi, validate_public_https_url
from papertrellis.operators.lexical import terms_containing
from papertrellis.operators.scores import PUBLICATION, RESEARCHER, namespaced
from papertrellis.session import broadcast_if_small, cut_lineage

RESULT_LIMIT = 25
SEED_LIMIT = 50
# Display sentences.
NO_DESCRIPTION = "No verified research description is available."
NO_SUMMARY = "Insufficient verified information is available to produce a reliable academic summary."


def search_papers(ranked: DataFrame) -> DataFrame:
    """Publications of a ranked list (the limit was applied before)."""
    return ranked.where(F.col("kind") == PUBLICATION).select(
        "query_id", "rank", F.col("entity_id").alias("paper_id"), F.col("label").alias("title"), "eligible",
        F.col("final_score").alias("score"), "score_breakdown", "evidence_ids", "source_urls")


def ranked_profiles(ranked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Ranked researchers that have a profile snapshot, each once, in order."""
    first = ranked.where(F.col("kind") == RESEARCHER).groupBy("query_id", "entity_id").agg(F.min("rank").alias("rank"))
    return first.join(snapshots, "entity_id")


def containing(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, id): rows of ``texts`` (id, _s) whose text contains a word; words hold no white space.

    A word lies inside one token of a text, so words meet the vocabulary of tokens, by shared letter keys, and then its postings.
    """
    tokens = F.explode(F.array_distinct(F.split("_s", r"(?U)\s+"))).alias("term")
    postings = texts.select("id", tokens).where("term <> ''")
    found = terms_containing(words.select("word").distinct(), postings.select("term").distinct())
    return postings.join(found, "term").select("word", "id").distinct()


def profile_text_search(snapshots: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id) where the folded query occurs in the label or a searchable text; blank finds none.

    The longest word of a query finds the few profiles whose texts are then searched for all of it.
    """
    texts = F.transform(F.concat(F.array("label"), id_array(F.col("searchable_text"))), fold)
    profiles = snapshots.select(F.col("entity_id").alias("id"), texts.alias("_t")).withColumn("_s", F.array_join("_t", " "))
    asked = queries.select("query_id", strip(fold(F.col("text"))).alias("needle")).where("needle <> ''")
    pieces = F.transform(F.split("needle", r"(?U)\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    asked = asked.withColumn("word", F.array_max(pieces)["w"])
    candidates = asked.join(containing(asked, profiles), "word").select("query_id", "needle", "id")
    return candidates.join(profiles.select("id", "_t"), "id").where(F.exists("_t", lambda t: t.contains(F.col("needle")))).select(
        "query_id", F.col("id").alias("entity_id"))


def query_words(queries: DataFrame) -> DataFrame:
    """Directory queries with their folded text and its words."""
    text = strip(fold(F.coalesce(F.col("text"), F.lit(""))))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return queries.withColumn("_text", text).withColumn("_words", words)


def _asked_words(asked: DataFrame) -> DataFrame:
    """(query_id, word, n): the different words of each query and how often it has them."""
    return asked.select("query_id", F.explode("_words").alias("word")).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))


def _for_blank(asked: DataFrame, everyone: DataFrame) -> DataFrame:
    """(query_id, and the columns of ``everyone``): a blank query takes all; that list is its result."""
    blank = asked.where(F.size("_words") == 0).select("query_id")
    return everyone.join(broadcast_if_small(blank), F.lit(True))


def matching_fields(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, field_id): fields whose name contains any query word; a blank query takes every field."""
    named = fields.where(F.col("id").isNotNull() & has_text(F.col("name"))).select(F.col("id").alias("field_id"))
    return _worded_fields(queries, fields).unionByName(_for_blank(query_words(queries), named))


def _worded_fields(queries: DataFrame, fields: DataFrame) -> DataFrame:
    named = fields.where(F.col("id").isNotNull() & has_text(F.col("name"))).select("id", fold(F.col("name")).alias("_s"))
    words = _asked_words(query_words(queries))
    return words.join(containing(words, named), "word").select("query_id", F.col("id").alias("field_id")).distinct()


def researchers_by_field(queries: DataFrame, academics: DataFrame, fields: DataFrame) -> DataFrame:
    """(query_id, id, score 0): academics that hold a matching field."""
    return _holders(matching_fields(queries, fields), academics)


def _holders(matched: DataFrame, academics: DataFrame) -> DataFrame:
    """(query_id, id, score 0) of academics that hold a matched field.

    Academics with the same fields share one list of queries, found once for each different list of fields; pairs of a query and an
    academic are made last and never move, unless ids are repeated.
    """
    people = academics.select("id", F.array_sort(F.array_distinct(id_array(F.col("field_ids")))).alias("_held"))
    lists = people.select("_held").distinct()
    asked = lists.select("_held", F.explode("_held").alias("field_id")).join(matched, "field_id").groupBy("_held").agg(
        F.collect_set("query_id").alias("_asked"))
    pairs = people.join(asked, "_held").select(F.explode("_asked").alias("query_id"), "id")
    if not people.groupBy("id").count().where("count > 1").isEmpty():
        pairs = pairs.distinct()
    return pairs.withColumn("score", F.lit(0))


def researchers_by_text(queries: DataFrame, academics: DataFrame) -> DataFrame:
    """(query_id, id, score): words found in name and position, plus all words again for the whole query; a blank one finds everyone."""
    everyone = _for_blank(query_words(queries), academics.select("id")).select("query_id", "id", F.lit(0).alias("score"))
    return _worded_text(queries, academics).unionByName(everyone)


def _worded_text(queries: DataFrame, academics: DataFrame) -> DataFrame:
    text = F.concat(fold(F.coalesce("name", F.lit(""))), F.lit(" "), fold(F.coalesce("academic_position", F.lit(""))))
    people = academics.select("id", text.alias("_s"))
    asked = query_words(queries)
    words = _asked_words(asked)
    met = words.join(containing(words, people), "word").groupBy("query_id", "id").agg(
        F.sum("n").alias("score"), F.count(F.lit(1)).alias("_kinds"))
    met = met.join(asked.select("query_id", "_text", F.size("_words").alias("_m"), F.size(F.array_distinct("_words")).alias("_all")), "query_id")
    # only where every word was met can the whole query stand
    whole = met.where(F.col("_kinds") == F.col("_all")).join(people, "id").where(F.col("_s").contains(F.col("_text"))).select(
        "query_id", "id", F.col("_m").alias("_more"))
    return met.select("query_id", "id", "score").join(whole, ["query_id", "id"], "left").select(
        "query_id", "id", (F.col("score") + F.coalesce("_more", F.lit(0))).cast("int").alias("score"))


def directory_filter(rows: DataFrame, queries: DataFrame, academics: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose academic has the query's university and discipline, by exact name."""
    out = rows
    for column, array, table in (("university", "university_ids", "university"), ("discipline", "discipline_ids", "discipline")):
        if column not in queries.columns:
            continue
        wanted = queries.select("query_id", F.col(column).alias("_name"))
        # only names that some query asks for travel with an academic
        some = wanted.where(has_text(F.col("_name"))).select("_name").distinct()
        names = tables[table].where(has_text(F.col("name"))).select(F.col("id").alias("_rid"), F.col("name").alias("_name")).join(some, "_name", "left_semi")
        named = academics.select("id", F.explode(id_array(F.col(array))).alias("_rid")).join(names, "_rid").select("id", "_name")
        asked = out.join(wanted, "query_id")
        free = asked.where(~has_text(F.col("_name"))).drop("_name")
        bound = asked.where(has_text(F.col("_name"))).join(named, ["id", "_name"], "left_semi").drop("_name")
        out = free.unionByName(bound)
    return out


def related_names(rows: DataFrame, array: str, table: DataFrame, out: str) -> DataFrame:
    """(id, out): names of the related rows in array order; ids without a name are skipped."""
    named = table.where(has_text(F.col("name"))).select(F.col("id").alias("_rid"), F.col("name").alias("_n"))
    found = explode_ids(rows, array, "_rid", keep=["id"]).join(named, "_rid")
    return found.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_n"))), lambda s: s["_n"]).alias(out))


def first_related_name(rows: DataFrame, array: str, table: DataFrame, out: str) -> DataFrame:
    """(id, out): name of the first id in the array that has one."""
    named = table.where(has_text(F.col("name"))).select(F.col("id").alias("_rid"), F.col("name").alias("_n"))
    return explode_ids(rows, array, "_rid", keep=["id"]).join(named, "_rid").groupBy("id").agg(
        F.min_by("_n", "pos").alias(out))


def _first(rows: DataFrame, keys: list[str], academics: DataFrame, most: int) -> DataFrame:
    """``rows`` (keys, id, score) with their rank in the order of a directory, up to ``most``; only names travel with them."""
    named = academics.select("id", fold(F.when(has_text(F.col("name")), F.col("name")).otherwise(F.col("id"))).alias("_fold"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "_fold", F.concat(F.lit("academic:"), "id"))
    return rows.join(named, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_fold")


def _blank_lists(blank: DataFrame, academics: DataFrame, tables: dict[str, DataFrame], most: int) -> DataFrame:
    """(query_id, id, score, rank): the first ``most`` of everyone who holds a named field, for blank queries.

    Blank queries with the same university and discipline share one list, found through the names that each academic has.
    """
    fields = tables["field"].where(F.col("id").isNotNull() & has_text(F.col("name"))).select(F.col("id").alias("field_id"))
    people = academics.select("id", "university_ids", "discipline_ids")
    if not fields.isEmpty():
        # ids of an academic side by side in its row, so no row moves to find the holders
        held = academics.select("id", "university_ids", "discipline_ids", F.explode(F.array_distinct(id_array(F.col("field_ids")))).alias("field_id"))
        people = held.join(broadcast_if_small(fields), "field_id", "left_semi").select("id", "university_ids", "discipline_ids").distinct()
    people = cut_lineage(people)
    keys, listed, asked = [], people.select("id"), blank.select("query_id")
    for column, array, table in (("university", "university_ids", "university"), ("discipline", "discipline_ids", "discipline")):
        if column not in blank.columns:
            continue
        keys.append(column)
        named = blank.select("query_id", F.when(has_text(F.col(column)), F.col(column)).otherwise("").alias(column))
        asked = asked.join(named, "query_id")
        # only names that some query asks for travel with an academic; none at all is a name of its own
        some = broadcast_if_small(named.select(column).distinct())
        names = tables[table].where(has_text(F.col("name"))).select(F.col("id").alias("_rid"), F.col("name").alias(column)).join(some, column, "left_semi")
        own = people.select("id", F.explode(id_array(F.col(array))).alias("_rid")).join(broadcast_if_small(names), "_rid").select("id", column).distinct()
        free = people.select("id", F.lit("").alias(column)).join(some, column, "left_semi")
        listed = listed.join(own.unionByName(free), "id") if len(keys) > 1 else own.unionByName(free)
    if not keys:
        keys, listed, asked = ["_all"], listed.withColumn("_all", F.lit("")), asked.withColumn("_all", F.lit(""))
    wanted = listed.join(broadcast_if_small(asked.select(*keys).distinct()), keys).withColumn("score", F.lit(0))
    return asked.join(cut_lineage(_first(wanted, keys, academics, most)), keys).select("query_id", "id", "score", "rank")


def researcher_results(
    queries: DataFrame, academics: DataFrame, tables: dict[str, DataFrame], limit: int = RESULT_LIMIT
) -> DataFrame:
    """Directory search: by field where a field matches, else by words; the first ``limit`` with their related names.

    Matches are ids and scores until each task has cut them to the few that can be shown; whether more were found follows from one
    row behind those. Blank queries share lists.
    """
    most = max(limit + 1, SEED_LIMIT)
    blank = query_words(queries).where(F.size("_words") == 0).drop("_text", "_words")
    worded = query_words(queries).where(F.size("_words") > 0).drop("_text", "_words")
    matched = cut_lineage(_worded_fields(worded, tables["field"]))
    by_field = _holders(matched, academics)
    by_text = _worded_text(worded.join(matched.select("query_id").distinct(), "query_id", "left_anti"), academics)
    rows = directory_filter(by_field.unionByName(by_text), worded, academics, tables)
    first = _first(rows, ["query_id"], academics, most).select("query_id", "id", "score", "rank")
    first = cut_lineage(first.unionByName(_blank_lists(blank, academics, tables, most)))
    sizes = first.groupBy("query_id").agg(F.max("rank").alias("_total"))
    people = academics.select(
        "id", F.when(has_text(F.col("name")), F.col("name")).otherwise(F.col("id")).alias("name"), "academic_position",
        "profile_url", "orcid_url", "university_ids", "discipline_ids", "field_ids")
    top = cut_lineage(people.join(broadcast_if_small(first.where(F.col("rank") <= limit)), "id"))
    shown = top.select("id", "university_ids", "discipline_ids", "field_ids").dropDuplicates(["id"])
    top = top.join(sizes, "query_id").join(
        first_related_name(shown, "university_ids", tables["university"], "institution"), "id", "left").join(
        first_related_name(shown, "discipline_ids", tables["discipline"], "discipline_name"), "id", "left").join(
        related_names(shown, "field_ids", tables["field"], "research_interests"), "id", "left")
    url = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    return top.select(
        "query_id", "rank", "id", "name", F.when(strip(F.col("academic_position")) != "", F.col("academic_position")).alias("position"),
        "institution", F.col("discipline_name").alias("discipline"),
        F.coalesce("research_interests", F.array().cast("array<string>")).alias("research_interests"),
        F.array_distinct(F.array_compact(F.array(url("profile_url"), url("orcid_url")))).alias("source_urls"),
        ((F.col("_total") >= SEED_LIMIT) | (F.col("_total") > limit)).alias("truncated"))


def researcher_payload(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id", "rank", "id", "name", F.col("institution").alias("university"), "discipline", "research_interests",
        F.coalesce(blank_to_null(F.col("position")), F.lit(NO_DESCRIPTION)).alias("description"),
        F.lit(NO_SUMMARY).alias("ai_summary"), F.lit("insufficient_information").alias("summary_status"),
        F.get("source_urls", 0).alias("official_profile_url"))


def source_url() -> Column:
    """Open access, primary, DOI, then the entity's own urls: the first that is not blank."""
    text = lambda c: F.when(strip(c) != "", c)
    doi = F.when(strip(F.col("doi")) != "", F.concat(F.lit("https://doi.org/"), F.col("doi")))
    return F.coalesce(text(F.col("open_access_url")), text(F.col("primary_url")), doi, F.get("entity_urls", 0))


def source_urls() -> Column:
    """Validated distinct urls in the same order; the DOI is repaired first."""
    valid = lambda c: validate_public_https_url(c, check_addresses=False)
    return F.array_distinct(F.array_compact(F.concat(
        F.array(valid(F.col("open_access_url")), valid(F.col("primary_url")), normalize_doi(F.col("doi"))),
        F.transform("entity_urls", valid))))


def hydrate_publications(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    """Ranked publications with the columns of their stored row."""
    stored = papers.select(namespaced("research_paper", "id").alias("entity_id"), F.col("id").alias("paper_id"), "doi",
                           "open_access_url", "primary_url")
    rows = ranked.where(F.col("kind") == PUBLICATION).withColumnRenamed("source_urls", "entity_urls").join(stored, "entity_id", "left")
    return rows.select(
        "query_id", "rank", "paper_id", "entity_id", F.col("label").alias("title"), "publication_date",
        F.when(strip(F.col("doi")) != "", F.col("doi")).alias("doi"), source_url().alias("source_url"),
        source_urls().alias("source_urls"), "final_score", "score_breakdown",
        F.col("paper_authority_score").isNotNull().alias("has_quality"),
        F.col("citation_score").isNotNull().alias("has_influence"),
        F.col("author_authority_score").isNotNull().alias("has_authority"), "evidence_ids")


def publication_truncation(fused: DataFrame, publications: DataFrame, truncated: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, truncated): expansion cut, seeds used up, or fused results not all shown."""
    n_fused = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("_f"))
    n_shown = publications.groupBy("query_id").agg(F.count(F.lit(1)).alias("_s"))
    rows = queries.select("query_id", "seed_limit").join(n_fused, "query_id", "left").join(n_shown, "query_id", "left").join(
        truncated, "query_id", "left")
    f, s = F.coalesce("_f", F.lit(0)), F.coalesce("_s", F.lit(0))
    return rows.select("query_id", (F.coalesce("truncated", F.lit(False)) | (f >= F.col("seed_limit")) | (f > s)).alias("truncated"))


def paper_payload(publications: DataFrame) -> DataFrame:
    """Rounded factors, null where unavailable, and what is available."""
    b = F.col("score_breakdown")
    only = lambda flag, key: F.when(F.col(flag), F.round(b[key], 6))
    return publications.select(
        "query_id", "rank", F.col("paper_id").alias("id"), "title", F.year("publication_date").cast("string").alias("year"),
        "doi", F.col("source_url").alias("url"), F.round("final_score", 6).alias("final_score"),
        F.round(F.coalesce(b["retrieval"], F.col("final_score")), 6).alias("H_hybrid_relevance"),
        only("has_quality", "paper_authority").alias("Q_quality"),
        only("has_influence", "citation").alias("I_citation_influence"),
        F.round(F.coalesce(b["recency"], F.lit(0.0)), 6).alias("T_temporal_validity"), F.lit(0.0).alias("N_innovation"),
        only("has_authority", "author_authority").alias("A_author_authority"),
        F.round(F.coalesce(b["graph"], F.lit(0.0)), 6).alias("G_graph_enrichment"), "has_quality", "has_influence", "has_authority")


def radar_factors(payload: DataFrame) -> DataFrame:
    """Five factors long-form; an unavailable or non-finite value shows as zero."""
    yes = F.lit(True)
    # Factor letters, their fields, and the flag each depends on.
    spec = (
        ("H", "H_hybrid_relevance", yes), ("Q", "Q_quality", F.col("has_quality")),
        ("I", "I_citation_influence", F.col("has_influence")), ("T", "T_temporal_validity", yes),
        ("A", "A_author_authority", F.col("has_authority")),
    )
    rows = F.array(*[
        F.struct(F.lit(k).alias("factor"), F.when(a, F.col(c)).alias("v"), a.alias("available")) for k, c, a in spec])
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    return payload.select("query_id", "rank", F.inline(rows)).select(
        "query_id", "rank", "factor", F.when(finite, F.col("v")).otherwise(0.0).alias("value"), "available")


def directory_options(table: DataFrame) -> DataFrame:
    """Distinct non-empty names, ordered without regard to case."""
    return table.where(has_text(F.col("name"))).select("name").distinct().orderBy(fold(F.col("name")), "name")


# --- profiles ---


def profile_relations(edges: DataFrame) -> DataFrame:
    """Used relations (query_id, academic_id, edge_id, source_id, target_id, relation, evidence_ids) that touch the academic."""
    me = F.col("academic_id")
    touching = edges.where((F.col("source_id") == me) | (F.col("target_id") == me))
    return touching.withColumn("related_id", F.when(F.col("source_id") == me, F.col("target_id")).otherwise(F.col("source_id")))


def profile_publications(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Authored publications of each profile in id order."""
    rows = relations.where("relation = 'AUTHORED'").select("query_id", F.col("related_id").alias("entity_id")).distinct().join(
        entities.where(F.col("kind") == PUBLICATION), "entity_id")
    order = Window.partitionBy("query_id").orderBy("entity_id")
    return rows.withColumn("rank", F.row_number().over(order))


def profile_institution(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, institution): label of the first affiliation by edge id that is known."""
    rows = relations.where("relation = 'AFFILIATED_WITH'").select("query_id", "edge_id", F.col("related_id").alias("entity_id"))
    return rows.join(entities.select("entity_id", "label"), "entity_id").groupBy("query_id").agg(
        F.min_by("label", "edge_id").alias("institution"))


def profile_evidence(academics: DataFrame, relations: DataFrame, publications: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, place, evidence columns): evidence of academic, relations and publications, best confidence first."""
    parts = (
        academics.select("query_id", F.explode("evidence_ids").alias("evidence_id"))
        .unionByName(relations.select("query_id", F.explode(id_array(F.col("evidence_ids"))).alias("evidence_id")))
        .unionByName(publications.select("query_id", F.explode("evidence_ids").alias("evidence_id")))
    )
    rows = parts.distinct().join(evidence, "evidence_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "evidence_id")
    return rows.withColumn("place", F.row_number().over(order))


def grounded_summary(academics: DataFrame, publications: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, summary_status, summary_text): from the first evidence of the academic and of a publication."""
    cite = F.concat(F.lit(" ["), F.col("evidence_id"), F.lit("]("), F.col("source_url"), F.lit(")"))
    item = F.struct(F.col("excerpt").alias("x"), cite.alias("c"))
    own = evidence.join(academics.select("query_id", F.col("entity_id").alias("_me")), "query_id").where(
        F.col("entity_id") == F.col("_me")).groupBy("query_id").agg(F.min_by(item, "place").alias("_own"))
    pubs = publications.select("query_id", F.col("entity_id"), F.lit(True).alias("_p"))
    theirs = evidence.join(pubs, ["query_id", "entity_id"]).groupBy("query_id").agg(F.min_by(item, "place").alias("_pub"))
    titles = publications.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("entity_id", "label"))), lambda s: s["label"]), "; ").alias("_titles"))
    rows = academics.select("query_id").join(own, "query_id", "left").join(theirs, "query_id", "left").join(titles, "query_id", "left")
    first = F.when(F.col("_own").isNotNull(), F.concat(
        F.lit("Current research directions and expertise: "), F.col("_own.x"), F.col("_own.c")))
    second = F.when(F.col("_pub").isNotNull() & F.col("_titles").isNotNull(), F.concat(
        F.lit("Representative research publications: "), F.col("_titles"),
        F.lit(". The available source describes this research as: "), F.col("_pub.x"), F.col("_pub.c")))
    some = first.isNotNull() | second.isNotNull()
    return rows.select(
        "query_id", F.when(some, "ok").otherwise("insufficient_information").alias("summary_status"),
        F.when(some, F.concat_ws("\n\n", first, second)).otherwise(NO_SUMMARY).alias("summary_text"))


def profile_payload(profiles: DataFrame) -> DataFrame:
    """Profile rows with defaults filled in."""
    return profiles.select(
        "query_id", "id", "name", F.col("institution").alias("university"), "discipline",
        F.coalesce(blank_to_null(F.col("position")), F.lit(NO_DESCRIPTION)).alias("description"),
        F.col("summary_text").alias("ai_summary"), "summary_status", "n_publications", "official_profile_url", "truncated")
