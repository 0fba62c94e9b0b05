"""Profiles of a batch of academics: bounded expansion from each, then publications, affiliation and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from papertrellis.functions.text import strip
from papertrellis.operators import apps, graph, scores
from papertrellis.plans.search import Corpus
from papertrellis.session import cut_lineage


@dataclass
class Profiles:
    rows: DataFrame
    relations: DataFrame
    publications: DataFrame
    evidence: DataFrame


def academic_heads(corpus: Corpus, ids: DataFrame) -> DataFrame:
    """(query_id, id, name, institution, discipline, position, official_profile_url) of ``ids`` (query_id, id), from the stored rows alone."""
    tables = corpus.tables
    stored = ids.join(tables["academic"], "id")
    near_label = apps.first_related_name(stored.select("id", "university_ids").distinct(), "university_ids",
                                         tables["university"], "institution")
    disc = apps.first_related_name(stored.select("id", "discipline_ids").distinct(), "discipline_ids",
                                   tables["discipline"], "discipline")
    text = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    return stored.join(near_label, "id", "left").join(disc, "id", "left").select(
        "query_id", "id", F.coalesce(text("name"), F.col("id")).alias("name"), "institution", "discipline",
        text("academic_position").alias("position"),
        F.coalesce(text("profile_url"), text("orcid_url")).alias("official_profile_url"))


def academic_profiles(corpus: Corpus, ids: DataFrame, evidence: DataFrame, budget: graph.Budget | None = None) -> Profiles:
    """ids: (query_id, id). Each academic seeds its own walk with relevance 1."""
    tables = corpus.tables
    stored = ids.join(tables["academic"], "id")
    people = stored.select("query_id", "id", scores.namespaced("academic", "id").alias("entity_id"))
    near = graph.neighbourhood(people.select("query_id", F.col("entity_id").alias("node_id")), tables, budget)
    edges = cut_lineage(near.edges)
    none = F.array().cast("array<string>")
    seeds = people.select("query_id", "entity_id", F.lit(1.0).alias("rrf_score"), F.lit(1).alias("fused_rank"),
                          none.alias("evidence_ids"))
    walked = cut_lineage(graph.expand(seeds, near.nodes, edges, budget, seed_limit=1))
    # only edges that touch the academic show in a profile, so the others of its walk are left where they are
    own = edges.join(people.select("query_id", F.col("entity_id").alias("academic_id")), "query_id").where("academic_id in (source_id, target_id)")
    used = walked.where("kind = 'edge'").select("query_id", F.col("target_id").alias("edge_id")).join(own, ["query_id", "edge_id"]).withColumn("evidence_ids", none)
    relations = apps.profile_relations(used)
    paper_scores = scores.score_by_paper(tables["score"]).drop("score_rows")
    entities = scores.paper_entity(tables["research_paper"], paper_scores).unionByName(
        scores.metadata_entity({t: d for t, d in tables.items() if t in scores.METADATA_TABLES}))
    publications = cut_lineage(apps.profile_publications(relations, entities))
    academics = people.withColumn("evidence_ids", none)
    proof = apps.profile_evidence(academics, relations, publications, evidence)
    summary = apps.grounded_summary(academics, publications, proof)
    counts = publications.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_publications"))
    cut = graph.truncation_flag(walked, near.truncated, people)
    rows = (
        academic_heads(corpus, ids).join(summary, "query_id", "left")
        .join(counts, "query_id", "left").join(cut, "query_id", "left")
        .select(
            "query_id", "id", "name", "institution", "discipline", "position", "official_profile_url", "summary_status", "summary_text",
            F.coalesce("n_publications", F.lit(0)).alias("n_publications"), "truncated"))
    return Profiles(rows, relations, publications, proof)
