"""A batch of research questions from text to ranked entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from papertrellis.operators import fusion, graph, inverted, lexical, ranking, scores
from papertrellis.session import cut_lineage


@dataclass
class Corpus:
    """The readable tables; ``dense`` holds hits of an optional second channel.

    ``store`` is the corpus as inverted.write_store laid it out: a batch then reads only what its terms, filters and pieces fall into.
    ``adjacency`` holds the graph's lists as graph.write_adjacency stored them; without it each hop reads the tables.
    ``index`` is a forward index, read in full by every batch; without either, the texts are tokenised for each batch.
    """

    tables: dict[str, DataFrame]
    index: DataFrame | None = None
    store: inverted.Store | None = None
    adjacency: graph.Adjacency | None = None
    dense: DataFrame | None = None
    profiles: DataFrame | None = None

    def documents(self) -> DataFrame:
        return lexical.corpus_documents(self.tables.get("research_paper"), self.tables.get("academic"))

    def entities(self, wanted: DataFrame | None = None) -> DataFrame:
        """All entities, or those whose namespaced ids stand in the column ``entity_id`` of ``wanted``.

        Rows and scores of others are left out before scores are summed, so the work follows the candidates.
        """
        tables = dict(self.tables)
        if wanted is not None:
            ids = wanted.select(F.split("entity_id", ":", 2).alias("_e")).select(
                F.col("_e")[0].alias("_table"), F.col("_e")[1].alias("_id")).distinct()
            chosen = lambda table: ids.where(F.col("_table") == table).select("_id")
            for table in ("research_paper", "academic", *scores.METADATA_TABLES):
                if table in tables:
                    own = tables[table]
                    tables[table] = own.join(chosen(table), own["id"].cast("string") == F.col("_id"), "left_semi")
            stored = tables["score"]
            of_paper = stored.join(chosen("research_paper"), stored["research_paper_id"].cast("string") == F.col("_id"), "left_semi")
            of_person = scores.score_by_academic(stored, chosen("academic"))
        else:
            of_paper, of_person = tables["score"], scores.score_by_academic(tables["score"])
        papers = scores.paper_entity(tables["research_paper"], scores.score_by_paper(of_paper).drop("score_rows"))
        people = scores.academic_entity(tables["academic"], of_person)
        nodes = scores.metadata_entity({t: d for t, d in tables.items() if t in scores.METADATA_TABLES})
        return papers.unionByName(people).unionByName(nodes)


@dataclass
class Result:
    fused: DataFrame
    paths: DataFrame
    truncated: DataFrame
    ranked: DataFrame


def fuse(corpus: Corpus, queries: DataFrame, *, with_filters: bool = False) -> DataFrame:
    lookups = {t: d for t, d in corpus.tables.items() if t in ("university", "faculty", "discipline", "field")}
    if corpus.store is not None:
        hits = inverted.retrieve(queries, corpus.documents(), corpus.store, lookups, with_filters=with_filters)
    else:
        hits = lexical.retrieve(queries, corpus.documents(), corpus.index, lookups, with_filters=with_filters)
    if corpus.dense is not None:
        hits = hits.unionByName(corpus.dense)
    return cut_lineage(fusion.rrf(hits))


def expand(corpus: Corpus, queries: DataFrame, fused: DataFrame, budget: graph.Budget | None = None):
    """Paths and truncation of every query's fused seeds."""
    budget = budget or graph.Budget()
    seeds = fused.join(queries.select("query_id", "seed_limit"), "query_id")
    chosen = seeds.where(F.col("fused_rank") <= F.least(F.col("seed_limit"), F.lit(budget.max_entities))).select(
        "query_id", F.col("entity_id").alias("node_id")
    )
    near = graph.neighbourhood(chosen, corpus.tables, budget, corpus.adjacency)
    rows = seeds.select(
        "query_id", "entity_id", "rrf_score", "fused_rank", "seed_limit",
        F.array().cast("array<string>").alias("evidence_ids"),
    )
    paths = cut_lineage(graph.expand(rows, near.nodes, near.edges, budget))
    return paths, graph.truncation_flag(paths, near.truncated, queries)


def candidate_ids(fused: DataFrame, paths: DataFrame) -> DataFrame:
    """Entities that retrieval or the graph found for any query."""
    return fused.select("entity_id").unionByName(paths.select(F.col("target_id").alias("entity_id"))).distinct()


def retrieve_and_rank(
    corpus: Corpus, queries: DataFrame, budget: graph.Budget | None = None, *, with_filters: bool = False
) -> Result:
    """Retrieval, fusion, bounded expansion and ranking of planned queries."""
    fused = fuse(corpus, queries, with_filters=with_filters)
    paths, truncated = expand(corpus, queries, fused, budget)
    candidates = graph.merge_candidates(fused, paths, corpus.entities(candidate_ids(fused, paths)), queries)
    profiles = corpus.profiles
    if profiles is None:
        profiles = ranking.built_in_profiles(fused.sparkSession)
    else:
        profiles = ranking.checked_profiles(profiles)
    return Result(fused, paths, truncated, ranking.rank(candidates, queries, profiles))
