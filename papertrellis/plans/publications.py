"""Publication search: questions in, payloads of ranked papers out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from papertrellis.operators import apps, graph, lexical
from papertrellis.plans import search


def search_publications(
    corpus: search.Corpus, questions: DataFrame, budget: graph.Budget | None = None, *, limit: int = 10, seed_limit: int = 20,
    with_filters: bool = False,
) -> DataFrame:
    """Paper payloads per question (query_id, text, as_of), with a flag per question that says whether anything was cut."""
    queries = lexical.plan_queries(questions, limit=limit, seed_limit=seed_limit, target_kinds=("publication",))
    found = search.retrieve_and_rank(corpus, queries, budget, with_filters=with_filters)
    papers = apps.hydrate_publications(found.ranked, corpus.tables["research_paper"])
    cut = apps.publication_truncation(found.fused, papers, found.truncated, queries)
    return apps.paper_payload(papers).join(cut, "query_id")
