"""Reciprocal-rank fusion of ranked channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def first_per_channel(hits: DataFrame) -> DataFrame:
    """One row per (query, channel, entity): its best place in that channel."""
    return hits.groupBy("query_id", "channel", "entity_id").agg(
        F.min(F.struct("rank", "raw_score")).alias("_first")
    ).select("query_id", "channel", "entity_id", "_first.rank", "_first.raw_score")


def rrf(hits: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1/(k + rank) over channels, as a share of the query's best."""
    if k <= 0:
        raise ValueError("k must be positive")
    fused = first_per_channel(hits).groupBy("query_id", "entity_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 15).alias("raw_rrf_score"),
        F.count(F.lit(1)).alias("n_channels"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "raw_score")))).alias(
            "channel_raw_scores"
        ),
    )
    per_query = Window.partitionBy("query_id")
    best = F.max("raw_rrf_score").over(per_query)
    fused = fused.withColumn("rrf_score", F.col("raw_rrf_score") / best)
    order = per_query.orderBy(F.desc("rrf_score"), F.desc("n_channels"), "entity_id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def channel_maps(hits: DataFrame) -> DataFrame:
    """Per fused entity the channel -> rank and channel -> raw score maps, keys sorted."""
    return rrf(hits).select("query_id", "entity_id", "channel_ranks", "channel_raw_scores")


def validate_hits(hits: DataFrame) -> DataFrame:
    """Hits that break the channel contract, with the reason.

    Takes an optional ``kind`` column to check that an entity keeps one kind.
    """
    kind_clash = F.lit(None).cast("string")
    if "kind" in hits.columns:
        kinds = hits.groupBy("query_id", "entity_id").agg(
            (F.min("kind") != F.max("kind")).alias("_clash")
        )
        hits = hits.join(kinds, ["query_id", "entity_id"])
        kind_clash = F.when(F.col("_clash"), F.lit("conflicting kind"))
    return hits.select(
        "query_id",
        "entity_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(F.col("channel"), F.lit("")) == "", F.lit("empty channel")),
                    F.when(F.coalesce(F.col("rank"), F.lit(0)) < 1, F.lit("rank below one")),
                    kind_clash,
                )
            )
        ).alias("violation"),
    ).distinct()
