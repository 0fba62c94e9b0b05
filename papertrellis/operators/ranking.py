"""Deterministic, gated ranking of retrieval and graph candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papertrellis.operators.scores import PUBLICATION, RESEARCHER

PROFILE_COLUMNS = (
    "profile", "w_pub_retrieval", "w_pub_graph", "w_citation", "w_recency", "w_paper_authority",
    "w_res_retrieval", "w_res_graph", "half_life_years", "min_journal_authenticity",
)

# The built-in ranking profiles.
BUILT_IN_PROFILES = (
    ("GENERAL", 0.65, 0.20, 0.07, 0.03, 0.05, 0.75, 0.25, 8.0, 0.50),
    ("RECENT", 0.60, 0.18, 0.04, 0.18, 0.00, 0.75, 0.25, 2.0, 0.50),
    ("FOUNDATIONAL", 0.65, 0.20, 0.12, 0.00, 0.03, 0.75, 0.25, 25.0, 0.50),
)


def built_in_profiles(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{r[0]}', {', '.join(f'{x}D' for x in r[1:])})" for r in BUILT_IN_PROFILES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(PROFILE_COLUMNS)})")


def _close(total: Column) -> Column:
    return F.abs(total - 1.0) <= 1e-9 * F.greatest(F.abs(total), F.lit(1.0))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that break a rule, with the reason."""
    pub = sum((F.col(c) for c in PROFILE_COLUMNS[2:6]), F.col("w_pub_retrieval"))
    res = F.col("w_res_retrieval") + F.col("w_res_graph")
    return profiles.select(
        "profile",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~_close(pub) | ~_close(res), F.lit("weights do not sum to one")),
                    F.when(F.col("half_life_years") <= 0, F.lit("half-life not positive")),
                    F.when(~F.col("min_journal_authenticity").between(0.0, 1.0), F.lit("gate outside [0, 1]")),
                )
            )
        ).alias("violation"),
    )


def checked_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles whose use fails the job when one of them breaks a rule."""
    bad = validate_profiles(profiles).groupBy("profile").agg(F.min("violation").alias("_why"))
    return (
        profiles.join(bad, "profile", "left")
        .withColumn(
            "profile",
            F.when(F.col("_why").isNull(), F.col("profile")).otherwise(
                F.raise_error(F.concat(F.lit("ranking profile "), F.col("profile"), F.lit(": "), F.col("_why")))
            ),
        )
        .drop("_why")
    )


def recency(published: Column, as_of: Column, half_life: Column) -> Column:
    """Half for every half-life of age; the future counts as today, no date as zero."""
    age = F.greatest(F.lit(0), F.datediff(as_of, published)) / F.lit(365.25)
    return F.when(published.isNotNull(), F.pow(F.lit(0.5), age / half_life)).otherwise(0.0)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def score_candidates(candidates: DataFrame, queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Components, gates and final score of every candidate.

    ``candidates`` carries query_id, the entity columns, retrieval_score,
    graph_score and evidence_ids; ``queries`` the planned query columns.
    """
    q = queries.select("query_id", "as_of", "profile", "limit", "require_evidence")
    p = profiles.withColumnRenamed("profile", "_known")
    df = candidates.join(q, "query_id").join(p, F.col("profile") == F.col("_known"), "left")
    # on the key of the ranking window, so that column pruning cannot drop the check
    df = df.withColumn(
        "query_id",
        F.when(F.col("_known").isNotNull(), F.col("query_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown ranking profile: "), F.col("profile")))
        ),
    )
    is_pub, is_res = F.col("kind") == PUBLICATION, F.col("kind") == RESEARCHER
    df = df.withColumns(
        {
            "c_citation": _zero("citation_score"),
            "c_recency": recency(F.col("publication_date"), F.col("as_of"), F.col("half_life_years")),
            "c_paper_authority": F.when(
                F.col("paper_authority_reproducible"), _zero("paper_authority_score")
            ).otherwise(0.0),
            "c_author_authority": _zero("author_authority_score"),
            "gate_reasons": F.array_compact(
                F.array(
                    F.when(F.col("require_evidence") & (F.size("evidence_ids") == 0), F.lit("missing_evidence")),
                    F.when(
                        is_pub
                        & F.col("journal_authenticity_reproducible")
                        & (F.col("journal_authenticity_score") < F.col("min_journal_authenticity")),
                        F.lit("journal_authenticity_gate"),
                    ),
                    F.when(~(is_pub | is_res), F.concat(F.lit("unsupported_ranking_kind="), F.col("kind"))),
                )
            ),
            "ignored_signals": F.array_compact(
                F.array(F.when(F.col("academic_authority_score").isNotNull(), F.lit("academic_authority_score")))
            ),
        }
    )
    publication = (
        F.col("w_pub_retrieval") * F.col("retrieval_score")
        + F.col("w_pub_graph") * F.col("graph_score")
        + F.col("w_citation") * F.col("c_citation")
        + F.col("w_recency") * F.col("c_recency")
        + F.col("w_paper_authority") * F.col("c_paper_authority")
    )
    researcher = F.col("w_res_retrieval") * F.col("retrieval_score") + F.col("w_res_graph") * F.col("graph_score")
    raw = F.when(is_pub, publication).when(is_res, researcher).otherwise(0.0)
    both = [
        (F.lit("retrieval"), F.round("retrieval_score", 12)),
        (F.lit("graph"), F.round("graph_score", 12)),
    ]
    only_pub = [
        (F.lit(name), F.round(f"c_{name}", 12))
        for name in ("citation", "recency", "paper_authority", "author_authority")
    ]
    flat = [x for pair in both for x in pair]
    flat_pub = flat + [x for pair in only_pub for x in pair]
    return df.withColumns(
        {
            "eligible": F.size("gate_reasons") == 0,
            # Rounded before any sort, so last-digit noise cannot change the order.
            "final_score": F.when(F.size("gate_reasons") == 0, F.round(raw, 12)).otherwise(0.0),
            "score_breakdown": F.when(is_pub, F.create_map(*flat_pub)).otherwise(F.create_map(*flat)),
        }
    )


def rank(candidates: DataFrame, queries: DataFrame, profiles: DataFrame) -> DataFrame:
    """Eligible first, score descending, id ascending; the first ``limit`` per query."""
    scored = score_candidates(candidates, queries, profiles)
    order = Window.partitionBy("query_id").orderBy(F.desc("eligible"), F.desc("final_score"), "entity_id")
    dropped = [c for c in scored.columns if c.startswith(("w_", "c_", "_"))] + [
        "half_life_years", "min_journal_authenticity", "as_of", "require_evidence", "profile",
    ]
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("limit")).drop(
        *dropped, "limit"
    )
