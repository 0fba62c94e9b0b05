"""Neutral prior of papers whose authors have no other cited paper.

The prior of paper p is the median academic authority of the corpus without p.
Recomputing the corpus per paper is quadratic; here only what p's absence
changes is computed, which is linear in total:

* p's own authors lose their authority (each equals I(p));
* a peer's I changes only if its cohort loses its only maximum (p), or has
  exactly five members and therefore gives way to the next coarser cohort.

A cohort has at most one only-maximum and a five-member cohort at most five
members, so the changed (p, peer) pairs stay proportional to the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.functions.relations import attach_row, cumulative_histogram
from papertrellis.operators.factors import (
    I_TIERS, MIN_COHORT, TOP_PAPERS, academic_authority, best_papers, citation_influence, cohort_stats,
    influence_value, paper_authority_observed, quality_percentile,
)
from papertrellis.session import cut_lineage

_KEYS = {
    "field_year_type": ["field_id", "year", "ptype"],
    "year_type": ["year", "ptype"],
    "year": ["year"],
    "global": [],
}
_BUCKETS = 4096
_PLACES = 4096


def cohort_key(tier: str) -> Column:
    """Text key of a paper's cohort at a tier; null where a part is missing."""
    parts = [F.lit(tier), *[F.col(k).cast("string") for k in _KEYS[tier]]]
    known = F.lit(True)
    for k in _KEYS[tier]:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.to_json(F.array(*parts)))


def _cohorts(stats: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tier in I_TIERS:
        part = stats[tier].select(cohort_key(tier).alias("cohort"), "size", "max1", "max2", "single_top")
        out = part if out is None else out.unionByName(part)
    return out


def changed_peers(influenced: DataFrame, targets: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """(p, peer, new_influence): peers whose I changes when target p is removed.

    ``targets`` holds paper_id of papers that need a prior.
    """
    cohorts = _cohorts(stats)
    cited = influenced.where(F.col("citations").isNotNull())
    chain = F.array(*[F.struct(F.lit(i).alias("level"), cohort_key(t).alias("cohort")) for i, t in enumerate(I_TIERS)])
    mine = (
        cited.join(targets.select("paper_id"), "paper_id", "left_semi")
        .select(F.col("paper_id").alias("p"), F.col("citations").alias("p_citations"), F.inline(chain))
        .where(F.col("cohort").isNotNull())
        .join(cohorts, "cohort")
        # the cohort once p is gone
        .withColumn("rest_size", F.col("size") - 1)
        .withColumn("p_is_top", F.col("single_top") & (F.col("p_citations") == F.col("max1")))
        .withColumn("rest_max", F.when(F.col("p_is_top"), F.col("max2")).otherwise(F.col("max1")))
    )
    last = len(I_TIERS) - 1
    usable = F.when((F.col("rest_size") >= MIN_COHORT) | (F.col("level") == last), F.struct("level", "rest_max"))
    # nearest usable cohort at this level or a coarser one
    onward = Window.partitionBy("p").orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    mine = mine.withColumn("next", F.min(usable).over(onward))
    breaks = (F.col("level") < last) & (F.col("size") == MIN_COHORT)
    shaken = mine.where(breaks | F.col("p_is_top")).select("p", "cohort", F.col("next.rest_max").alias("new_max"))
    user_key = F.coalesce(*[F.when(F.col("i_tier") == t, cohort_key(t)) for t in I_TIERS])
    users = cited.select(F.col("paper_id").alias("peer"), "citations", "influence", user_key.alias("cohort"))
    return (
        shaken.join(users, "cohort")
        .where(F.col("peer") != F.col("p"))
        .withColumn("new_influence", influence_value(F.col("citations"), F.coalesce("new_max", F.lit(0.0))))
        .where(F.col("new_influence") != F.col("influence"))
        .select("p", "peer", "new_influence")
    )


def ranked_papers(links: DataFrame, influenced: DataFrame) -> DataFrame:
    """(academic_id, place, paper_id, influence): every cited paper of an academic, best first.

    Numbered in two levels - value range and id hash, then inside them - so a
    prolific academic, or one with many equal values, is spread over tasks.
    """
    rows = links.join(influenced.where(F.col("influence").isNotNull()).select("paper_id", "influence"), "paper_id")
    rows = rows.withColumn(
        "_cell",
        F.struct(
            F.floor((1.0 - F.col("influence")) * 256).alias("v"),
            (1.0 - F.col("influence")).alias("exact"),
            F.pmod(F.xxhash64("paper_id"), F.lit(64)).alias("h"),
        ),
    ).withColumn("_b", F.col("_cell.v"))
    sizes = rows.groupBy("academic_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(
        "academic_id", "_b",
        (F.sum("_n").over(Window.partitionBy("academic_id").orderBy("_b")) - F.col("_n")).alias("_before"),
    )
    inside = Window.partitionBy("academic_id", "_b").orderBy("_cell.exact", "_cell.h", "paper_id")
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(sizes, ["academic_id", "_b"])
        .select("academic_id", (F.col("_before") + F.col("_rn")).alias("place"), "paper_id", "influence")
    )


def changed_authorities(changed: DataFrame, links: DataFrame, influenced: DataFrame, authority: DataFrame) -> DataFrame:
    """(p, academic_id, old, new) for academics whose authority differs without p.

    Of an academic with c changed papers only the best 5 + c old places can
    still count, so exactly those are fetched.
    """
    touched = changed.join(links.withColumnRenamed("paper_id", "peer"), "peer").select(
        "p", "academic_id", F.col("peer").alias("paper_id"), "new_influence"
    )
    depth = touched.groupBy("p", "academic_id").agg((F.count(F.lit(1)) + TOP_PAPERS).alias("depth"))
    kept = (
        depth.select("p", "academic_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))).alias("place"))
        .join(ranked_papers(links, influenced), ["academic_id", "place"])
        .join(touched.select("p", "academic_id", "paper_id"), ["p", "academic_id", "paper_id"], "left_anti")
        .select("p", "academic_id", "paper_id", "influence")
    )
    values = kept.unionByName(
        touched.select("p", "academic_id", "paper_id", F.col("new_influence").alias("influence"))
    )
    order = Window.partitionBy("p", "academic_id").orderBy(F.desc("influence"), "paper_id")
    fresh = (
        values.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= TOP_PAPERS)
        .groupBy("p", "academic_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "influence"))).alias("v"))
        .select(
            "p", "academic_id",
            (F.aggregate("v", F.lit(0.0), lambda s, x: s + x["influence"]) / F.size("v")).alias("new"),
        )
    )
    return fresh.join(authority.withColumnRenamed("authority", "old"), "academic_id").where(
        F.col("new") != F.col("old")
    ).select("p", "academic_id", "old", "new")


def _cells(first: Column, last: Column) -> Column:
    """The cells of _PLACES places that an interval of places touches."""
    return F.sequence(F.floor(first / _PLACES), F.floor(last / _PLACES))


def authority_ranks(authority: DataFrame) -> DataFrame:
    """(value, first, last, cell): the 0-based places that each value takes among the sorted authorities.

    Places are kept as intervals and never listed; a row stands in every cell of places that its interval touches.
    """
    hist = cumulative_histogram(authority, "authority")
    spans = hist.select(
        F.col("authority").alias("value"), F.col("n_less").alias("first"), (F.col("n_less") + F.col("n_equal") - 1).alias("last"))
    return spans.select("*", F.explode(_cells(F.col("first"), F.col("last"))).alias("cell"))


def paper_authority_prior(
    influenced: DataFrame, links: DataFrame, authority: DataFrame, observed: DataFrame, stats: dict[str, DataFrame]
) -> DataFrame:
    """(paper_id, prior) of every paper without an observed authority; prior null if nothing remains."""
    targets = influenced.select("paper_id", "influence").join(observed.select("paper_id"), "paper_id", "left_anti")
    own = links.join(targets.where(F.col("influence").isNotNull()).select("paper_id"), "paper_id", "left_semi").groupBy(
        "paper_id"
    ).agg(F.count(F.lit(1)).alias("k"))
    targets = targets.join(own, "paper_id", "left").withColumn("k", F.coalesce("k", F.lit(0)).cast("long"))
    total = authority.agg(F.count(F.lit(1)).alias("n_total"))
    ranks = cut_lineage(authority_ranks(authority))
    targets = cut_lineage(targets)
    changed = cut_lineage(changed_peers(influenced, targets, stats))
    changes = changed_authorities(changed, links, influenced, authority)
    deltas = changes.select("p", F.inline(F.array(
        F.struct(F.col("old").alias("value"), F.lit(-1).cast("long").alias("d")),
        F.struct(F.col("new").alias("value"), F.lit(1).cast("long").alias("d")),
    ))).groupBy("p", "value").agg(F.sum("d").alias("d")).where(F.col("d") != 0)
    deltas = cut_lineage(deltas)
    moved = deltas.groupBy("p").agg(F.sum(F.abs("d")).alias("m"))

    plain = _closed_form(targets.join(moved, F.col("paper_id") == F.col("p"), "left_anti"), authority, ranks, total)
    mixed = _shifted(targets.join(moved, F.col("paper_id") == F.col("p")).drop("p"), deltas, ranks, total)
    return plain.unionByName(mixed)


def _middle(n: Column) -> Column:
    return F.array(F.floor((n - 1) / 2), F.floor(n / 2))


def _closed_form(targets: DataFrame, authority: DataFrame, ranks: DataFrame, total: DataFrame) -> DataFrame:
    """k equal values leave the sorted list: later positions move down by k."""
    hist = cumulative_histogram(authority, "authority").select(F.col("authority").alias("_v"), F.col("n_less").alias("lo"))
    rows = attach_row(
        targets.join(hist, (F.col("influence") == F.col("_v")) & (F.col("k") > 0), "left"), total
    ).withColumn("rest", F.col("n_total") - F.col("k"))
    wanted = rows.select("paper_id", "k", "lo", "rest", F.explode(_middle(F.col("rest"))).alias("r")).where(
        F.col("rest") > 0
    ).withColumn("pos", F.when((F.col("k") == 0) | (F.col("r") < F.col("lo")), F.col("r")).otherwise(F.col("r") + F.col("k")))
    # Positions depend on k and on which side of the middle I(p) lies: a few distinct ones, bounded by
    # twice the number of distinct author counts.
    places = wanted.select("pos", F.floor(F.col("pos") / _PLACES).alias("cell")).distinct()
    few = ranks.join(places, "cell").where(F.col("pos").between(F.col("first"), F.col("last"))).select("pos", "value")
    found = wanted.join(few, "pos").groupBy("paper_id").agg(F.avg("value").alias("prior"))
    return targets.select("paper_id").join(found, "paper_id", "left")


def _shifted(targets: DataFrame, deltas: DataFrame, ranks: DataFrame, total: DataFrame) -> DataFrame:
    """Median after removals and insertions.

    M unit changes move any order statistic by at most M places, so only values
    with a place among the 2M around the middle are fetched per paper. Running sums go over value
    ranges first and rows inside a range second.
    """
    own = targets.where(F.col("k") > 0).select(
        F.col("paper_id").alias("p"), F.col("influence").alias("value"), (-F.col("k")).alias("d")
    )
    mine = targets.select(F.col("paper_id").alias("p"))
    d = deltas.join(mine, "p", "left_semi").unionByName(own).groupBy("p", "value").agg(F.sum("d").alias("d"))
    sized = (
        attach_row(targets, total)
        .select(
            F.col("paper_id").alias("p"),
            (F.col("n_total") - F.col("k")).alias("rest"),
            (F.col("m") + F.col("k")).alias("reach"),
            F.col("n_total"),
        )
        .where(F.col("rest") > 0)
    )
    spans = sized.select(
        "p",
        F.greatest(F.lit(0), F.floor((F.col("rest") - 1) / 2) - F.col("reach")).alias("lo"),
        F.least(F.col("n_total") - 1, F.floor(F.col("rest") / 2) + F.col("reach")).alias("hi"),
    ).where("lo <= hi")
    near = spans.select("*", F.explode(_cells(F.col("lo"), F.col("hi"))).alias("cell")).join(ranks, "cell")
    base = near.where("first <= hi and last >= lo").groupBy("p", "value").agg((F.max(F.least("last", "hi")) + 1).alias("upto"))
    none = F.lit(None).cast("long")
    points = base.withColumn("d", F.lit(0).cast("long")).unionByName(d.select("p", "value", none.alias("upto"), "d"))
    points = points.groupBy("p", "value").agg(F.max("upto").alias("upto"), F.sum("d").alias("d"))
    points = points.withColumn("_b", F.least(F.floor(F.col("value") * _BUCKETS), F.lit(_BUCKETS - 1)))
    ahead = Window.partitionBy("p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("p", "_b").agg(F.sum("d").alias("sd"), F.max("upto").alias("su")).select(
        "p", "_b", F.coalesce(F.sum("sd").over(ahead), F.lit(0)).alias("d0"),
        F.coalesce(F.max("su").over(ahead), F.lit(0)).alias("u0"),
    )
    inside = Window.partitionBy("p", "_b").orderBy("value")
    reached = (
        points.withColumn("cd", F.sum("d").over(inside)).withColumn("cu", F.max("upto").over(inside))
        .join(carried, ["p", "_b"])
        .select(
            "p", "value",
            (F.greatest(F.coalesce("cu", F.lit(0)), F.col("u0")) + F.col("cd") + F.col("d0")).alias("at_or_below"),
        )
    )
    wanted = sized.select("p", F.posexplode(_middle(F.col("rest"))).alias("which", "r"))
    found = (
        wanted.join(reached, "p").where(F.col("at_or_below") > F.col("r"))
        .groupBy("p", "which").agg(F.min("value").alias("value"))
        .groupBy("p").agg(F.avg("value").alias("prior"))
    )
    return targets.select("paper_id").join(found.withColumnRenamed("p", "paper_id"), "paper_id", "left")


def all_factors(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Every factor of a deduplicated snapshot: influence, quality, authority, status, prior, both tiers.

    Stage results that several later stages read are written to the shared
    checkpoint folder, so nothing upstream runs twice.
    """
    links = cut_lineage(links)
    stats = cohort_stats(papers)
    influenced = cut_lineage(citation_influence(papers, stats))
    best = cut_lineage(best_papers(links, influenced))
    observed = cut_lineage(paper_authority_observed(links, best))
    authority = cut_lineage(academic_authority(best))
    prior = paper_authority_prior(influenced, links, authority, observed, stats)
    return cut_lineage(authority_status(quality_percentile(influenced), observed, prior))


def authority_status(quality: DataFrame, observed: DataFrame, prior: DataFrame) -> DataFrame:
    """All factors per paper with authority, its status and, where imputed, its prior."""
    joined = quality.join(observed, "paper_id", "left").join(prior, "paper_id", "left")
    return joined.withColumns(
        {
            "authority": F.coalesce("observed", "prior"),
            "authority_status": F.when(F.col("observed").isNotNull(), "observed")
            .when(F.col("prior").isNotNull(), "imputed")
            .otherwise("unavailable"),
        }
    )


def score_records(table: DataFrame, inputs: DataFrame) -> DataFrame:
    """Import rows: one per paper; an id that is repeated or not in the source fails the job."""
    known = inputs.where(F.col("paper_id").isNotNull()).select("paper_id").distinct().withColumn("_known", F.lit(True))
    rows = table.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("_n"), F.first("quality").alias("quality"), F.first("influence").alias("influence"),
        F.first("authority").alias("authority"),
    ).join(known, "paper_id", "left")
    sound = (F.col("_n") == 1) & F.col("_known").isNotNull()
    checked = F.when(sound, F.col("paper_id")).otherwise(
        F.raise_error(F.concat(F.lit("repeated or unknown paper id "), F.col("paper_id")))
    )
    return rows.select(
        checked.alias("research_paper_id"),
        F.col("quality").alias("paper_authority_score"),
        F.col("influence").alias("citation_influence_score"),
        F.col("authority").alias("author_authority_score"),
    )


def backfill_summary(table: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: availability, status counts, medians, tier counts and the id check."""
    from papertrellis.operators.factors import Q_TIERS, factor_distribution

    known = inputs.where(F.col("paper_id").isNotNull()).select("paper_id").distinct()
    unknown = table.join(known, "paper_id", "left_anti").agg(F.count(F.lit(1)).alias("_unknown"))
    out = table.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.count("quality").alias("with_quality"),
        F.count("influence").alias("with_influence"),
        F.count("authority").alias("with_authority"),
        F.count_if(F.col("authority").isNull()).alias("null_authority"),
        *[F.count_if(F.col("authority_status") == s).alias(s) for s in ("observed", "imputed", "unavailable")],
        *[F.count_if(F.col("i_tier") == t).alias(f"i_{t}") for t in I_TIERS],
        *[F.count_if(F.col("q_tier") == t).alias(f"q_{t}") for t in Q_TIERS],
    )
    for value in ("quality", "influence", "authority", "prior"):
        dist = factor_distribution(table, value)
        out = attach_row(out, dist.select(*[F.col(c).alias(f"{value}_{c}") for c in ("min", "median", "max")]))
    return attach_row(out, unknown).withColumn("ids_map", F.col("_unknown") == 0).drop("_unknown")


def provenance_report(table: DataFrame) -> DataFrame:
    """Side table of the authority factor, apart from the score rows."""
    return table.select(
        F.col("paper_id").alias("research_paper_id"),
        F.col("authority_status").alias("author_authority_status"),
        F.when(F.col("authority_status") == "imputed", F.col("prior")).alias("author_authority_imputation_prior"),
    )


def provenance_summary(table: DataFrame) -> DataFrame:
    """The nested summary that goes with the side table."""
    from papertrellis.operators.factors import factor_distribution

    counts = table.agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.struct(
            *[F.count_if(F.col("authority_status") == s).alias(s) for s in ("observed", "imputed", "unavailable")]
        ).alias("status_count"),
    )
    imputed = table.where(F.col("authority_status") == "imputed")
    prior = factor_distribution(imputed, "prior").select(F.struct("*").alias("imputation_prior_distribution"))
    whole = factor_distribution(table, "authority").select(F.struct("*").alias("author_authority_distribution"))
    return attach_row(attach_row(counts, prior), whole)
