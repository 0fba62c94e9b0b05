"""Corpus-wide factors: citation influence (I), quality percentile (Q), author authority (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.functions.relations import attach_row, cumulative_histogram
from papertrellis.functions.text import blank_to_null, fold, identifier, parse_count, parse_year, strip
from papertrellis.schemas import with_optional
from papertrellis.session import cut_lineage

MIN_COHORT = 5
TOP_PAPERS = 5
I_TIERS = ("field_year_type", "year_type", "year", "global")
Q_TIERS = ("year", "year_plus_minus_one", "global")
QUANTILES = (("min", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", 1.0))


def clean_ids(c: Column) -> Column:
    ids = F.coalesce(c, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(ids, identifier))))


def factor_inputs(papers: DataFrame) -> DataFrame:
    """paper_id, year, ptype, citations, field_id, authors; a null id stays for the metrics."""
    papers = with_optional(papers, field_id="string", field_ids="array<string>", academic_ids="array<string>")
    fields = clean_ids(F.col("field_ids"))
    return papers.select(
        identifier(F.col("id")).alias("paper_id"),
        parse_year(F.col("publication_date"), papers.schema["publication_date"].dataType).alias("year"),
        blank_to_null(fold(strip(F.col("publication_type")))).alias("ptype"),
        parse_count(F.col("incoming_citation_count")).alias("citations"),
        F.coalesce(identifier(F.col("field_id")), F.when(F.size(fields) == 1, F.get(fields, 0))).alias("field_id"),
        clean_ids(F.col("academic_ids")).alias("authors"),
    )


def dedupe_papers(inputs: DataFrame, strict: bool = True) -> DataFrame:
    """One row per paper id with ``n_rows``; rows of one id must agree.

    ``strict`` fails the job on a disagreement, else ``conflict`` marks it.
    Comparing the smallest and largest signature needs no list of rows.
    """
    signature = F.struct("year", "ptype", "citations", "field_id", "authors")
    grouped = inputs.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(
        F.min(signature).alias("_lo"), F.max(signature).alias("_hi"), F.count(F.lit(1)).alias("n_rows")
    )
    conflict = ~F.col("_lo").eqNullSafe(F.col("_hi"))
    paper_id = F.col("paper_id")
    if strict:
        paper_id = F.when(~conflict, paper_id).otherwise(
            F.raise_error(F.concat(F.lit("conflicting inputs for duplicate paper id "), paper_id))
        )
    return grouped.select(paper_id.alias("paper_id"), "_lo.*", "n_rows", conflict.alias("conflict"))


def authorship(papers: DataFrame, academics: DataFrame | None = None) -> DataFrame:
    """Distinct (paper_id, academic_id) from both sides, for papers of the snapshot."""
    own = papers.select("paper_id", F.explode("authors").alias("academic_id"))
    if academics is None:
        return own.distinct()
    linked = academics
    if "seq" in academics.columns:
        linked = academics.groupBy("id").agg(F.max_by("research_paper_ids", "seq").alias("research_paper_ids"))
    links = linked.select(
        identifier(F.col("id")).alias("academic_id"), F.explode(clean_ids(F.col("research_paper_ids"))).alias("paper_id")
    ).where(F.col("academic_id").isNotNull())
    known = links.join(papers.select("paper_id"), "paper_id", "left_semi")
    return own.unionByName(known).distinct()


def cohort_stats(papers: DataFrame) -> dict[str, DataFrame]:
    """Size and two largest citation counts of every cohort, finest first.

    The finest grouping combines on the map side; the coarser tables aggregate
    its output, not the papers.
    """

    cited = papers.where(F.col("citations").isNotNull())
    # (value, how many papers have it) collapses ties before anything is ranked
    by_value = cut_lineage(
        cited.groupBy("field_id", "year", "ptype", "citations").agg(F.count(F.lit(1)).alias("n"))
    )

    def level(df: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
        for k in needed:
            df = df.where(F.col(k).isNotNull())
        grouped = df.groupBy(*keys) if keys else df.groupBy()
        first = grouped.agg(
            F.sum("n").alias("size"), F.max("citations").alias("max1"),
            F.max_by("n", "citations").alias("_n_top"), F.max("_below").alias("_below"),
        )
        return first.select(
            *keys, "size", "max1",
            F.when(F.col("_n_top") > 1, F.col("max1")).otherwise(F.col("_below")).alias("max2"),
            (F.col("_n_top") == 1).alias("single_top"),
        )

    out = {}
    for tier, keys in (
        ("field_year_type", ["field_id", "year", "ptype"]),
        ("year_type", ["year", "ptype"]),
        ("year", ["year"]),
        ("global", []),
    ):
        values = by_value.groupBy(*keys, "citations").agg(F.sum("n").alias("n"))
        tops = values.groupBy(*keys) if keys else values.groupBy()
        top = tops.agg(F.max("citations").alias("_top"))
        joined = values.join(top, keys) if keys else attach_row(values, top)
        joined = joined.withColumn("_below", F.when(F.col("citations") < F.col("_top"), F.col("citations")))
        out[tier] = cut_lineage(level(joined, keys, keys))
    return out


def choose_cohort(papers: DataFrame, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """Papers with ``i_tier`` and ``cohort_max``; both null where citations are missing.

    The choice depends on (field, year, type) only, so it is made once per
    combination and then joined to the papers.
    """
    stats = cohort_stats(papers) if stats is None else stats
    combos = papers.where(F.col("citations").isNotNull()).select("field_id", "year", "ptype").distinct()

    def named(tier: str, prefix: str) -> DataFrame:
        keep = [c for c in stats[tier].columns if c in ("field_id", "year", "ptype")]
        return stats[tier].select(*keep, F.col("size").alias(f"{prefix}_n"), F.col("max1").alias(f"{prefix}_m"))

    combos = attach_row(
        combos.join(named("field_year_type", "f"), ["field_id", "year", "ptype"], "left")
        .join(named("year_type", "t"), ["year", "ptype"], "left")
        .join(named("year", "y"), ["year"], "left"),
        named("global", "g"),
    )
    enough = [F.coalesce(F.col(f"{p}_n"), F.lit(0)) >= MIN_COHORT for p in ("f", "t", "y")]
    combos = combos.select(
        F.col("field_id").alias("_f"), F.col("year").alias("_y"), F.col("ptype").alias("_t"),
        F.when(enough[0], I_TIERS[0]).when(enough[1], I_TIERS[1]).when(enough[2], I_TIERS[2]).otherwise(I_TIERS[3])
        .alias("_tier"),
        F.when(enough[0], F.col("f_m")).when(enough[1], F.col("t_m")).when(enough[2], F.col("y_m"))
        .otherwise(F.col("g_m")).alias("_max"),
    )
    same = (
        F.col("field_id").eqNullSafe(F.col("_f"))
        & F.col("year").eqNullSafe(F.col("_y"))
        & F.col("ptype").eqNullSafe(F.col("_t"))
    )
    has = F.col("citations").isNotNull()
    return papers.join(combos, same, "left").select(
        *papers.columns, F.when(has, F.col("_tier")).alias("i_tier"), F.when(has, F.col("_max")).alias("cohort_max")
    )


def influence_value(citations: Column, maximum: Column) -> Column:
    value = F.when(maximum <= 0, 0.0).otherwise(F.log(1.0 + citations) / F.log(1.0 + maximum))
    return F.when(citations.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def citation_influence(papers: DataFrame, stats: dict[str, DataFrame] | None = None) -> DataFrame:
    """Papers with ``i_tier`` and ``influence``."""
    return choose_cohort(papers, stats).withColumn(
        "influence", influence_value(F.col("citations"), F.col("cohort_max"))
    )


def quality_percentile(influenced: DataFrame) -> DataFrame:
    """Papers with ``q_tier`` and ``quality``: the percentile of I among peers.

    Ranks come from histograms of distinct values, so a year that holds most
    of the corpus never meets in one task.
    """
    valued = influenced.where(F.col("influence").isNotNull())
    per_year = valued.where(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n_year"))
    around = (
        per_year.select(F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("year"), "n_year")
        .groupBy("year").agg(F.sum("n_year").alias("n_near"))
    )
    # one small row per year, read by three branches below
    tiers = cut_lineage(per_year.join(around, "year").select(
        "year",
        F.when(F.col("n_year") >= MIN_COHORT, Q_TIERS[0]).when(F.col("n_near") >= MIN_COHORT, Q_TIERS[1])
        .otherwise(Q_TIERS[2]).alias("q_tier"),
    ))
    near_years = tiers.where(F.col("q_tier") == Q_TIERS[1]).select(F.col("year").alias("_target"))
    near_values = (
        valued.where(F.col("year").isNotNull())
        .select("influence", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("_target"))
        .join(near_years, "_target", "left_semi")
        .withColumnRenamed("_target", "year")
    )

    def share(n_less: str = "n_less") -> Column:
        spread = (F.col(n_less) + 0.5 * (F.col("n_equal") - 1)) / (F.col("n_all") - 1)
        return F.when(F.col("n_all") <= 1, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), spread)))

    def lookup(df: DataFrame, tier: str, keys: list[str]) -> DataFrame:
        year = F.col("year") if keys else F.lit(None).cast("int")
        return cumulative_histogram(df, "influence", keys).select(
            F.lit(tier).alias("_tier"), year.alias("_year"), F.col("influence").alias("_value"), share().alias("quality")
        )

    table = (
        lookup(valued.where(F.col("year").isNotNull()), Q_TIERS[0], ["year"])
        .unionByName(lookup(near_values, Q_TIERS[1], ["year"]))
        .unionByName(lookup(valued, Q_TIERS[2], []))
    )
    tiered = influenced.join(tiers, "year", "left").withColumn(
        "q_tier", F.when(F.col("influence").isNotNull(), F.coalesce("q_tier", F.lit(Q_TIERS[2])))
    )
    own_year = F.when(F.col("q_tier") != Q_TIERS[2], F.col("year"))
    return tiered.join(
        table,
        (F.col("q_tier") == F.col("_tier")) & own_year.eqNullSafe(F.col("_year")) & (F.col("influence") == F.col("_value")),
        "left",
    ).drop("_tier", "_year", "_value")


def best_papers(links: DataFrame, influenced: DataFrame, keep: int = TOP_PAPERS + 1) -> DataFrame:
    """Per academic the ``keep`` papers of highest I, as an ordered array of (influence, paper_id).

    The row_number filter is applied before the shuffle too, so a prolific
    academic sends at most ``keep`` rows from each task.
    """
    rows = links.join(
        influenced.where(F.col("influence").isNotNull()).select("paper_id", "influence"), "paper_id"
    )
    order = Window.partitionBy("academic_id").orderBy(F.desc("influence"), "paper_id")
    top = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= keep)
    return top.groupBy("academic_id").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "influence", "paper_id"))).alias("best")
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def academic_authority(best: DataFrame) -> DataFrame:
    """Mean of the five highest I of each academic that has any."""
    top = F.transform(F.slice("best", 1, TOP_PAPERS), lambda s: s["influence"])
    return best.select("academic_id", _mean(top).alias("authority"))


def paper_authority_observed(links: DataFrame, best: DataFrame) -> DataFrame:
    """Per paper the mean, over its authors with other cited papers, of their top five without it."""
    pid = F.col("paper_id")
    others = F.transform(
        F.slice(F.filter("best", lambda s: s["paper_id"] != pid), 1, TOP_PAPERS), lambda s: s["influence"]
    )
    rows = links.join(best, "academic_id").select("paper_id", others.alias("o")).where(F.size("o") > 0)
    return rows.groupBy("paper_id").agg(F.avg(_mean(F.col("o"))).alias("observed"))


def snapshot_metrics(papers: DataFrame, inputs: DataFrame, links: DataFrame, academics: DataFrame | None,
                     scored: DataFrame) -> DataFrame:
    """One row of coverage counters."""
    rows = inputs.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("paper_id").isNull()).alias("missing_id_rows")
    )
    per_paper = papers.agg(
        (F.sum("n_rows") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count("citations").alias("with_citations"), F.count("year").alias("with_year"),
        F.count("ptype").alias("with_type"),
    )
    rel = links.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("with_authors"), F.coalesce(F.sum("n"), F.lit(0)).alias("relationships")
    )
    people = links.select("academic_id")
    if academics is not None:
        people = people.unionByName(
            academics.select(identifier(F.col("id")).alias("academic_id")).where(F.col("academic_id").isNotNull())
        )
    people = people.distinct().agg(F.count(F.lit(1)).alias("academics"))
    tiers = scored.agg(
        *[F.count_if(F.col("i_tier") == t).alias(f"i_{t}") for t in I_TIERS],
        *[F.count_if(F.col("q_tier") == t).alias(f"q_{t}") for t in Q_TIERS],
    )
    out = rows
    for one_row in (per_paper, rel, people, tiers):
        out = attach_row(out, one_row)
    return out


def factor_distribution(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """min/p25/median/p75/p90/max of a value in [0, 1], linearly interpolated, nulls ignored.

    Order statistics are read off the two-level histogram instead of gathering
    all values in one aggregation buffer.
    """
    hist = cumulative_histogram(df, value)
    wanted = F.array(*[F.struct(F.lit(n).alias("stat"), F.lit(p).alias("p")) for n, p in QUANTILES])
    at = (F.col("n_all") - 1) * F.col("p")
    rows = hist.select(value, "n_less", "n_equal", "n_all", F.inline(wanted)).withColumns(
        {"_lo": F.floor(at), "_frac": at - F.floor(at)}
    )
    rows = rows.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("n_all") - 1))
    covers = lambda r: (F.col(r) >= F.col("n_less")) & (F.col(r) < F.col("n_less") + F.col("n_equal"))
    picked = rows.where(covers("_lo") | covers("_hi")).groupBy("stat").agg(
        F.max(F.when(covers("_lo"), F.col(value))).alias("lo"),
        F.max(F.when(covers("_hi"), F.col(value))).alias("hi"),
        F.first("_frac").alias("frac"),
    )
    stats = picked.agg(
        *[
            F.max(F.when(F.col("stat") == n, F.col("lo") + F.col("frac") * (F.col("hi") - F.col("lo")))).alias(n)
            for n, _p in QUANTILES
        ]
    )
    return stats.select(F.lit(name or value).alias("factor"), *[n for n, _p in QUANTILES])
