"""Offline factors over the works corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from papertrellis.checks.registry import check, joined, rounded
from papertrellis.checks.views import Views
from papertrellis.operators import factors, priors
from papertrellis.session import cut_lineage

SQL = {
    "fin": """
        SELECT id AS paper_id, year(publication_date) AS yr, lower(publication_type) AS pt,
               CAST(incoming_citation_count AS DOUBLE) AS c, field_id AS fld, academic_ids FROM research_paper""",
    "links": """
        SELECT CAST(paper_no AS VARCHAR) AS paper_id, CAST(academic_no AS VARCHAR) AS academic_id FROM authorship""",
    "coh": """
        SELECT *, count(c) OVER (PARTITION BY fld, yr, pt) AS n3, max(c) OVER (PARTITION BY fld, yr, pt) AS m3,
               count(c) OVER (PARTITION BY yr, pt) AS n2, max(c) OVER (PARTITION BY yr, pt) AS m2,
               count(c) OVER (PARTITION BY yr) AS n1, max(c) OVER (PARTITION BY yr) AS m1,
               max(c) OVER () AS m0 FROM fin""",
    "infl": """
        SELECT paper_id, yr, c, tier, CASE WHEN c IS NULL THEN NULL WHEN m <= 0 THEN 0e0
               ELSE ln(1 + c) / ln(1 + m) END AS i
        FROM (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN n3 >= 5 THEN 'field_year_type' WHEN n2 >= 5 THEN 'year_type'
                             WHEN n1 >= 5 THEN 'year' ELSE 'global' END AS tier,
                     CASE WHEN n3 >= 5 THEN m3 WHEN n2 >= 5 THEN m2 WHEN n1 >= 5 THEN m1 ELSE m0 END AS m FROM coh) z""",
    "ycount": "SELECT yr, count(*) AS n FROM infl WHERE i IS NOT NULL GROUP BY yr",
    "ytier": """
        SELECT a.yr, CASE WHEN any_value(CASE WHEN b.yr = a.yr THEN a.n END) >= 5 THEN 'year'
                          WHEN sum(b.n) >= 5 THEN 'year_plus_minus_one' ELSE 'global' END AS qt
        FROM ycount a JOIN ycount b ON b.yr BETWEEN a.yr - 1 AND a.yr + 1 GROUP BY a.yr""",
    "peer": """
        SELECT t.yr AS target, 'year' AS qt, i FROM infl JOIN ytier t ON t.yr = infl.yr AND t.qt = 'year' WHERE i IS NOT NULL
        UNION ALL SELECT t.yr, t.qt, i FROM infl JOIN ytier t ON infl.yr BETWEEN t.yr - 1 AND t.yr + 1
            AND t.qt = 'year_plus_minus_one' WHERE i IS NOT NULL
        UNION ALL SELECT t.yr, t.qt, i FROM infl JOIN ytier t ON t.qt = 'global' WHERE i IS NOT NULL""",
    "qlook": """
        SELECT DISTINCT target, qt, i, CASE WHEN n <= 1 THEN 0.5e0 ELSE (less + 0.5e0 * (eq - 1)) / (n - 1) END AS q FROM (
            SELECT target, qt, i, rank() OVER (PARTITION BY target ORDER BY i) - 1 AS less,
                   count(*) OVER (PARTITION BY target, i) AS eq, count(*) OVER (PARTITION BY target) AS n FROM peer) z""",
    "qual": """
        SELECT infl.paper_id, infl.i, infl.tier, l.q, l.qt FROM infl
        LEFT JOIN qlook l ON l.target = infl.yr AND l.i = infl.i""",
    "besti": """
        SELECT * FROM (SELECT l.academic_id, l.paper_id, f.i,
            row_number() OVER (PARTITION BY l.academic_id ORDER BY f.i DESC, l.paper_id) AS rn
            FROM links l JOIN infl f ON f.paper_id = l.paper_id WHERE f.i IS NOT NULL) z WHERE rn <= 6""",
    "auth": "SELECT academic_id, avg(i) AS a FROM besti WHERE rn <= 5 GROUP BY academic_id",
    "obs": """
        SELECT paper_id, avg(a) AS a FROM (
            SELECT paper_id, academic_id, avg(i) AS a FROM (
                SELECT l.paper_id, l.academic_id, b.i,
                       row_number() OVER (PARTITION BY l.paper_id, l.academic_id ORDER BY b.rn) AS k
                FROM links l JOIN besti b ON b.academic_id = l.academic_id AND b.paper_id <> l.paper_id) z
            WHERE k <= 5 GROUP BY ALL) y GROUP BY paper_id""",
    # --- the prior by its definition: every target against every paper of its cohorts ---
    "cohx": """
        SELECT *, count(*) FILTER (c = m3) OVER (PARTITION BY fld, yr, pt) AS t3,
               max(CASE WHEN c < m3 THEN c END) OVER (PARTITION BY fld, yr, pt) AS s3,
               count(*) FILTER (c = m2) OVER (PARTITION BY yr, pt) AS t2,
               max(CASE WHEN c < m2 THEN c END) OVER (PARTITION BY yr, pt) AS s2,
               count(*) FILTER (c = m1) OVER (PARTITION BY yr) AS t1, max(CASE WHEN c < m1 THEN c END) OVER (PARTITION BY yr) AS s1,
               count(*) FILTER (c = m0) OVER () AS t0, max(CASE WHEN c < m0 THEN c END) OVER () AS s0 FROM coh""",
    "tgt": "SELECT x.* FROM cohx x LEFT JOIN obs o ON o.paper_id = x.paper_id WHERE o.paper_id IS NULL",
    "together": """
        SELECT p.paper_id AS p, q.paper_id AS q, q.c,
               CASE WHEN q.n3 - CAST(q.yr = p.yr AND q.pt = p.pt AND q.fld = p.fld AS INT) >= 5
                    THEN CASE WHEN q.yr = p.yr AND q.pt = p.pt AND q.fld = p.fld AND p.c = q.m3 AND q.t3 = 1 THEN q.s3 ELSE q.m3 END
                    WHEN q.n2 - CAST(q.yr = p.yr AND q.pt = p.pt AS INT) >= 5
                    THEN CASE WHEN q.yr = p.yr AND q.pt = p.pt AND p.c = q.m2 AND q.t2 = 1 THEN q.s2 ELSE q.m2 END
                    WHEN q.n1 - CAST(q.yr = p.yr AS INT) >= 5
                    THEN CASE WHEN q.yr = p.yr AND p.c = q.m1 AND q.t1 = 1 THEN q.s1 ELSE q.m1 END
                    WHEN p.c = q.m0 AND q.t0 = 1 THEN q.s0 ELSE q.m0 END AS m
        FROM tgt p JOIN cohx q ON q.paper_id <> p.paper_id AND (q.yr = p.yr OR p.c = p.m0 AND p.t0 = 1)
        WHERE p.c IS NOT NULL AND q.c IS NOT NULL""",
    "changed": """
        SELECT p, q, i2 FROM (SELECT p, q, CASE WHEN coalesce(m, 0) <= 0 THEN 0e0 ELSE ln(1 + c) / ln(1 + m) END AS i2 FROM together) z
        JOIN infl f ON f.paper_id = q WHERE abs(i2 - f.i) > 1e-13""",
    "aff": """
        SELECT DISTINCT p, academic_id FROM (
            SELECT c.p, l.academic_id FROM changed c JOIN links l ON l.paper_id = c.q
            UNION ALL SELECT t.paper_id, l.academic_id FROM tgt t JOIN links l ON l.paper_id = t.paper_id WHERE t.c IS NOT NULL) z""",
    "newauth": """
        SELECT p, academic_id, avg(i) AS a FROM (
            SELECT a.p, a.academic_id, coalesce(c.i2, f.i) AS i, row_number() OVER (
                PARTITION BY a.p, a.academic_id ORDER BY coalesce(c.i2, f.i) DESC, l.paper_id) AS rn
            FROM aff a JOIN links l ON l.academic_id = a.academic_id AND l.paper_id <> a.p
            JOIN infl f ON f.paper_id = l.paper_id AND f.i IS NOT NULL
            LEFT JOIN changed c ON c.p = a.p AND c.q = l.paper_id) z WHERE rn <= 5 GROUP BY ALL""",
    "authhist": "SELECT round(a, 12) AS v, count(*) AS n FROM auth GROUP BY ALL",
    "without": """
        SELECT p, v, sum(n) AS n FROM (
            SELECT t.paper_id AS p, h.v, h.n FROM tgt t CROSS JOIN authhist h
            UNION ALL SELECT a.p, round(t.a, 12), -1 FROM aff a JOIN auth t ON t.academic_id = a.academic_id
            UNION ALL SELECT p, round(a, 12), 1 FROM newauth) z GROUP BY ALL HAVING sum(n) > 0""",
    "prior": """
        SELECT p AS paper_id, avg(v) AS prior FROM (
            SELECT p, v, n, sum(n) OVER (PARTITION BY p ORDER BY v) AS upto, sum(n) OVER (PARTITION BY p) AS total FROM without) z
        JOIN (SELECT unnest([1, 2]) AS k) places ON (total + k - 2) // 2 >= upto - n AND (total + k - 2) // 2 < upto GROUP BY p""",
}


@dataclass
class Snapshot:
    inputs: DataFrame
    papers: DataFrame
    links: DataFrame
    academics: DataFrame

    @classmethod
    def of(cls, v: Views) -> "Snapshot":
        inputs = factors.factor_inputs(v("research_paper").drop("paper_no"))
        papers = cut_lineage(factors.dedupe_papers(inputs))
        academics = v("academic").select("id", "research_paper_ids")
        return cls(inputs, papers, factors.authorship(papers, academics), academics)

    def influenced(self) -> DataFrame:
        return cut_lineage(factors.citation_influence(self.papers))


def factor_table(v: Views, s: Snapshot | None = None) -> DataFrame:
    """All factors per paper."""
    s = s or Snapshot.of(v)
    return priors.all_factors(s.papers, s.links)


@check("factor_inputs", """
    SELECT paper_id, yr AS year, pt AS ptype, c AS citations, fld AS field_id,
           array_to_string(list_sort(coalesce(academic_ids, [])), '|') AS authors FROM fin""", **SQL)
def _(v):
    return factors.factor_inputs(v("research_paper")).select(
        "paper_id", "year", "ptype", "citations", "field_id", joined("authors").alias("authors"))


@check("dedupe_papers", """
    SELECT paper_id, count(*) AS n_rows, min(prio) <> max(prio) OR min(yr) <> max(yr) AS conflict FROM (
        SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, l_returnflag AS prio, year(l_shipdate) AS yr FROM lineitem
        WHERE l_orderkey % 7 <> 0) z GROUP BY paper_id""")
def _(v):
    rows = v("lineitem").select(
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey").cast("string")).alias("id"),
        F.col("l_shipdate").cast("date").alias("publication_date"), F.col("l_returnflag").alias("publication_type"),
        F.lit(None).cast("long").alias("incoming_citation_count"))
    return factors.dedupe_papers(factors.factor_inputs(rows), strict=False).select("paper_id", "n_rows", "conflict")


@check("authorship", "SELECT paper_id, academic_id FROM links", **SQL)
def _(v):
    return Snapshot.of(v).links


@check("citation_cohort", "SELECT paper_id, tier AS i_tier FROM infl", **SQL)
def _(v):
    return factors.choose_cohort(Snapshot.of(v).papers).select("paper_id", "i_tier")


@check("citation_influence", "SELECT paper_id, round(i, 6) AS influence FROM infl", **SQL)
def _(v):
    return Snapshot.of(v).influenced().select("paper_id", rounded("influence").alias("influence"))


@check("quality_percentile", "SELECT paper_id, round(q, 6) AS quality, qt AS q_tier FROM qual", **SQL)
def _(v):
    return factors.quality_percentile(Snapshot.of(v).influenced()).select(
        "paper_id", rounded("quality").alias("quality"), "q_tier")


@check("academic_authority", "SELECT academic_id, round(a, 6) AS authority FROM auth", **SQL)
def _(v):
    s = Snapshot.of(v)
    return factors.academic_authority(factors.best_papers(s.links, s.influenced())).select(
        "academic_id", rounded("authority").alias("authority"))


@check("paper_authority_observed", "SELECT paper_id, round(a, 6) AS observed FROM obs", **SQL)
def _(v):
    s = Snapshot.of(v)
    return factors.paper_authority_observed(s.links, factors.best_papers(s.links, s.influenced())).select(
        "paper_id", rounded("observed").alias("observed"))


@check("paper_authority_prior", """
    SELECT t.paper_id, round(p.prior, 6) AS prior FROM tgt t LEFT JOIN prior p ON p.paper_id = t.paper_id""", **SQL)
def _(v):
    return factor_table(v).where("authority_status <> 'observed'").select(
        "paper_id", rounded("prior").alias("prior"))


@check("authority_status", """
    SELECT f.paper_id, CASE WHEN o.paper_id IS NOT NULL THEN 'observed'
                            WHEN p.prior IS NOT NULL THEN 'imputed' ELSE 'unavailable' END AS status
    FROM fin f LEFT JOIN obs o ON o.paper_id = f.paper_id LEFT JOIN prior p ON p.paper_id = f.paper_id""", **SQL)
def _(v):
    return factor_table(v).select("paper_id", F.col("authority_status").alias("status"))


@check("snapshot_metrics", """
    SELECT (SELECT count(*) FROM fin) AS input_rows, 0 AS missing_id_rows, 0 AS duplicate_rows,
           (SELECT count(c) FROM fin) AS with_citations, (SELECT count(yr) FROM fin) AS with_year,
           (SELECT count(pt) FROM fin) AS with_type,
           (SELECT count(DISTINCT paper_id) FROM links) AS with_authors, (SELECT count(*) FROM links) AS relationships,
           (SELECT count(DISTINCT academic_id) FROM links) AS academics,
           (SELECT count(*) FROM infl WHERE tier = 'field_year_type') AS i_field_year_type,
           (SELECT count(*) FROM infl WHERE tier = 'year_type') AS i_year_type,
           (SELECT count(*) FROM infl WHERE tier = 'year') AS i_year,
           (SELECT count(*) FROM infl WHERE tier = 'global') AS i_global,
           (SELECT count(*) FROM qual WHERE qt = 'year') AS q_year,
           (SELECT count(*) FROM qual WHERE qt = 'year_plus_minus_one') AS q_year_plus_minus_one,
           (SELECT count(*) FROM qual WHERE qt = 'global') AS q_global""", **SQL)
def _(v):
    s = Snapshot.of(v)
    return factors.snapshot_metrics(s.papers, s.inputs, s.links, s.academics, factors.quality_percentile(s.influenced()))


@check("score_records", """
    SELECT q.paper_id AS research_paper_id, round(q.q, 6) AS paper_authority_score,
           round(q.i, 6) AS citation_influence_score, round(coalesce(o.a, p.prior), 6) AS author_authority_score
    FROM qual q LEFT JOIN obs o ON o.paper_id = q.paper_id LEFT JOIN prior p ON p.paper_id = q.paper_id""", **SQL)
def _(v):
    s = Snapshot.of(v)
    return priors.score_records(factor_table(v, s), s.inputs).select(
        "research_paper_id", rounded("paper_authority_score").alias("paper_authority_score"),
        rounded("citation_influence_score").alias("citation_influence_score"),
        rounded("author_authority_score").alias("author_authority_score"))


DIST = """'{f}' AS factor, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
    round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75,
    round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS max"""


@check("factor_distribution", f"""
    SELECT {DIST.format(f='influence')} FROM (SELECT i AS x FROM infl) z
    UNION ALL SELECT {DIST.format(f='quality')} FROM (SELECT q AS x FROM qual) z""", **SQL)
def _(v):
    q = factors.quality_percentile(Snapshot.of(v).influenced())
    out = factors.factor_distribution(q, "influence").unionByName(factors.factor_distribution(q, "quality"))
    return out.select("factor", *[rounded(n).alias(n) for n, _p in factors.QUANTILES])


@check("backfill_summary", f"""
    SELECT (SELECT count(*) FROM fin) AS output_rows, (SELECT count(q) FROM qual) AS with_quality,
           (SELECT count(i) FROM infl) AS with_influence, (SELECT count(*) FROM obs) AS observed,
           (SELECT count(prior) FROM prior) AS imputed,
           (SELECT count(*) FROM tgt) - (SELECT count(prior) FROM prior) AS unavailable,
           (SELECT round(quantile_cont(prior, 0.5), 6) FROM prior) AS prior_median,
           (SELECT round(quantile_cont(x, 0.5), 6) FROM (SELECT a AS x FROM obs UNION ALL SELECT prior FROM prior) z) AS authority_median,
           (SELECT round(quantile_cont(q, 0.5), 6) FROM qual) AS quality_median,
           (SELECT round(quantile_cont(i, 0.5), 6) FROM infl) AS influence_median, true AS ids_map""", **SQL)
def _(v):
    s = Snapshot.of(v)
    return priors.backfill_summary(factor_table(v, s), s.inputs).select(
        "output_rows", "with_quality", "with_influence", "observed", "imputed", "unavailable",
        rounded("prior_median").alias("prior_median"), rounded("authority_median").alias("authority_median"),
        rounded("quality_median").alias("quality_median"), rounded("influence_median").alias("influence_median"),
        "ids_map")


@check("provenance_report", """
    SELECT f.paper_id AS research_paper_id,
           CASE WHEN o.paper_id IS NULL THEN 'imputed' ELSE 'observed' END AS author_authority_status,
           CASE WHEN o.paper_id IS NULL THEN round(p.prior, 6) END AS imputation_prior
    FROM fin f LEFT JOIN obs o ON o.paper_id = f.paper_id LEFT JOIN prior p ON p.paper_id = f.paper_id""", **SQL)
def _(v):
    return priors.provenance_report(factor_table(v)).select(
        "research_paper_id", "author_authority_status",
        rounded("author_authority_imputation_prior").alias("imputation_prior"))
