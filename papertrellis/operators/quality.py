"""Quality report over collected academics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrellis.functions.relations import attach_row
from papertrellis.functions.text import has_text, strip

# Terms that mark a position as out of scope.
SUSPICIOUS_TERMS = (
    "student", "phd", "candidate", "administrator", "administration", "professional staff", "project officer",
    "research assistant", "honours",
)
LONG_INTEREST = 250
SHOWN_INTEREST = 200


def _filled(column: str):
    return F.coalesce(F.size(column) > 0, F.lit(False)) if column in ("research_interests", "areas_of_expertise") else has_text(
        F.col(column))


def coverage_by_university(records: DataFrame) -> DataFrame:
    """Per university how many records carry each field, and the percentage."""
    aggs = [F.count(F.lit(1)).alias("total")]
    names = {"position": "academic_position", "interests": "research_interests", "expertise": "areas_of_expertise",
             "orcid": "orcid_url"}
    aggs += [F.count_if(_filled(c)).alias(n) for n, c in names.items()]
    university = F.col("university_name") if "university_name" in records.columns else F.lit("Unknown")
    out = records.groupBy(university.alias("university_name")).agg(*aggs)
    return out.withColumns({f"{n}_pct": F.round(F.col(n) / F.col("total") * 100, 1) for n in names})


def missing_fields(records: DataFrame) -> DataFrame:
    return records.select(
        "*", F.explode(F.array_compact(F.array(
            F.when(~has_text(F.col("name")), F.lit("name")), F.when(~has_text(F.col("profile_url")), F.lit("profile_url"))))
        ).alias("missing"))


def suspicious_positions(records: DataFrame) -> DataFrame:
    hit = F.lower("academic_position").rlike("|".join(SUSPICIOUS_TERMS))
    return records.where(hit).select("name", "university_name", "academic_position", "profile_url")


def long_interests(records: DataFrame) -> DataFrame:
    rows = records.select("name", "university_name", F.explode("research_interests").alias("interest"))
    return rows.where(F.length("interest") > LONG_INTEREST).withColumn(
        "interest", F.concat(F.substring("interest", 1, SHOWN_INTEREST), F.lit("...")))


def duplicates_on(records: DataFrame, column: str) -> DataFrame:
    """Non-empty values shared by more than one record, with their number."""
    return records.where(has_text(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_profiles(records: DataFrame) -> DataFrame:
    return duplicates_on(records, "profile_url")


def duplicate_orcids(records: DataFrame) -> DataFrame:
    return duplicates_on(records, "orcid_url")


def cross_university_names(records: DataFrame) -> DataFrame:
    """Names met at more than one university; a missing university counts as one.

    Smallest and largest university differ exactly when there are two, so no
    set of universities is built per name.
    """
    uni = F.struct(F.col("university_name"))
    return (
        records.where(has_text(F.col("name"))).groupBy(strip(F.lower("name")).alias("name_key"))
        .agg(F.min(uni).alias("_lo"), F.max(uni).alias("_hi"), F.count(F.lit(1)).alias("n"))
        .where(~F.col("_lo").eqNullSafe(F.col("_hi"))).select("name_key", "n"))


def dq_summary(records: DataFrame) -> DataFrame:
    """The seven counters in one row."""
    row = records.agg(
        F.count_if(~has_text(F.col("name"))).alias("missing_names"),
        F.count_if(~has_text(F.col("profile_url"))).alias("missing_profiles"),
        F.count_if(F.coalesce(F.lower("academic_position").rlike("|".join(SUSPICIOUS_TERMS)), F.lit(False))).alias(
            "suspicious_positions"),
    )
    for name, df in (
        ("long_interests", long_interests(records)), ("duplicate_profiles", duplicate_profiles(records)),
        ("duplicate_orcids", duplicate_orcids(records)), ("cross_university_names", cross_university_names(records)),
    ):
        row = attach_row(row, df.agg(F.count(F.lit(1)).alias(name)))
    return row
