"""Collected academic profiles: one record shape, duplicates merged, matched into the base academics."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from papertrellis.functions.relations import distinct_ci
from papertrellis.functions.text import blank_to_null, has_text, name_key, strip
from papertrellis.schemas import with_optional

RECORD = (
    "name", "gender", "academic_position", "research_interests", "areas_of_expertise", "profile_url", "orcid_url",
    "university_name",
)
LISTS = ("research_interests", "areas_of_expertise")


def normalise_academic(df: DataFrame) -> DataFrame:
    """The eight-column record (``seq`` is carried along); null lists become empty."""
    df = with_optional(df, **{c: "array<string>" if c in LISTS else "string" for c in RECORD})
    extra = ["seq"] if "seq" in df.columns else []
    cols = [F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in LISTS else F.col(c) for c in RECORD]
    return df.select(*extra, *cols)


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """All sources one below the other with their ``source``; a failed source (None) adds nothing."""
    parts = [normalise_academic(df).withColumn("source", F.lit(name)) for name, df in sources.items() if df is not None]
    return reduce(DataFrame.unionByName, parts)


def source_counts(records: DataFrame, column: str = "source") -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merge_lists(first: Column, second: Column) -> Column:
    """Concatenation, stripped, without empties or repeats in another case; first spelling stays."""
    return distinct_ci(F.concat(first, second))


def profile_key(df: DataFrame) -> Column:
    """Profile url, else name and university; null where neither identifies the person."""
    low = lambda c: strip(F.lower(c))
    return F.when(has_text(F.col("profile_url")), F.to_json(F.array(F.lit("p"), low("profile_url")))).when(
        has_text(F.col("name")) & has_text(F.col("university_name")),
        F.to_json(F.array(F.lit("n"), low("name"), low("university_name"))),
    )


def dedupe_academics(records: DataFrame, seq: str = "seq") -> DataFrame:
    """One record per key: the first row wins, gaps are filled, lists merged.

    Everything but the final lists is min/min_by, which combines before the
    shuffle; list items are made distinct per key first and only then collected.
    """
    rows = records.withColumn("_key", profile_key(records)).where(F.col("_key").isNotNull())
    filled = lambda c: F.min_by(c, F.when(has_text(F.col(c)), F.col(seq)))
    plain = ("name", "gender", "profile_url", "university_name")
    merged = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(seq).alias(seq),
        F.min_by(F.struct(*plain, "academic_position", "orcid_url", *LISTS), seq).alias("_f"),
        filled("academic_position").alias("_position"), filled("orcid_url").alias("_orcid"),
    )
    for column in LISTS:
        items = rows.select("_key", seq, F.posexplode(column).alias("_pos", "_raw")).select(
            "_key", F.struct(seq, "_pos").alias("_at"), strip(F.col("_raw")).alias("_item")).where(has_text(F.col("_item")))
        first = items.groupBy("_key", F.lower("_item").alias("_l")).agg(F.min(F.struct("_at", "_item")).alias("_s"))
        lists = first.groupBy("_key").agg(
            F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_item"]).alias(f"_m_{column}"))
        merged = merged.join(lists, "_key", "left")

    def final(column: str) -> Column:
        # a record that was never a duplicate keeps its list as it came
        return F.when(F.col("n_rows") == 1, F.col(f"_f.{column}")).otherwise(
            F.coalesce(f"_m_{column}", F.array().cast("array<string>"))).alias(column)

    return merged.select(
        seq, "_f.name", "_f.gender", F.coalesce("_position", "_f.academic_position").alias("academic_position"),
        *[final(c) for c in LISTS], "_f.profile_url", F.coalesce("_orcid", "_f.orcid_url").alias("orcid_url"),
        "_f.university_name", "n_rows")


@F.pandas_udf(T.StringType())
def _unaccent(names: pd.Series) -> pd.Series:
    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return names.map(plain, na_action="ignore")


def normalise_name(c: Column) -> Column:
    """Lower-case ASCII words of a name, accents removed.

    Only names with a character beyond ASCII are handed to Python.
    """
    beyond = c.rlike(r"[^\x00-\x7F]")
    plain = F.coalesce(_unaccent(F.when(beyond, c)), c)
    return name_key(F.coalesce(plain, F.lit("")))


def merge_profiles(academics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on the normalised name, only where exactly one profile has it.

    Its non-empty position and urls override; the summary is its interests in
    one text. ``matched`` tells which rows found their profile.
    """
    keyed = profiles.withColumn("_key", normalise_name(F.col("name"))).where(F.col("_key") != "")
    content = F.struct("academic_position", "profile_url", "orcid_url", "research_interests")
    single = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(content).alias("_p")).where("_n = 1")
    base = academics.withColumn("_key", normalise_name(F.col("name")))
    joined = base.join(single, "_key", "left")
    for column in ("academic_position", "profile_url", "orcid_url"):
        joined = joined.withColumn(column, F.coalesce(blank_to_null(F.col(f"_p.{column}")), F.col(column)))
    interests = F.col("_p.research_interests")
    return joined.withColumn(
        "academic_summary", F.when(F.size(F.coalesce(interests, F.array().cast("array<string>"))) > 0, F.array_join(interests, " "))
    ).withColumn("matched", F.col("_n").isNotNull()).drop("_key", "_n", "_p")


def merge_report(merged: DataFrame, profiles: DataFrame) -> DataFrame:
    from papertrellis.functions.relations import attach_row

    row = merged.agg(
        F.count(F.lit(1)).alias("base"), F.count_if("matched").alias("matched"),
        F.count_if(has_text(F.col("academic_summary"))).alias("with_summary"))
    return attach_row(row, profiles.agg(F.count(F.lit(1)).alias("profiles")))
