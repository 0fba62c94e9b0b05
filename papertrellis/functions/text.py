"""Text, number and date rules used by every operator.

All functions take and return Columns, so they join the surrounding
whole-stage-codegen span instead of leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Characters whose full case folding differs from lower casing.
CASE_FOLDS = (
    ("ß", "ss"),
    ("ς", "σ"),
    ("ſ", "s"),
    ("ﬀ", "ff"),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    ("ﬅ", "st"),
    ("ﬆ", "st"),
)

_NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def strip(c: Column) -> Column:
    """Cut white space of every kind (tab, newline, no-break space) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def identifier(c: Column) -> Column:
    """Stripped text form of an id; blank becomes null."""
    return blank_to_null(strip(c.cast("string")))


def has_text(c: Column) -> Column:
    """True for a value that is neither null nor the empty string."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def fold(c: Column) -> Column:
    out = F.lower(c)
    for source, target in CASE_FOLDS:
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends are cut."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """ASCII alphanumeric runs of the folded text; null text has no tokens."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def term_counts(toks: Column) -> Column:
    """array<struct<term,tf>> of one token array.

    Sorting puts equal terms side by side; the run starts then give the
    counts. It all happens inside the row, so building postings needs no
    shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda start, i: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(at, i + 1), F.size(ordered)) - start).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(toks), runs)


def id_array(c: Column) -> Column:
    """Null array becomes empty, null members go away."""
    return F.array_compact(F.coalesce(c, F.array().cast("array<string>")))


def number(c: Column) -> Column:
    """Text to double; null when the text is not a number (NaN and infinities pass)."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(_NUMBER) | s.rlike(_SPECIAL), s.try_cast("double"))


def clamp_score(c: Column) -> Column:
    """Stored score to [0, 1]; NaN counts as above the range, as greatest/least order it.

    greatest and least skip nulls, so a missing score is kept out of them.
    """
    return let(number(c), lambda n: F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))))


def parse_count(c: Column) -> Column:
    """Citation count: not finite or not numeric is null, negatives are zero."""
    n = number(c)
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.greatest(F.lit(0.0), n))


def parse_date(c: Column) -> Column:
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def parse_year(c: Column, dtype: T.DataType) -> Column:
    """Year of a date, an integer year, or a text that starts with four digits."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(c)
    if isinstance(dtype, T.IntegralType):
        return F.when(c.between(1, 9999), c.cast("int"))
    head = F.substring(c.cast("string"), 1, 4)
    year = F.when(head.rlike("^[0-9]{4}$"), head.try_cast("int"))
    return F.when(year >= 1, year)


def name_key(c: Column) -> Column:
    """Comparison key of a person name once combining marks are gone."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", " ")
    return collapse(kept)
