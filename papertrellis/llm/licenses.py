"""License scans by diagonal voting, with DataFrame functions alone.

Every run of three words of every text meets the runs of the templates in a join by hash, verified on the words. A hit of text
position i on template position j votes for the diagonal i - j. A diagonal that has all runs of a template is the template itself,
word for word; neighbouring diagonals are merged, so that a text with words put in or left out still gathers its votes, and what was
merged is verified by the share of the template's words that it holds and by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Words of a run.
RUN = 3
#: Diagonals that lie as near as this are merged.
BAND = 4
#: Least share of a template's words that a merged span holds, and the most words it may take, in lengths of the template.
LEAST_SHARE = 0.8
MOST_LENGTHS = 2

# Phrases that are looked for word for word, and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening words of public license texts and of the notices that name them, with the labels they give.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc0", "creative commons zero v1 0 universal"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of ASCII letters, digits and all characters beyond ASCII. Null has none.

    Other letters lower-case too, which no template can tell, as none has any; the Kelvin sign, which would become a k, is kept apart.
    """
    lowered = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ķ")))
    return F.array_remove(F.split(lowered, _GAPS), "")


def _runs(found: Column) -> Column:
    """Runs of RUN words as structs, one for each word; the last ones are short of words."""
    return F.arrays_zip(*[F.slice(found, k + 1, F.greatest(F.size(found), F.lit(1))).alias(f"w{k}") for k in range(RUN)])


def templates(spark: SparkSession, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(template, label, base, size, at, run hash, words): a row for each run of each template. A template has RUN words at least."""
    every = [(label, text, True) for label, text in base] + [(label, text, False) for label, text in notices]
    if any(len(text.split()) < RUN for _, text, _ in every):
        raise ValueError(f"a template has {RUN} words at least")
    table = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(own).alias("base"), F.lit(text).alias("said"))
                      for k, (label, text, own) in enumerate(every)])
    split = spark.range(1).select(F.inline(table)).withColumn("said", words(F.col("said"))).withColumn("size", F.size("said"))
    runs = split.select("template", "label", "base", "size", F.posexplode(_runs(F.col("said"))).alias("at", "run")).where(f"at <= size - {RUN}")
    return runs.select("template", "label", "base", "size", "at", *[F.col(f"run.w{k}").alias(f"t{k}") for k in range(RUN)]).withColumn(
        "key", F.xxhash64(*[f"t{k}" for k in range(RUN)]))


def votes(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``, template and diagonal with a vote, with the template positions that voted; a row without any stays once.

    Only ids and hits are shuffled, once, by row; all later steps are local to it.
    """
    marked = docs.select(
        F.col(f"`{id_col}`").alias("id"), words(F.col(f"`{text_col}`")).alias("said"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"),
    )
    each = marked.select("id", "row", "mark", F.size("said").cast("long").alias("n_words"), F.posexplode_outer(_runs(F.col("said"))).alias("i", "run"))
    each = each.select("id", "row", "mark", "n_words", "i", *[F.col(f"run.w{k}").alias(f"w{k}") for k in range(RUN)]).withColumn(
        "hash", F.xxhash64(*[f"w{k}" for k in range(RUN)]))
    same = F.col("hash") == F.col("key")
    for k in range(RUN):
        same = same & (F.col(f"w{k}") == F.col(f"t{k}"))
    met = each.join(runs, same, "left").where("template is not null or i is null or i = 0")
    dealt = met.select("id", "row", "mark", "n_words", "template", "label", "base", "size", (F.col("i") - F.col("at")).cast("long").alias("diagonal"), "at")
    return dealt.repartition("row", "mark").groupBy("id", "row", "mark", "n_words", "template", "label", "base", "size", "diagonal").agg(
        F.sort_array(F.collect_set("at")).alias("ats"))


def _share(ats: Column, size: Column) -> Column:
    """Share of a template's words that lie in its voted runs."""
    held = F.array_distinct(F.flatten(F.transform(ats, lambda at: F.sequence(at, at + F.lit(RUN - 1)))))
    return F.size(held) / size


def spans(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, mark, n_words, template, label, base, size, first, last, exact, first_exact, last_exact, share, verified): merged diagonals by row and template.

    first and last are the span's words, from 0; exact counts the diagonals that have the whole template, first_exact and last_exact are
    where they begin. Rows of ``docs`` without a vote have one row with nulls.
    """
    by = Window.partitionBy("row", "mark", "id", "template").orderBy("diagonal")
    lined = votes(docs, runs, id_col, text_col).withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(by))
    lined = lined.withColumn("cluster", F.sum(F.when(F.col("gap") > BAND, 1).otherwise(0)).over(by))
    whole = F.size("ats") == F.col("size") - (RUN - 1)
    merged = lined.groupBy("id", "row", "mark", "n_words", "template", "label", "base", "size", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats") + (RUN - 1)).alias("last"),
        F.count_if(whole).alias("exact"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_exact"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_exact"),
    )
    share = merged.withColumn("share", F.when(F.col("template").isNotNull(), _share(F.col("ats"), F.col("size"))))
    fits = (F.col("share") >= LEAST_SHARE) & (F.col("last") - F.col("first") + 1 <= F.col("size") * MOST_LENGTHS)
    return share.withColumn("verified", F.coalesce(fits | (F.col("exact") > 0), F.lit(False))).drop("ats", "cluster")


def scan(docs: DataFrame, runs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found): one row per row of ``docs``, repeats and null ids too.

    n_base counts all places of base phrases; first_word and last_word are the smallest and largest place (null without one). labels
    has the base labels and those of all verified spans; found has the verified spans as (label, template, first, last, share). score is
    the largest share of a template's words in a span, 1 where a template stands word for word, 0 without a vote. A null, empty or
    wordless text has no words, no labels and score 0. Other columns of ``docs`` are not read.
    """
    runs = templates(docs.sparkSession) if runs is None else runs
    base = F.col("base") & (F.col("exact") > 0)
    one = F.struct("label", "template", F.col("first"), F.col("last"), "share")
    found = spans(docs, runs, id_col, text_col).groupBy("row", "mark", "id", "n_words").agg(
        F.coalesce(F.sum(F.when(F.col("base"), F.col("exact"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_exact"))).alias("first_word"),
        F.max(F.when(base, F.col("last_exact"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("verified"), one))).alias("found"),
    )
    listed = lambda c: F.array_join(F.array_sort(F.col(c)), ",").alias(c)
    return found.select("id", "n_words", "n_base", "first_word", "last_word", listed("base_labels"), listed("labels"), "score", "found")
