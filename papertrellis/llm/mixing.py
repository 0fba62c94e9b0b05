"""Mixing sources to target weights by hash thresholds: whole documents are taken once, twice, ... without sorting any.

Every document has a hash. Sums by source and leading hash bits give a histogram; the budget of a copy (at most the source's size)
falls into one bucket, whose documents alone are summed again by the next bits, until the hash is used up. A document is taken once
for each budget whose threshold lies above its hash. The thresholds are nested, so a document taken twice is one taken once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.llm.tables import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that one histogram resolves: 2^16 buckets for each source and budget at most.
BITS = 16
MOST_COPIES = 2
MOST_SOURCES = 1_000_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources in code-point order, null last, have the weights in turn. What a full source can't take goes to the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: most * n for s, n in order}
    rest, out = share * sum(n for _, n in order), {}
    while open_ := [s for s in weight if s not in out]:
        each = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] >= limit[s]]
        if not full:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: float(limit[s]) for s in full}
        rest = max(0.0, rest - sum(limit[s] for s in full))
    return out


def _bucket(level: int) -> Column:
    """Bits of the hash from the top, as a number; the hash is used as an unsigned number."""
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def thresholds(narrow: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, copy, limit): take the documents of ``source`` whose hash, as an unsigned number, is below ``limit``.

    ``narrow`` has source, size, h; ``budgets`` has source, copy, budget (below the source's size). The number of documents is the
    one that brings the sum nearest to the budget (fewer if two are as near).
    """
    state = budgets.select("source", "copy", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    over = Window.partitionBy("source", "copy").orderBy("bucket")
    for level in range(64 // BITS):
        docs = narrow.select(F.col("source").alias("s"), "size", F.shiftrightunsigned("h", 64 - BITS * level).alias("p") if level else F.lit(0).cast("long").alias("p"), _bucket(level).alias("bucket"))
        sums = docs.join(state, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix"))).groupBy("source", "copy", "left", "prefix", "bucket").agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(over)).withColumn("before", F.col("upto") - F.col("n"))
        # the first bucket that reaches what is left; nothing reaches it only at level 0 of a budget of the whole source
        found = run.where("upto >= left and before < left")
        state = written(found.select("source", "copy", (F.col("left") - F.col("before")).alias("left"), "n", F.shiftleft("prefix", BITS).bitwiseOR(F.col("bucket")).alias("prefix")), f"mix-level{level}")
        if level < 64 // BITS - 1:
            state = state.drop("n")
    # the last bucket is one hash value: it is in if that comes nearer
    inside = F.col("n") - F.col("left") < F.col("left")
    return state.select("source", "copy", "prefix", inside.alias("with_it"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        words_in(F.col(text_col).cast("string")).alias("size"), F.xxhash64(id_col, text_col).alias("h"),
    )


def plan(narrow: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, whole, prefix, with_it): one row per source, held on the driver (a million at most, checked).

    Documents of a source are taken ``whole`` times, and once more if their hash is below ``prefix`` (or is it, if ``with_it``).
    """
    spark = narrow.sparkSession
    sizes = [(r["source"], r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()]
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    aim = targets(sizes, weights, share, most)
    # the budgets before a source's partial one are whole, those after it are empty
    budgets = [(s, k, float(aim[s] - k * n)) for s, n in sizes for k in range(most) if 0 < aim[s] - k * n < n]
    whole = {s: sum(1 for k in range(most) if n and aim[s] - k * n >= n) for s, n in sizes}
    cuts = {}
    if budgets:
        found = thresholds(narrow, F.broadcast(spark.createDataFrame(budgets, "source string, copy int, budget double")))
        cuts = {r["source"]: (r["prefix"], r["with_it"]) for r in found.collect()}
    rows = [(s, n, float(aim[s]), whole[s], *cuts.get(s, (None, None))) for s, n in sizes]
    return spark.createDataFrame(rows, "plan_source string, source_size long, target double, whole int, prefix long, with_it boolean")


def _copies(keyed: DataFrame, chosen: DataFrame, source: Column, h: Column) -> DataFrame:
    """``keyed`` with the plan of its source and __copies; only the plan moves."""
    flip = F.lit(-(2**63)).cast("long")  # unsigned order
    below = h.bitwiseXOR(flip) < F.col("prefix").bitwiseXOR(flip)
    partly = F.coalesce(below | ((h == F.col("prefix")) & F.col("with_it")), F.lit(False))
    return keyed.join(F.broadcast(chosen), source.eqNullSafe(F.col("plan_source"))).withColumn("__copies", F.col("whole") + partly.cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, copies), one row per input row.

    size: words of the text (null: 0). Documents without words add nothing, however often they are taken. Rows that are equal in id
    and text share a hash and are taken alike. An empty table gives an empty result.
    """
    narrow = written(_narrow(docs, id_col, text_col, source_col), "mix-sizes")
    out = _copies(narrow, plan(narrow, weights, share, most), F.col("source"), F.col("h"))
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("__copies")).cast("long").alias("taken"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``. Texts do not move."""
    narrow = written(_narrow(docs, id_col, text_col, source_col), "mix-sizes")
    # the plan's names may be those of columns of docs
    chosen = plan(narrow, weights, share, most)
    keyed = docs.select(F.struct("*").alias("__row"), F.col(source_col).cast("string").alias("__source"), F.xxhash64(id_col, text_col).alias("__h"))
    taken = _copies(keyed, chosen, F.col("__source"), F.col("__h")).where("__copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")
