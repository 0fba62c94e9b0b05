"""Merkle manifest of a dataset, and proofs of all its rows by octopus multiproofs.

Leaves are ordered by source and id and dealt in ranges. Nodes of 16 children are built level by level, a tree for each source and one
over the sources' roots. To prove all leaves of a range, the range works out which nodes it can't derive from its own leaves (the
least union of missing coordinates), fetches these once, derives the interior nodes that its leaves share, and expands each proof itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrellis.llm import numbering
from papertrellis.llm.tables import written

ARITY = 16
#: Leaves of a range.
LEAVES = 1 << 15
#: The number of the tree over the sources.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """SHA-256 of the values in turn: ``-`` for null, else UTF-8 byte count, colon, value."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def missing(known: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, places): the nodes of a tree of ``n`` leaves that can't be derived from the ``known`` leaves but are needed to prove them."""
    out = []
    for level in range(height(n)):
        parents = np.unique(known // ARITY)
        family = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(family[family < n], known, assume_unique=True)))
        known, n = parents, -(-n // ARITY)
    return out


@dataclass
class Manifest:
    """leaves: part, doc_id, leaf, changed, tree, place, total (written); runs: the ranges' share of each tree; nodes: level, tree, place, digest."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame  # key ('n' for a null source, else 's' and the source), tree, digest
    root: str | None
    sources: int


def _climb(level: DataFrame, most: int, name: str) -> list[DataFrame]:
    """All levels (tree, place, digest, n: nodes of the tree on the level) from the given one up; each is written."""
    out = [level]
    while most > 1:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "")
        up = out[-1].where("n > 1").groupBy("tree", F.expr(f"place div {ARITY}").alias("place")).agg(
            F.sha2(joined, 256).alias("digest"), F.ceil(F.max("n") / F.lit(ARITY)).cast("long").alias("n"))
        out.append(written(up, name))
        most = math.ceil(most / ARITY)
    return out


def build(docs: DataFrame, changed: Column | None = None, rows: int = LEAVES) -> Manifest:
    """The manifest of all rows of ``docs``, which has FIELDS. ``changed`` is a text that takes the place of ``text`` in ``changed`` leaves.

    Rows are ordered by doc_id, null first, then by leaf; repeated rows are leaves of their own. Null, empty and very long texts are
    hashed like any other; further columns are not read. A table without rows has no root and no proofs.
    """
    col = lambda c: F.col(f"`{c}`")
    told = docs.select(
        F.coalesce(F.concat(F.lit("s"), col("source").cast("string")), F.lit("n")).alias("key"), col("doc_id").alias("doc_id"),
        leaf([col(c) for c in FIELDS]).alias("leaf"),
        (F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf([*[col(c) for c in FIELDS[:-1]], changed]))).alias("changed"),
    )
    laid = numbering.dealt(written(told, "leaves"), "key", [F.col("doc_id"), F.col("leaf")], rows)
    runs = numbering.runs(laid, "key")
    # ranges follow the keys' order, so a source's number is that of the sources begun in earlier ranges, and its place among those of its own
    begun = runs.groupBy("key").agg(F.min("part").alias("part"))
    starts = begun.groupBy("part").agg(F.count("*").alias("many"))
    starts = starts.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("earlier"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    trees = begun.withColumn("inside", inside).join(starts, "part").select("key", (F.col("earlier") + F.col("inside") - 1).cast("long").alias("tree"))
    runs = written(runs.join(trees, "key"), "runs")
    leaves = written(numbering.placed(laid, runs, "key").select("part", "doc_id", "leaf", "changed", "tree", "place", "total"), "placed")
    sources, most = runs.agg(F.countDistinct("tree"), F.coalesce(F.max("total"), F.lit(0))).first()
    levels = _climb(leaves.select("tree", "place", F.col("leaf").alias("digest"), F.col("total").alias("n")), most, "level")
    subroots = levels[0].where("n = 1")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1"))
    named = runs.select("key", "tree").distinct()
    subroots = written(subroots.select("tree", "digest").join(named, "tree"), "subroots")
    tops = _climb(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", F.lit(sources).cast("long").alias("n")), sources, "top")
    root = tops[-1].first()
    parts = [level.select(F.lit(k).alias("level"), "tree", "place", "digest") for some in (levels, tops) for k, level in enumerate(some)]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return Manifest(leaves, runs, nodes, subroots, root["digest"] if root else None, sources)


def needed(manifest: Manifest) -> DataFrame:
    """(part, level, tree, place): for each range of leaves the least union of nodes that it has to fetch to prove its leaves."""
    sources = manifest.sources

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found = []
        for tree, before, many, total in zip(*[table.column(c).to_pylist() for c in ("tree", "before", "run", "total")]):
            found += [(level, tree, places) for level, places in missing(np.arange(before, before + many), total)]
        found += [(level, TOP, places) for level, places in missing(np.unique(table.column("tree").to_numpy()), sources)]
        size = [len(x) for _, _, x in found]
        return pa.table({
            "part": pa.array(np.full(sum(size), part, np.int32)), "level": pa.array(np.repeat([x for x, _, _ in found], size).astype(np.int32)),
            "tree": pa.array(np.repeat([x for _, x, _ in found], size).astype(np.int64)),
            "place": pa.array(np.concatenate([x for _, _, x in found]).astype(np.int64) if found else np.zeros(0, np.int64)),
        })

    return manifest.runs.select("part", "tree", "before", "run", "total").groupBy("part").applyInArrow(run, "part int, level int, tree long, place long")


class _Range:
    """What a range knows of the trees: fetched nodes, its leaves, and what follows from them."""

    def __init__(self, nodes: dict[tuple[int, int, int], str], sizes: dict[int, int]):
        self.nodes, self.sizes, self._above, self._folds = nodes, sizes, {}, {}

    def derive(self, tree: int, places: list[int]) -> str:
        """The tree's root, from the leaves at ``places`` and what was fetched; interior nodes are kept."""
        n, level = self.sizes[tree], 0
        while n > 1:
            places = sorted({p // ARITY for p in places})
            for p in places:
                self.nodes[tree, level + 1, p] = digest("".join(self.family(tree, level, p, n)))
            n, level = -(-n // ARITY), level + 1
        return self.nodes[tree, level, 0]

    def family(self, tree: int, level: int, parent: int, n: int) -> list[str]:
        return [self.nodes[tree, level, p] for p in range(parent * ARITY, min(n, (parent + 1) * ARITY))]

    def step(self, tree: int, level: int, place: int) -> tuple[list[str], int] | None:
        """The node's run and its place in it, or None for a root."""
        n = self.sizes[tree]
        for _ in range(level):
            n = -(-n // ARITY)
        return (self.family(tree, level, place // ARITY, n), place % ARITY) if n > 1 else None

    def above(self, tree: int, level: int, place: int) -> tuple[tuple[list[str], int], ...]:
        """Runs from a node to the root over all sources."""
        at = tree, level, place
        if at not in self._above:
            step = self.step(*at)
            if step:
                self._above[at] = (step, *self.above(tree, level + 1, place // ARITY))
            else:
                self._above[at] = () if tree == TOP else self.above(TOP, 0, tree)
        return self._above[at]

    def fold(self, node: str, tree: int, level: int, place: int) -> str:
        """The root that follows if the node at this place were ``node``."""
        at = tree, level, place, node
        if at not in self._folds:
            step = self.step(tree, level, place)
            if step:
                run, k = step
                up = self.fold(digest("".join([*run[:k], node, *run[k + 1:]])), tree, level + 1, place // ARITY)
            else:
                up = node if tree == TOP else self.fold(node, TOP, 0, tree)
            if not level:
                return up  # a leaf is folded once
            self._folds[at] = up
        return self._folds[at]


def proofs(manifest: Manifest, paths: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each leaf; with ``paths`` also path.

    proof_sha256 hashes the siblings level by level up to the root; folded_root follows from the changed leaf where there is one, else
    from the leaf, and the original siblings; verified tells if it is the root. path has for each level the siblings and the place
    between them. Ranges are independent of each other, and a lost one is proved anew from stored nodes.
    """
    fetched = needed(manifest).join(manifest.nodes, ["level", "tree", "place"]).select("part", "level", "tree", "place", "digest")
    kind = manifest.leaves.schema["doc_id"].dataType.simpleString()
    sources = manifest.sources
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if paths:
        schema += ", path array<struct<place: int, others: array<string>>>"

    def run(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        tree, place, total, own, changed = (leaves.column(c).to_pylist() for c in ("tree", "place", "total", "leaf", "changed"))
        known = {(t, v, p): d for t, v, p, d in zip(*[nodes.column(c).to_pylist() for c in ("tree", "level", "place", "digest")])}
        known.update(zip(zip(tree, [0] * len(tree), place), own))
        here = _Range(known, {**dict(zip(tree, total)), TOP: sources})
        at: dict[int, list[int]] = {}
        for t, p in zip(tree, place):
            at.setdefault(t, []).append(p)
        subroot = {t: here.derive(t, places) for t, places in at.items()}
        known.update({(TOP, 0, t): d for t, d in subroot.items()})
        root = here.derive(TOP, list(subroot)) if subroot else None
        rest: dict[tuple[int, int], str] = {}
        proof, folded, path = [], [], []
        for t, p, d, c in zip(tree, place, own, changed):
            steps = here.above(t, 0, p)
            if (t, p // ARITY) not in rest:
                rest[t, p // ARITY] = "".join("".join(run[:k] + run[k + 1:]) for run, k in steps[1 if here.sizes[t] > 1 else 0:])
            run_, k = here.step(t, 0, p) or ([], 0)
            proof.append(digest("".join(run_[:k] + run_[k + 1:]) + rest[t, p // ARITY]))
            folded.append(here.fold(c or d, t, 0, p))
            if paths:
                path.append([{"place": k, "others": run[:k] + run[k + 1:]} for run, k in steps])
        columns = {
            "doc_id": leaves.column("doc_id"), "leaf": leaves.column("leaf"), "subroot": pa.array([subroot[t] for t in tree], pa.string()),
            "root": pa.array([root] * len(tree), pa.string()), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_()),
        }
        if paths:
            columns["path"] = pa.array(path, pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])))
        return pa.table(columns)

    return manifest.leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
