"""Near-duplicates by SimHash: 64-bit fingerprints compared exactly in tiles.

Equal fingerprints are one class, so copies never meet each other. The distinct fingerprints are laid in tiles by the
population counts of their segments (four words of 16 bits, or eight of 8). A bit that differs moves one of these counts by one,
so two tiles whose counts differ by more than the radius in sum hold no linked pair and are skipped; all other tile pairs are
compared in full with exclusive-or and bit counts. Every tile pair yields a spanning forest of its links, which has the same
components as all its links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.llm.components import smallest_reachable
from papertrellis.llm.tables import raw, slices, written

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a tile; a tile pair needs the square of it in bytes, eight times over.
TILE = 1024
#: Number of distinct fingerprints from which tiles use eight segments instead of four (same links, other tile sizes).
FINE_FROM = 1 << 24
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for a text without words.

    Letters A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words is one shingle.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(parts) - words + 1)
    last = end[min(words, len(parts)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):  # a very long text needs no list of all its hashes
        s, e = start[a:min(a + _STEP, n)].tolist(), last[a:min(a + _STEP, n)].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(s, e)], np.uint64).view(np.uint8).reshape(-1, 8)
        seen = np.bincount((h + (np.arange(8) << 8)).ravel(), minlength=2048).reshape(8, 256)
        ones += (seen @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long. A null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in raw(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _signature(fp: Column, segments: int) -> Column:
    """Population counts of the segments, one byte-wide digit each, in one long."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1)
    out = F.lit(0).cast("long")
    for i in range(segments):
        ones = F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(mask)).cast("long")
        out = out + ones * F.lit(32**i)
    return out


def _offsets(segments: int, radius: int) -> list[int]:
    """Signature differences with at most ``radius`` in sum of absolutes, the upper half and zero.

    A digit below zero borrows and so becomes 31 or 30, which no signature has: it meets nothing.
    """
    out = set()
    for k in range(radius + 1):
        for at in itertools.combinations_with_replacement(range(segments), k):
            for sign in itertools.product((1, -1), repeat=k):
                out.add(sum(s * 32**i for i, s in zip(at, sign)))
    return sorted(x for x in out if x >= 0)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between the fingerprints of two tiles (or within one), without those that close a ring."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found = []
    for lo in range(0, len(a), 256):
        part = a[lo:lo + 256]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ b[None, :]) <= radius)
        for x, y in zip(part[i].tolist(), b[j].tolist()):
            if (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                found.append((x, y))
    return found


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect every component; a <> b.

    ``distinct`` has the column fp, each value once. Exact: no link between tiles is missed, whatever the tile sizes.
    """
    signed = distinct.select("fp", _signature(F.col("fp"), segments).alias("sig"))
    parts = signed.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    tiles = (
        signed.join(parts, "sig")
        .groupBy("sig", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    left = tiles.select(F.col("sig").alias("at"), F.col("part").alias("part_a"), F.col("fps").alias("a"))
    right = tiles.select(
        F.explode(F.array(*[F.lit(x).cast("long") for x in _offsets(segments, radius)])).alias("step"),
        F.col("sig"), F.col("part").alias("part_b"), F.col("fps").alias("b"),
    ).select((F.col("sig") + F.col("step")).alias("at"), "step", "part_b", "b")
    pairs = left.join(right, "at").where((F.col("step") != 0) | (F.col("part_a") <= F.col("part_b"))).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            cols = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1))]
            for k in range(batch.num_rows):
                a, b = (v[o[k]:o[k + 1]].view(np.uint64) for v, o in cols)
                for p, q in forest(a, b, radius):
                    x.append(p)
                    y.append(q)
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (x, y)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS,
                    segments: int | None = None) -> DataFrame:
    """(id, fp, component_id): every input row with its fingerprint and the smallest id it can reach over links.

    Null texts and texts without words have fingerprint 0 and link like any other. Rows of one id each keep their own row; a null
    id is reachable but never names a component (a component of null ids alone has a null component_id). An empty table gives none.
    """
    marks = written(fingerprints(docs, id_col, text_col, words), "simhash-marks")
    classes = written(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    if segments is None:
        segments = 4 if classes.count() < FINE_FROM else 8
    edges = written(links(classes, radius, segments), "simhash-links")
    reached = smallest_reachable(edges)
    # a component's smallest id over its classes; classes without links are their own
    named = classes.join(reached, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return marks.join(members, "fp").select("id", "fp", "component_id")
