"""Benchmark decontamination: windows of benchmark words, hashed, held by every task and searched in the documents.

A document's words become numbers of the benchmark's vocabulary (0: not in it), whole slices of documents at a time; rolling
hashes of all windows are looked up in the sorted hashes of the benchmark, and what they find is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from papertrellis.llm.tables import raw, slices

WINDOW = 10
#: Characters that separate words: ASCII but letters and digits; other letters are lower-cased by bytes.lower().
_GAPS = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The benchmark is a table of tests that every task holds; beyond this many bytes of its text the search is refused.
MOST_BYTES = 256 << 20


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_GAPS).split() if text else []


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every window of ``width`` numbers."""
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(ids) - width + 1), np.uint64)
        for k in range(width):
            h = h * _BASE + ids[k:k + len(h)]
        h = h ^ (h >> np.uint64(31))
        return h * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Windows:
    """The benchmark's windows: vocabulary, and per width the sorted hashes with the windows and items behind them."""

    vocabulary: dict[bytes, int]
    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width: hashes, windows (rows of word numbers), item numbers
    items: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Windows:
        vocabulary: dict[bytes, int] = {}
        per: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, (_, text) in enumerate(items):
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.uint64)
            if len(ids):
                width = min(window, len(ids))
                per.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(ids, width), number))
        table = {}
        for width, found in per.items():
            rows = np.concatenate([r for r, _ in found])
            item = np.repeat([n for _, n in found], [len(r) for r, _ in found])
            rows, item = (lambda both: (both[:, :width], both[:, width].astype(np.int64)))(np.unique(np.column_stack([rows, item.astype(np.uint64)]), axis=0))
            h = _hashes(rows.ravel(), width)[::width]
            order = np.argsort(h, kind="stable")
            table[width] = (h[order], np.ascontiguousarray(rows[order]), item[order])
        return cls(vocabulary, table, [i for i, _ in items])

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, width, item) of every verified occurrence in a run of word numbers; number 0 is in no window."""
        starts, widths, items = [], [], []
        for width, (keys, rows, item) in self.table.items():
            if len(ids) < width:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(known[width:] - known[:-width] == width)
            h = _hashes(ids, width)[at]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = np.flatnonzero(hi > lo)
            at, lo, many = at[some], lo[some], (hi - lo)[some]
            row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            same = np.ones(len(at), bool)
            for k in range(width):
                same &= ids[at + k] == rows[row, k]
            starts.append(at[same])
            widths.append(np.full(same.sum(), width))
            items.append(item[row[same]])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(widths), np.concatenate(items)


def load(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Windows:
    """The windows of a benchmark table, gathered on the driver after its bytes were summed. Null and wordless texts have none.

    Items without an id have windows too; which search counts them is said there.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {MOST_BYTES} go to every task: search it in parts")
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).collect()
    return Windows.of([(r[0], r[1].encode() if r[1] is not None else None) for r in rows], window)


def scan(docs: DataFrame, windows: Windows, text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, n_items, items_sha256, contaminated, hits (word ranges, merged, of array<int> pairs).

    Columns of these names are replaced. A null or wordless text has no words and no hits. Every row stays, repeats too. Items without
    an id count only where ``unnamed`` is set, and then for n_hit, contaminated and hits, not for n_items and items_sha256.
    """
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    others = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).cast("string").alias("__text"))
    schema = docs.drop("__text").schema
    for name, kind in zip(added, ("long", "long", "long", "string", "boolean", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        get = bench.vocabulary.get
        named = np.array([i is not None for i in bench.items], bool)
        for batch in slices(batches, "__text"):
            ids, size = [], []
            for text in raw(batch.column("__text")):
                found = words(text)
                size.append(len(found))
                ids += [get(w, 0) for w in found]
                ids.append(0)  # no window crosses documents
            ids, size = np.array(ids, np.uint64), np.array(size, np.int64)
            first = np.cumsum(size + 1) - size - 1
            start, width, item = bench.search(ids)
            if not unnamed:
                some = named[item]
                start, width, item = start[some], width[some], item[some]
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + width, -1)
            hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
            total = np.concatenate([[0], np.cumsum(hit[1:-1])])
            n_hit = total[first + size] - total[first]
            turn = np.flatnonzero(np.diff(hit))
            doc_of = np.searchsorted(first, start, "right") - 1
            of = {}
            for d, i in zip(doc_of.tolist(), item.tolist()):
                if named[i]:
                    of.setdefault(d, set()).add(bench.items[i])
            names = [sorted(of.get(d, ())) for d in range(len(size))]
            lo, hi = np.searchsorted(turn, first, "left"), np.searchsorted(turn, first + size, "right")
            hits = [(turn[a:b] - f).tolist() if n else [] for a, b, f, n in zip(lo, hi, first, n_hit)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(k) for k in range(len(others))], pa.array(size), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0), pa.array(hits, pa.list_(pa.int64())),
            ], names=[*others, *added])

    return docs.mapInArrow(run, schema)


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """Whole rows kept apart from the text, so that no column of theirs meets one of ours."""
    return docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def without_spans(docs: DataFrame, windows: Windows, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words cut from the texts: each range of hit words goes from its first to its last letter, other bytes stay.

    Null and empty texts stay as they are; every row stays, with all its other columns.
    """
    marked = scan(_rows(docs, text_col), windows).select("row", "text", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, hits in zip(raw(batch.column("text")), batch.column("hits").to_pylist()):
                if hits:
                    flat = text.lower().translate(_GAPS)
                    letter = np.frombuffer(flat, np.uint8) != 0x20
                    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    keep, last = [], 0
                    for a, b in zip(hits[::2], hits[1::2]):
                        keep.append(text[last:begin[a]])
                        last = end[b - 1]
                    text = b"".join([*keep, text[last:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "text"])

    done = marked.mapInArrow(cut, marked.drop("hits").schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def clean_documents(docs: DataFrame, windows: Windows, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, of items without an id neither, with their own columns and values.

    Null, empty and wordless texts have no hit and stay, as do repeated rows; without a benchmark all rows stay.
    """
    return scan(_rows(docs, text_col), windows, unnamed=True).where("not contaminated").select("row.*")
