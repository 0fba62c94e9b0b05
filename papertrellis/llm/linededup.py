"""Reversible line dedup: exact reference tables of repeated lines behind sharded cuckoo filters.

A line's key is the line stripped and lower-cased. The store holds one reference per key and document; a key that enough documents
hold loses its lines everywhere but in the largest document. The keys that reached that number stand in cuckoo filters, one per
shard of the key hashes, so that references of all other keys are left out before anything is shuffled; the exact counts are then
taken over the rest. Documents can be inserted and deleted in any order: filters follow when a key crosses the number, and deleting
what was inserted gives the store from before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.llm.tables import raw, slices, written

BLANKS = b" \t\n\r\x0b\x0c"
LEAST_POINTS = 40
LEAST_DOCS = 5
#: Keys that a shard's filter is laid out for, at half of its slots.
SHARD_KEYS = 1 << 15
SLOTS = 4
#: Filters, and lists of lines to drop, up to so many bytes go to every task. Larger filters meet the references of their shard, one
#: shard after the other in a task; longer lists are joined.
SENT_BYTES = 64 << 20
#: References of one shard that go through one copy of its filter; larger shards are split.
PART_REFS = 1 << 22
MOST_SHARDS = 1 << 16


def key_of(line: bytes, least: int = LEAST_POINTS) -> bytes | None:
    """16 hash bytes of a line's key; None for a key of fewer code points than ``least``."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode(errors="replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """A cuckoo filter over 16-byte hashes: two buckets of four 16-bit marks for each key, insertions and deletions.

    A filter that has no room left turns ``full`` and from then on answers "maybe" to every key.
    """

    def __init__(self, buckets: int = SHARD_KEYS // 2, table: np.ndarray | None = None, full: bool = False):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask, self.full = len(self.table) - 1, full

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = keys.view("<u8").reshape(-1, 2)
        mark = (halves[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark = np.where(mark == 0, 1, mark).astype(np.uint16)
        one = (halves[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._turn(mark)

    def _turn(self, mark):
        return (np.asarray(mark).astype(np.int64) * 0x5BD1E995) & self.mask

    def insert(self, keys: np.ndarray) -> None:
        """Add each of different keys (rows of 16 bytes)."""
        if self.full or not len(keys):
            return
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for step in range(500):
                at = next((b for b in (one, two) if not self.table[b].all()), None)
                if at is not None:
                    self.table[at, int(np.flatnonzero(self.table[at] == 0)[0])] = mark
                    break
                at, slot = (one, two)[step & 1], step % SLOTS
                mark, self.table[at, slot] = int(self.table[at, slot]), mark
                one, two = at, int(at ^ self._turn(mark))
            else:
                self.full = True
                return

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        if self.full or not len(keys):
            return
        for mark, one, two in zip(*(x.tolist() for x in self._places(keys))):
            for b in (one, two):
                slot = np.flatnonzero(self.table[b] == mark)
                if len(slot):
                    self.table[b, int(slot[0])] = 0
                    break

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(keys), bool)
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)

    def to_bytes(self) -> bytes:
        return bytes([self.full]) + self.table.astype("<u2").tobytes()

    @classmethod
    def of(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, "<u2", offset=1).reshape(-1, SLOTS).copy(), full=bool(data[0]))


def _stacked(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)


def _shard(key: Column, shards: int) -> Column:
    """The filter that a key belongs to, by its last two bytes."""
    return F.pmod(F.conv(F.hex(F.substring(key, 15, 2)), 16, 10).cast("int"), F.lit(shards))


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS) -> DataFrame:
    """(key, id): each long line's key once per document; rows without an id have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, many = [], []
            for text in raw(batch.column("text")):
                found = {k for line in (text or b"").split(b"\n") if (k := key_of(line, least))}
                keys += found
                many.append(len(found))
            of = np.repeat(np.arange(batch.num_rows), many)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("id").take(pa.array(of))], names=["key", "id"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return chosen.mapInArrow(run, f"key binary, id {kind}").distinct()


@dataclass(frozen=True)
class LineStore:
    """refs: (key, id), each pair once. filters: (shard, bits), one row per shard. Both written in the shared folder.

    held: keys in the filters. When they outgrow what the shards are laid out for, the filters are built anew from the exact counts.
    """

    refs: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 0
    held: int = 0
    least_docs: int = LEAST_DOCS
    least_points: int = LEAST_POINTS

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The store with these documents too; a document inserted again adds nothing, one with other lines adds them."""
        batch = references(docs, id_col, text_col, self.least_points)
        if self.refs is None:
            refs = written(batch, "line-refs")
            risen = refs.groupBy("key").count().where(F.col("count") >= self.least_docs).select("key")
        else:
            batch = written(batch.join(self.refs, ["key", "id"], "left_anti"), "line-refs")
            refs = self.refs.unionByName(batch)
            more = batch.groupBy("key").agg(F.count("*").alias("more"))
            counts = self.refs.join(more, "key").groupBy("key").agg(F.count("*").alias("n"))
            now = more.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            risen = now.where((F.col("n") < self.least_docs) & (F.col("n") + F.col("more") >= self.least_docs)).select("key")
        return replace(self, refs=refs)._filtered(risen, True)

    def delete(self, ids: DataFrame) -> LineStore:
        """The store without the documents whose ids stand in the only column of ``ids``."""
        if self.refs is None:
            return self
        ids = ids.select(F.col(f"`{ids.columns[0]}`").alias("id")).distinct()
        gone = self.refs.join(ids, "id", "left_semi").groupBy("key").agg(F.count("*").alias("gone"))
        counts = self.refs.join(gone, "key").groupBy("key").agg(F.count("*").alias("n"), F.first("gone").alias("gone"))
        sunk = counts.where((F.col("n") >= self.least_docs) & (F.col("n") - F.col("gone") < self.least_docs)).select("key")
        done = self._filtered(sunk, False)
        return replace(done, refs=written(self.refs.join(ids, "id", "left_anti").select("key", "id"), "line-refs"))

    def _filtered(self, keys: DataFrame, add: bool) -> LineStore:
        """The filters with keys that crossed the number put in or taken out, shard by shard."""
        keys = written(keys, "line-keys")
        shards, old, many = self.shards, self.filters, keys.count()
        held = self.held + many if add else self.held - many
        if old is not None and held > shards * SHARD_KEYS and shards < MOST_SHARDS:
            every = self.refs.groupBy("key").count().where(F.col("count") >= self.least_docs).select("key")
            return replace(self, filters=None, held=0)._filtered(every, True)
        if old is None:
            shards = min(1 << max(0, (int(many * 1.2) // SHARD_KEYS).bit_length()), MOST_SHARDS)
            old = keys.sparkSession.createDataFrame([], "shard int, bits binary")
        split = keys.withColumn("shard", _shard(F.col("key"), shards))

        def change(before: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
            one = Cuckoo.of(before["bits"].iloc[0]) if len(before) else Cuckoo()
            rows = _stacked(list(crossed["key"])) if len(crossed) else np.zeros((0, 16), np.uint8)
            (one.insert if add else one.delete)(rows)
            shard = before["shard"].iloc[0] if len(before) else crossed["shard"].iloc[0]
            return pd.DataFrame({"shard": [shard], "bits": [one.to_bytes()]})

        changed = old.groupBy("shard").cogroup(split.groupBy("shard")).applyInPandas(change, "shard int, bits binary")
        return replace(self, filters=written(changed, "line-filters"), shards=shards, held=held)

    def repeated(self) -> DataFrame:
        """The references whose key may be one to drop: what the filters let through."""
        if self.filters is None:
            raise ValueError("nothing was inserted yet")
        if self.filters.count() * (SHARD_KEYS * SLOTS + 1) > SENT_BYTES:
            return self._shard_by_shard()
        sent = self.refs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in self.filters.collect()})
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: Cuckoo.of(b) for s, b in sent.value.items()}
            for batch in batches:
                keys = _stacked(batch.column("key").to_pylist()) if batch.num_rows else np.zeros((0, 16), np.uint8)
                shard = ((keys[:, 14].astype(int) << 8) | keys[:, 15]) % shards
                keep = np.zeros(len(keys), bool)
                for s, one in held.items():
                    at = np.flatnonzero(shard == s)
                    keep[at] = one.maybe(np.ascontiguousarray(keys[at]))
                yield batch.filter(pa.array(keep))

        return self.refs.mapInArrow(run, self.refs.schema)

    def _shard_by_shard(self) -> DataFrame:
        """repeated() where no task can hold all filters: each shard's references follow its filter, in parts where there are many."""
        refs = self.refs.withColumn("shard", _shard(F.col("key"), self.shards))
        sizes = refs.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / PART_REFS).cast("int").alias("parts"))
        sizes = written(sizes, "line-shards")
        kind = self.refs.schema["id"].dataType
        none = F.lit(None)
        refs = refs.join(F.broadcast(sizes), "shard").select(  # MOST_SHARDS rows of two numbers at most
            "shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "key", "id", none.cast("binary").alias("bits"))
        filters = self.filters.join(sizes, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.cast("binary").alias("key"), none.cast(kind).alias("id"), "bits")
        laid = filters.union(refs).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, held = None, None
            for batch in batches:
                place = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
                leads = batch.column("bits").is_valid().to_numpy(zero_copy_only=False)
                cuts = np.unique([0, *np.flatnonzero(leads), *(np.flatnonzero(np.diff(place)) + 1), len(place)]).tolist()
                for lo, hi in zip(cuts, cuts[1:]):
                    if leads[lo]:
                        of, held = place[lo], Cuckoo.of(batch.column("bits")[lo].as_py())
                        lo += 1
                    if lo < hi and of == place[lo]:  # a shard without a filter holds no key to drop
                        some = batch.slice(lo, hi - lo).select(["key", "id"])
                        yield some.filter(pa.array(held.maybe(_stacked(some.column("key").to_pylist()))))

        return laid.mapInArrow(run, self.refs.schema)

    def drops(self) -> DataFrame:
        """(id, keys): the keys of the lines that each document loses. No document is in it with no key."""
        refs = self.repeated()
        held = refs.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= self.least_docs)
        return refs.join(held.select("key", "keeper"), "key").where("id <> keeper").groupBy("id").agg(F.collect_list("key").alias("keys"))

    def cleaned(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """All columns of ``docs`` with the text that stays, and n_lines (before) and n_dropped; columns of these names are replaced.

        A null or empty text is one empty line and stays as an empty text. Rows of one id all keep or lose the same lines; rows without
        an id lose none. An empty table gives none.
        """
        drops = written(self.drops().select(F.col("id").alias("__id"), F.col("keys").alias("__keys")), "line-drops")
        size = drops.agg(F.coalesce(F.sum(F.size("__keys")), F.lit(0)) * 24 + F.count("*") * 48).first()[0]
        drops = F.broadcast(drops) if size <= SENT_BYTES else drops
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        docs = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(text_col, F.col(text_col).cast("string"))
        schema = docs.schema.add("n_lines", "long").add("n_dropped", "long")
        docs = docs.select(*[F.col(f"`{c}`") for c in columns])
        least, at = self.least_points, columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                texts, before, dropped = [], [], []
                for text, keys in zip(raw(batch.column(text_col)), batch.column("__keys").to_pylist()):
                    text = text or b""
                    lines = n = text.count(b"\n") + 1
                    if keys:
                        gone = set(keys)
                        kept = [line for line in text.split(b"\n") if key_of(line, least) not in gone]
                        n, text = len(kept), b"\n".join(kept)
                    texts.append(text)
                    before.append(lines)
                    dropped.append(lines - n)
                cols = [batch.column(i) for i in range(len(columns))]
                cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

        joined = docs.join(drops, F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")
        return joined.mapInArrow(run, schema)
