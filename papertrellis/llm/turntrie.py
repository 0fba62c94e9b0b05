"""Prefix trie of conversations on vertical bitmaps.

A shard is a run of conversations in the order of their ids. It indexes every (depth, turn) to a bitset of its conversations; going
down from the root, the bitset of a node met with the postings of the next depth yields its children, and bit counts and end lists
yield their figures. Nodes are known over all shards by the hash of the turns that lead to them; what shards found is added up by it.

Counts over subtrees need each node once, though many shards may have it: a node belongs to the first shard that has it, and so every
shard sums over its own part of a subtree what belongs to it. Conversations of more than ``block`` turns are followed block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from papertrellis.llm import numbering
from papertrellis.llm.tables import written

#: Conversations of a shard, and rows of a task's range, about.
SHARD = 2048
RANGE_ROWS = 1 << 15
#: Turns that are followed in one round.
BLOCK = 1 << 16
#: Conversations that share a group's first one, and the most turns that they take from it, less one.
GROUP = 100
BORROWED = 6
_ROOT = hashlib.sha256(b"root").digest()[:16]
_EMPTY = hashlib.sha256(b"").hexdigest()
_LOCAL = ("shard long, at long, size long, key binary, parent binary, depth long, n long, least long, chars long, ends string, again boolean, conv long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, chars): every turn with its place in its conversation, from 0, and a hash of role and text.

    Turns ascend, null first; turns of one number by their hash. Null role or text is empty. Rows without conv_id belong to none and
    are left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("number"),
        F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("turn"),
        F.length(text).cast("long").alias("chars"),
    )
    laid = numbering.dealt(written(said, "turns"), "conv_id", [F.col("number"), F.col("turn")])
    return numbering.placed(laid, numbering.runs(laid, "conv_id"), "conv_id").select("conv_id", "place", "turn", "chars", "total")


def borrowed(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % BORROWED).cast("long")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, depth from 1, turn, chars), and the conversations (conv, total: rebuilt turns).

    The first h turns of conversation c - c % GROUP come first, all if it has fewer and none if it isn't there, h being the crc32 of the
    decimal id modulo BORROWED; then the conversation's own turns after its first h.
    """
    convs = placed.where("place = 0").select(F.col("conv_id").alias("conv"), "total", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), borrowed(F.col("conv_id")).alias("h"))
    heads = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < BORROWED - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "turn", "chars"))).alias("head"))
    led = written(convs.join(heads, "base", "left").select(
        "conv", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:long,turn:binary,chars:long>>")), F.lit(1), F.col("h").cast("int")).alias("head"),
        F.greatest(F.col("total") - F.col("h"), F.lit(0)).alias("own")), "heads")
    first = led.select("conv", F.inline("head")).select("conv", (F.col("place") + 1).alias("depth"), "turn", "chars")
    shift = led.where("own > 0").select(F.col("conv").alias("conv_id"), "h", F.size("head").alias("taken"))
    own = placed.join(shift, "conv_id").where("place >= h").select(F.col("conv_id").alias("conv"), (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "turn", "chars")
    return written(first.unionByName(own), "rebuilt"), led.select("conv", (F.size("head") + F.col("own")).alias("total"))


class Shard:
    """Vertical bitmaps of the conversations of a shard between two depths."""

    def __init__(self, convs: list[int], first: int):
        self.convs, self.first = convs, first
        self.bits: dict[tuple[int, bytes], int] = {}  # (depth, turn): conversations
        self.chars: dict[bytes, int] = {}
        self.ends: dict[int, int] = {}  # depth: conversations that end there
        self.rows: list[list[bytes]] = [[] for _ in convs]  # turns of each conversation; the first is what leads to them

    def add(self, i: int, depth: int, turn: bytes, chars: int) -> None:
        at = depth, turn
        self.bits[at] = self.bits.get(at, 0) | 1 << i
        self.chars[turn] = chars
        self.rows[i].append(turn)

    def ids(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return found

    def nodes(self) -> Iterator[tuple]:
        """(depth, key, parent, bitset, ended, chars, place of the parent) in preorder; the boundary nodes come as roots."""
        stack = [(self.first, key, b"", bits, 0, -1) for (depth, key), bits in self.bits.items() if depth == self.first]
        place = 0
        while stack:
            depth, key, parent, bits, chars, above = stack.pop()
            ended = bits & self.ends.get(depth, 0)
            yield depth, key, parent, bits, ended, chars, above
            rest, step = bits & ~ended, depth - self.first + 1
            while rest:
                i = (rest & -rest).bit_length() - 1
                if step >= len(self.rows[i]):  # it goes on in the next block
                    rest ^= 1 << i
                    continue
                turn = self.rows[i][step]
                child = rest & self.bits[depth + 1, turn]
                rest ^= child
                stack.append((depth + 1, hashlib.sha256(key + turn).digest()[:16], key, child, self.chars[turn], place))
            place += 1


def _local(rows: DataFrame, first: int, block: int) -> DataFrame:
    """Nodes of all shards. ``rows``: conv, depth, turn, chars; those at depth ``first`` have the node's key as turn and the conversation's length as chars.

    Rows with conv set say that this conversation goes on beyond the block from the node ``key``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        conv, depth, chars = (table.column(c).to_numpy() for c in ("conv", "depth", "chars"))
        order = np.lexsort((depth, conv))
        conv, depth, chars = conv[order].tolist(), depth[order].tolist(), chars[order].tolist()
        turn = table.column("turn").take(pa.array(order)).to_pylist()
        heads = [k for k, d in enumerate(depth) if d == first] + [len(conv)]
        for lo in range(0, len(heads) - 1, SHARD):
            part = heads[lo:lo + SHARD + 1]
            shard = Shard([conv[k] for k in part[:-1]], first)
            onward = 0
            for i, (a, b) in enumerate(zip(part, part[1:])):
                for k in range(a, b):
                    shard.add(i, depth[k], turn[k], 0 if k == a else chars[k])
                if chars[a] <= first + block:
                    shard.ends[chars[a]] = shard.ends.get(chars[a], 0) | 1 << i
                else:
                    onward |= 1 << i
            yield from _batch(shard, onward, first, block)

    def _batch(shard: Shard, onward: int, first: int, block: int) -> Iterator[pa.RecordBatch]:
        name = shard.convs[0]
        out: dict[str, list] = {c: [] for c in ("key", "parent", "depth", "n", "least", "chars", "ends", "again")}
        above, going = [], []
        for depth, key, parent, bits, ended, chars, up in shard.nodes():
            above.append(up)
            low = shard.convs[(bits & -bits).bit_length() - 1]
            ends = ",".join(map(str, shard.ids(ended))) if ended else None
            for c, v in zip(out, (key, parent, depth, bits.bit_count(), low, chars, ends, first > 0 and depth == first)):
                out[c].append(v)
            if depth == first + block and bits & onward:
                going += [(key, depth, c) for c in shard.ids(bits & onward)]
        size = [1] * len(above)
        for k in range(len(above) - 1, -1, -1):
            if above[k] >= 0:
                size[above[k]] += size[k]
        n = len(size)
        yield _rows([name] * n, list(range(n)), size, *out.values(), [None] * n)
        if going:
            keys, depths, convs = (list(x) for x in zip(*going))
            none = [None] * len(keys)
            yield _rows([name] * len(keys), none, none, keys, none, depths, none, none, none, none, none, convs)

    def _rows(*columns: list) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        fields = [f.split() for f in _LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    return rows.mapInArrow(run, _LOCAL)


def _end_hashes(local: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes with ends. End lists of several shards are hashed one after the other, in a stream of bounded memory."""
    pieces = local.where("ends is not null").select("key", "shard", "ends")
    counted = pieces.groupBy("key").agg(F.count("*").alias("shards"), F.max("ends").alias("ends"))
    alone = counted.where("shards = 1").select("key", F.sha2("ends", 256).alias("ends_sha256"))
    several = pieces.join(counted.where("shards > 1").select("key"), "key", "left_semi").repartition("key").sortWithinPartitions("key", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key == now:
                    state.update(b"," + ends.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256(ends.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found)], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return alone.unionByName(several.select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string"))


def _subtrees(local: DataFrame, stats: DataFrame, beyond: DataFrame | None) -> DataFrame:
    """(key, saved, leaves): sums over the subtree of every node of a block, what lies beyond the block included."""
    marked = local.join(stats.select("key", "owner", "childless"), "key")
    own = (F.col("shard") == F.col("owner")) & ~F.col("again")
    saved, leaves = F.when(F.col("again"), 0).otherwise(F.col("n") * F.col("chars")) - F.when(own, F.col("chars")).otherwise(0), F.when(own & F.col("childless"), 1).otherwise(0)
    if beyond is not None:
        marked = marked.join(beyond.select("key", F.col("saved").alias("far_saved"), F.col("leaves").alias("far_leaves")), "key", "left")
        saved = saved + F.when(own, F.coalesce("far_saved", F.lit(0))).otherwise(0)
        leaves = leaves + F.when(own, F.coalesce("far_leaves", F.lit(0))).otherwise(0)
    valued = marked.select("shard", "at", "size", "key", saved.cast("long").alias("saved"), leaves.cast("long").alias("leaves"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, size = (table.column(c).to_numpy() for c in ("at", "size"))
        out = {"key": table.column("key")}
        for c in ("saved", "leaves"):
            upto = np.concatenate([[0], np.cumsum(table.column(c).to_numpy())])
            out[c] = pa.array(upto[at + size] - upto[at])
        return pa.table(out)

    sums = valued.groupBy("shard").applyInArrow(run, "key binary, saved long, leaves long")
    return sums.groupBy("key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def nodes(conversations: DataFrame, block: int = BLOCK, rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each distinct sequence of the first d turns of the rebuilt conversations, d from 0: key, parent, conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_chars, ends_sha256.

    key and parent are hashes of the turns that lead there. Repeated rows are turns of their own, empty turns too. A conversation
    without rebuilt turns is a member of the root alone; a table without conversations has no nodes.
    """
    every, convs = rebuilt(turns(conversations))
    longest, many = convs.agg(F.coalesce(F.max("total"), F.lit(-1)), F.count("*")).first()
    start = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("turn"), F.col("total").cast("long").alias("chars"))
    found = []
    first = 0
    while first <= max(longest, 0):
        here = start.unionByName(every.where(F.col("depth").between(first + 1, first + block)))
        size = here.count()
        local = written(_local(here.repartitionByRange(max(1, -(-size // rows)), "conv"), first, block), "trie")
        found.append(local.where("conv is null"))
        first += block
        start = local.where("conv is not null").select("conv", "depth", F.col("key").alias("turn")).join(
            convs.select("conv", F.col("total").cast("long").alias("chars")), "conv")
        if first >= longest:
            break
    new = found[0].where("not again")
    for local in found[1:]:
        new = new.unionByName(local.where("not again"))
    per = written(new.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.sum("n").alias("n_convs"),
        F.min("least").alias("conv_id"), F.min("shard").alias("owner")), "trie-nodes")
    children = per.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    stats = written(per.join(children, "key", "left").select(
        "key", "parent", "depth", "n_convs", "conv_id", "owner", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_children").isNull().alias("childless")), "trie-stats")
    sums, beyond = None, None
    for k in range(len(found) - 1, -1, -1):
        block_sums = _subtrees(found[k], stats, beyond)
        if k:
            block_sums = written(block_sums, "trie-sums")
            again = found[k].where("again").select("key").distinct()
            beyond = block_sums.join(again, "key")
            block_sums = block_sums.join(again, "key", "left_anti")
        sums = block_sums if sums is None else sums.unionByName(block_sums)
    parents = stats.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return stats.join(sums, "key").join(_end_hashes(new), "key", "left").join(parents, "parent", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_chars"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
