"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Frequent words are classes of their own, all others fall into classes by
their last bytes, so unknown words have a class too. The class softmax has hashed features of the history: the word before, the class
of the word before that (skip), and both together, besides a bias. What the corpus says about it is the count of every (history,
class); gradients over these counts are taken by Spark tasks and summed for each update. P(word | class) is the softmax over the
class with one feature per word, whose optimum is the relative count; a discount leaves room for one unknown word per class.

Every word is a history of its own, however many there are: P(word | class) has a feature for each pair of neighbours in the training
texts, and so has P(class | history) where the word before is not one of those that the class softmax names. Their optimum under
discounted counts is the discounted share of the pair, plus what the discounts leave times the probability without the feature.

Pairs grow with the corpus and are dealt over shards by the word before (behind named words by its followers' class too). Texts are
scored in blocks: a block asks every shard once for each of its different pairs, and scores its tokens with the answers. Beyond the head,
words are told apart by hashes of 63 bits, and followers of a word by class and 48 bits. Counts of the head go to every task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from papertrellis.llm.tables import raw, rows, slices, written

END = b"\n"  # no word has white space
#: Words whose counts every task knows.
HEAD = 1 << 16
#: Classes, and how many of them are single words (the end among them).
CLASSES, SINGLE = 64, 32
#: Words that the class softmax tells apart as the word before; it counts others as their class, and their pairs tell these apart.
NAMED = 256
CONTEXTS = (NAMED + CLASSES) * CLASSES
#: Rows of the weight table that features are hashed to.
BUCKETS = 1 << 13
#: Tasks that sum up the gradients of the counting tasks, each for its share of the weight rows.
SUMMERS = 16
BASE = 0.1
#: Observations that a weight has to outweigh before it moves.
PRIOR = 10.0
#: Different words that a counting task holds before it hands them on.
HELD = 200_000
#: Text bytes of a block, whose pairs are counted or asked for together; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: What is taken off every pair's count, and off every count of a class behind a word.
PAIR_DISCOUNT = 0.75
#: Bits of a word's hash in the code of a follower, below its class.
FOLLOWER_BITS = 48
#: Numbers from here on stand for words of the head.
HEAD_FLAG = np.uint64(1 << 63)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end; a null text has the end alone."""
    return [*(text or b"").lower().split(), END]


def _tail_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-2:]) % (CLASSES - SINGLE)


def _hashed(kind: int, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (value.astype(np.uint64) * np.uint64(8) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def features(contexts: np.ndarray) -> np.ndarray:
    """Weight rows of each context: word before, skipped word's class, both, bias."""
    before, skipped = contexts // CLASSES, contexts % CLASSES
    return np.stack([_hashed(0, before), _hashed(1, skipped), _hashed(2, contexts), np.full(len(contexts), _hashed(3, np.zeros(1))[0])], 1)


def class_logs(contexts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes, one row per context."""
    z = weights[features(contexts)].sum(1)
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Model:
    """head: the frequent words, most frequent first, with their counts; per class: tokens, different words, discount; weights."""

    head: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: np.ndarray
    weights: np.ndarray

    def base_log(self, c):
        return np.log10((c + BASE) / (self.total + BASE * (self.distinct + 1)))

    def unknown_log(self) -> np.ndarray:
        """log10 P(unknown word | class); a class without words has nothing else."""
        n = np.maximum(self.class_tokens, 1)
        return np.where(self.class_words > 0, np.log10(np.maximum(self.discount * self.class_words, 1e-300) / n), 0.0)


class Reader:
    """Turns tokens into numbers: index in the head (or -1), class, and context."""

    def __init__(self, head: list[bytes]):
        self.index = {w: i for i, w in enumerate(head)}
        own = [w for w in head if w != END][: SINGLE - 1]
        single = {END: 0} | {w: i + 1 for i, w in enumerate(own)}
        self.head_class = np.array([single.get(w, -1) if w in single else _tail_class(w) for w in head] or [0], np.int64)
        self.suffix: dict[bytes, int] = {}

    def _by_suffix(self, word: bytes) -> int:
        key = word[-2:]
        found = self.suffix.get(key)
        if found is None:
            found = self.suffix[key] = _tail_class(word)
        return found

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(head index or -1, class) of words."""
        index = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        kind = self.head_class[index]
        for i in np.flatnonzero(index < 0).tolist():
            kind[i] = self._by_suffix(words[i]) if words[i] != END else 0
        return index, kind

    def read(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, sizes of the texts, head index, class, context) of the texts' tokens, one after the other."""
        words, size = [], []
        for text in texts:
            found = tokens(text)
            size.append(len(found))
            words += found
        get = self.index.get
        index = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        kind = self.head_class[index]
        tail = np.flatnonzero(index < 0)
        kind[tail] = [self._by_suffix(words[i]) if words[i] != END else 0 for i in tail.tolist()]
        size = np.array(size, np.int64)
        first = np.cumsum(size) - size
        name = np.where((index >= 0) & (index < NAMED), index, NAMED + kind)
        before = np.concatenate([[0], name[:-1]]) if len(name) else name
        skipped = np.concatenate([[0, 0], kind[:-2]])[: len(kind)]
        start = self.index.get(END, -1)
        before[first] = start if 0 <= start < NAMED else NAMED  # a text begins behind an end
        skipped[first] = 0
        second = first[size > 1] + 1
        skipped[second] = 0
        return words, size, index, kind, before * CLASSES + skipped


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token binary, c long) over all tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches, text_col):
            for text in raw(batch.column(text_col)):
                held.update(tokens(text))
            if len(held) > HELD:
                yield rows({"token": pa.binary(), "c": pa.int64()}, token=list(held), c=list(held.values()))
                held = Counter()
        yield rows({"token": pa.binary(), "c": pa.int64()}, token=list(held), c=list(held.values()))

    return docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _class_sums(counts: DataFrame, head: list[bytes]) -> np.ndarray:
    """Per class: tokens, words, words seen once, words seen twice."""
    sent = counts.sparkSession.sparkContext.broadcast(head[:SINGLE + 1])
    names = ["tokens", "words", "once", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(sent.value), np.zeros((CLASSES, 4), np.int64)
        single = {w: k for w, k in zip(sent.value, reader.head_class) if k < SINGLE} | {END: 0}
        for batch in batches:
            kind = np.array([single[w] if w in single else reader._by_suffix(w) for w in batch.column("token").to_pylist()], np.int64)
            c = batch.column("c").to_numpy()
            for k, x in enumerate((c, np.ones(len(c)), c == 1, c == 2)):
                sums[:, k] += np.bincount(kind, x, CLASSES).astype(np.int64)
        yield rows({"kind": pa.int32()} | {n: pa.int64() for n in names}, kind=np.arange(CLASSES), **{n: sums[:, k] for k, n in enumerate(names)})

    found = counts.mapInArrow(run, "kind int, " + ", ".join(f"{n} long" for n in names)).groupBy("kind").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((CLASSES, 4), np.int64)
    out[found["kind"].to_numpy(int)] = found[names].to_numpy(np.int64)
    return out


def history_counts(docs: DataFrame, head: list[bytes], text_col: str = "text") -> DataFrame:
    """(context, kinds array<int>, n array<long>): how often each class follows each context, over all texts."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(sent.value), np.zeros(CONTEXTS * CLASSES, np.int64)
        for batch in slices(batches, text_col):
            _, _, _, kind, context = reader.read(raw(batch.column(text_col)))
            seen += np.bincount(context * CLASSES + kind, minlength=len(seen))
        some = np.flatnonzero(seen)
        for lo in range(0, len(some), 100_000):
            part = some[lo:lo + 100_000]
            yield rows({"context": pa.int32(), "kind": pa.int32(), "n": pa.int64()}, context=part // CLASSES, kind=part % CLASSES, n=seen[part])

    cells = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "context int, kind int, n long").groupBy("context", "kind").agg(F.sum("n").alias("n"))
    # a context has CLASSES cells at most
    return cells.groupBy("context").agg(F.collect_list(F.struct("kind", "n")).alias("cells")).select("context", F.col("cells.kind").alias("kinds"), F.col("cells.n").alias("n"))


def gradient(histories: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient of the log likelihood by the weights, expected count of each weight, log likelihood), summed by weight row in Spark."""
    sent = histories.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, like = sent.value, np.zeros((BUCKETS, 2 * CLASSES)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            context = batch.column("context").to_numpy()
            of = np.repeat(np.arange(len(context)), batch.column("kinds").value_lengths().to_numpy())
            seen = np.zeros((len(context), CLASSES))
            np.add.at(seen, (of, batch.column("kinds").flatten().to_numpy()), batch.column("n").flatten().to_numpy())
            log = class_logs(context, w)
            like += float((seen * log).sum())
            expected = seen.sum(1, keepdims=True) * np.exp(log)
            step = np.hstack([seen - expected, expected])
            for column in features(context).T:
                np.add.at(total, column, step)
        some = np.flatnonzero(np.abs(total).sum(1))
        yield rows(parts, bucket=[-1, *some.tolist()], g=[b"", *[g.tobytes() for g in total[some]]], like=[like] + [0.0] * len(some))

    def summed(table: pa.Table) -> pa.Table:
        bucket, at = np.unique(table.column("bucket").to_numpy(), return_inverse=True)
        own = table.column("g").to_pylist()
        total = np.zeros((len(bucket), 2 * CLASSES))
        for k, g in zip(at.tolist(), own):
            if g:
                total[k] += np.frombuffer(g)
        like = np.bincount(at, table.column("like").to_numpy(), len(bucket))
        return pa.Table.from_batches([rows(parts, bucket=bucket, g=[g.tobytes() for g in total], like=like)])

    parts = {"bucket": pa.int32(), "g": pa.binary(), "like": pa.float64()}
    schema = "bucket int, g binary, like double"
    found = histories.mapInArrow(run, schema).groupBy(F.pmod("bucket", F.lit(SUMMERS))).applyInArrow(summed, schema).toArrow()
    out, bucket = np.zeros((BUCKETS, 2 * CLASSES)), found.column("bucket").to_numpy()
    for k, g in zip(bucket.tolist(), found.column("g").to_pylist()):
        if k >= 0:
            out[k] = np.frombuffer(g)
    like = float(found.column("like").to_numpy().sum())
    return out[:, :CLASSES], out[:, CLASSES:], like


def shards(total: int) -> int:
    """Shards of the pairs of ``total`` tokens: 128 at most while they are small, then one for every two million tokens."""
    return max(1, min(total >> 14, 128), total >> 21)


def _zipped(*columns: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes, then all second bytes and so on, compressed."""
    flat = np.concatenate([x.view(np.uint64) for x in columns])
    packed = pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)
    return len(flat).to_bytes(8, "little") + packed


def _unzipped(packed: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    flat = np.frombuffer(pa.decompress(packed[8:], n * 8, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).reshape(columns, -1)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _keys(words: list[bytes], kind: np.ndarray) -> np.ndarray:
    """(hash as the word before, code as a follower: class and hash), one column per word."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return np.stack([h >> np.uint64(1), kind.astype(np.uint64) << np.uint64(FOLLOWER_BITS) | h >> np.uint64(64 - FOLLOWER_BITS)])


def _named(numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys, where numbers of the head stand for its words."""
    own = numbers >= HEAD_FLAG
    return np.where(own, keys[np.where(own, numbers & np.uint64(HEAD - 1), 0).astype(np.int64)], numbers) if len(keys) else numbers


class Block:
    """Tokens of some texts as numbers of their different words, and their different pairs (word before, word) in the order of shards."""

    def __init__(self):
        self.ids, self.number, self.before, self.teach = {END: 0}, [], [], []

    def add(self, words: list[bytes], size: np.ndarray, teach: np.ndarray | None = None) -> None:
        ids = self.ids
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        before = np.concatenate([[0], number[:-1]])
        before[np.cumsum(size) - size] = 0  # a text begins behind an end
        self.number.append(number)
        self.before.append(before)
        if teach is not None:
            self.teach.append(np.repeat(teach, size))

    def close(self, reader: Reader, count: int) -> None:
        """Sets, per word, index and kind; per token, its pair; per pair, word before v, word w, shard, and n, tokens that teach."""
        words = list(self.ids)
        self.index, self.kind = reader.numbers(words)
        self.keys = _keys(words, self.kind)
        order = [np.argsort(key, kind="stable") for key in self.keys]
        place = [np.empty(len(words), np.int64) for _ in order]
        for of, by in zip(place, order):
            of[by] = np.arange(len(words))
        self.number = np.concatenate(self.number)
        pairs, at = np.unique(place[0][np.concatenate(self.before)] << 32 | place[1][self.number], return_inverse=True)
        v, w = order[0][pairs >> 32], order[1][pairs & 0xFFFFFFFF]
        # pairs behind a named word are dealt by it and the class
        spread = self.keys[0][v] >> np.uint64(20)
        named = (self.index[v] >= 0) & (self.index[v] < NAMED)
        spread[named] += self.kind[w[named]].astype(np.uint64) * np.uint64(0x9E3779B1)
        shard = (spread % np.uint64(count)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.v, self.w, self.shard = place[at], v[order], w[order], shard[order]
        self.n = np.bincount(self.at, np.concatenate(self.teach) if self.teach else None, len(order)).astype(np.int64)
        self.first = _starts(self.shard, self.v)  # of each shard's different words before

    def packed(self) -> dict[str, list]:
        """Per shard: its different words before and how many followers each has; followers and counts. Words of the head by number."""
        ends, out = np.append(_starts(self.shard), len(self.shard)), {"shard": [], "words": [], "pairs": []}
        of = np.searchsorted(self.first, ends)
        followers = np.diff(np.append(self.first, len(self.shard)))
        before, code = (np.where(self.index >= 0, HEAD_FLAG + self.index.astype(np.uint64), key) for key in self.keys)
        before, code = before[self.v[self.first]], code[self.w]
        for a, b, lo, hi in zip(ends, ends[1:], of, of[1:]):
            out["shard"].append(int(self.shard[a]))
            out["words"].append(_zipped(before[lo:hi], followers[lo:hi]))
            out["pairs"].append(_zipped(code[a:b], self.n[a:b]))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of a task's rows in order, whatever batches they come in; the rows of a block come one after the other."""
    task, seen = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
        block = (seen + np.cumsum(size) - size) // BLOCK_BYTES
        seen += int(size.sum())
        cuts = [*_starts(block).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield task + int(block[a]), batch.slice(a, b - a)


def _asked(docs: DataFrame, head: list[bytes], total: int, text_col: str, teach_col: str | None = None) -> DataFrame:
    """Different pairs of every block of texts: __block, shard, words, pairs; n counts the tokens of rows where ``teach_col`` is true."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, number, held = Reader(sent.value), None, Block()

        def closed() -> pa.RecordBatch:
            held.close(reader, shards(total))
            packed = held.packed()
            return rows(kinds, __block=[number] * len(packed["shard"]), **packed)

        for block, batch in _blocks(batches, text_col):
            if block != number and held.number:
                yield closed()
                held = Block()
            number = block
            for part in slices(iter([batch]), text_col):
                found = [tokens(t) for t in raw(part.column(text_col))]
                teach = part.column(teach_col).to_numpy(zero_copy_only=False).astype(np.int64) if teach_col else None
                held.add([w for t in found for w in t], np.array([len(t) for t in found], np.int64), teach)
        if held.number:
            yield closed()

    kinds = {"__block": pa.int64(), "shard": pa.int32(), "words": pa.binary(), "pairs": pa.binary()}
    return docs.select(F.col(text_col), *([teach_col] if teach_col else [])).mapInArrow(run, "__block long, shard int, words binary, pairs binary")


def _head_keys(head: list[bytes]) -> np.ndarray:
    return _keys(head, Reader(head).head_class[: len(head)])


def _unpacked(table: pa.Table, keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per row followers of its words before, and codes; of all pairs hash of the word before, code and count."""
    words = [_unzipped(x, 2) for x in table.column("words").to_pylist()]
    pairs = [_unzipped(x, 2) for x in table.column("pairs").to_pylist()]
    none = np.zeros((2, 0), np.uint64)
    followers = [x[1].astype(np.int64) for x in words]
    v = np.concatenate([none[0], *[x[0] for x in words]])
    w, n = np.concatenate([none, *pairs], 1)
    return followers, [x[0] for x in pairs], np.repeat(_named(v, keys[0]), np.concatenate([none[0], *followers]).astype(np.int64)), _named(w, keys[1]), n.astype(np.int64)


def pair_counts(docs: DataFrame, head: list[bytes], total: int, text_col: str = "text") -> DataFrame:
    """Counts of all pairs (word before, word) of all texts: shard, words, pairs, one row per shard, no word by number."""
    sent = docs.sparkSession.sparkContext.broadcast(_head_keys(head))

    def merged(table: pa.Table) -> pa.Table:
        _, _, h, w, n = _unpacked(table, sent.value)
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order]
        start = _starts(h, w)
        h, w, n = h[start], w[start], np.add.reduceat(n, start)
        first = _starts(h)
        return pa.table({"shard": table.column("shard")[:1], "words": [_zipped(h[first], np.diff(np.append(first, len(h))))], "pairs": [_zipped(w, n)]})

    texts = docs.select(F.col(text_col).cast("string").alias(text_col))
    return written(_asked(texts, head, total, text_col).drop("__block").groupBy("shard").applyInArrow(merged, "shard int, words binary, pairs binary"), "pair-counts")


def _answers(asked: pa.Table, known: pa.Table | None, keys: np.ndarray) -> pa.Table:
    """Answers of a shard to the blocks that asked. pairs: count c, tokens and different words of the class behind the word before.
    words: tokens and different classes behind the word before. Counts are those of ``known``, or those that the blocks sent along.
    """
    followers, codes, h, w, n = _unpacked(asked, keys)
    if known is not None:
        _, _, more_h, more_w, more_n = _unpacked(known, keys)
        h, w, n = np.concatenate([h, more_h]), np.concatenate([w, more_w]), np.concatenate([n * 0, more_n])
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    pair, kind, word = _starts(h, w), _starts(h, w >> np.uint64(FOLLOWER_BITS)), _starts(h)

    def each(start: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums of the runs that begin at ``start``, at every place before sorting."""
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(sums, np.diff(np.append(start, len(order))))
        return out

    c, nk = np.add.reduceat(n, pair), np.add.reduceat(n, kind)
    tk, tv = np.add.reduceat((c > 0).astype(np.int64), np.searchsorted(pair, kind)), np.add.reduceat((nk > 0).astype(np.int64), np.searchsorted(kind, word))
    c, nk, tk, nv, tv = each(pair, c), each(kind, nk), each(kind, tk), each(word, np.add.reduceat(n, word)), each(word, tv)
    ends = np.cumsum([0, *map(len, codes)])
    words, pairs = [], []
    for lo, hi, f in zip(ends, ends[1:], followers):
        begin = lo + np.cumsum(f) - f
        words.append(_zipped(nv[begin], tv[begin]))
        pairs.append(_zipped(c[lo:hi], nk[lo:hi], tk[lo:hi]))
    return pa.table({"__block": asked.column("__block"), "shard": asked.column("shard"), "words": pa.array(words, pa.binary()), "pairs": pa.array(pairs, pa.binary())})


def fit(docs: DataFrame, text_col: str = "text", rounds: int = 10, rate: float = 0.5) -> Model:
    """The model but for its pairs, from all texts of ``docs``.

    The driver holds the HEAD most frequent words, one row of sums per class and the weight table, all of fixed size. Without a text
    all classes are equally likely and no word is known.
    """
    counts = written(count_words(docs, text_col), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    head, head_counts = top["token"].to_pylist(), top["c"].to_numpy().copy()
    sums = _class_sums(counts, head)
    discount = np.clip(sums[:, 2] / np.maximum(sums[:, 2] + 2 * sums[:, 3], 1), 0.1, 0.9)
    discount[:SINGLE] = 0  # one word each: nothing is left for others
    weights = np.zeros((BUCKETS, CLASSES))
    weights[_hashed(3, np.zeros(1))[0]] = np.log((sums[:, 0] + 1) / (total + CLASSES))
    if total:
        histories = written(history_counts(docs, head, text_col).coalesce(16), "histories")
        for _ in range(rounds):
            g, expected, _ = gradient(histories, weights)
            # every history has four features: a step of each by its share of the gap, short where little was seen
            weights = weights + np.clip(rate * g / (expected + PRIOR), -1, 1)
    return Model(head, head_counts, int(total), int(distinct), sums[:, 0], sums[:, 1], discount, weights)


def learn(docs: DataFrame, text_col: str = "text", rounds: int = 10, rate: float = 0.5) -> tuple[Model, DataFrame]:
    """(model, counts of pairs as ``pair_counts`` returns them) from all texts of ``docs``."""
    model = fit(docs, text_col, rounds, rate)
    return model, pair_counts(docs, model.head, model.total, text_col)


def _discounted(c: np.ndarray, n: np.ndarray, t: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Discounted share c of n, and what t discounts leave by the probability ``otherwise``; that alone where n is zero."""
    seen = np.maximum(n, 1)
    return np.where(n > 0, (np.maximum(c - PAIR_DISCOUNT, 0) + PAIR_DISCOUNT * t * otherwise) / seen, otherwise)


def score(docs: DataFrame, model: Model, counts: DataFrame | None = None, text_col: str = "text", teach_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, and n_tokens, n_known, train_tokens, base_score, score (log10); such columns are replaced.

    base_score: every token's smoothed share of the training tokens. score: the model's log10 probability. A null text has the end
    alone. Rows are scored each on its own, repeats too. Pair counts are ``counts``, or those of the rows of ``docs`` where the boolean
    ``teach_col`` is true: the rows that the model was fitted on. ``docs`` is read twice, each task's texts in the order of their hashes.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in added and c != text_col]
    teach = [F.coalesce(F.col(f"`{teach_col}`"), F.lit(False)).alias("__teach")] if teach_col else []
    docs = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).cast("string").alias("__text"), *teach)
    # both readings make the same blocks, in whatever order a task gets its rows
    docs = docs.sortWithinPartitions(F.xxhash64("__text"), "__text")
    texts = docs.drop("__teach")
    numbered = StructType([*texts.schema, StructField("__block", LongType())])
    kept = StructType([f for f in texts.schema if f.name != "__text"] + [StructField(n, DoubleType() if n in ("base_score", "score") else LongType()) for n in added])
    context, count = docs.sparkSession.sparkContext, shards(model.total)
    sent, keys = context.broadcast(model), context.broadcast(_head_keys(model.head))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        return _answers(asked, known, keys.value) if asked.num_rows else asked

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block))], names=[*batch.schema.names, "__block"])

    def scored(texts: pa.Table, replies: pa.Table) -> pa.Table:
        m = sent.value
        reader, block = Reader(m.head), Block()
        sizes, kinds, contexts = [], [], []
        for part in slices(iter(texts.select(["__text"]).combine_chunks().to_batches()), "__text"):
            words, size, _, kind, before = reader.read(raw(part.column("__text")))
            block.add(words, size)
            for held, x in ((sizes, size), (kinds, kind), (contexts, before)):
                held.append(x)
        size, kind, before = np.concatenate(sizes), np.concatenate(kinds), np.concatenate(contexts)
        block.close(reader, count)
        replies = replies.sort_by("shard")
        nv, tv = np.concatenate([_unzipped(x, 2) for x in replies.column("words").to_pylist()], 1).astype(np.int64)
        c, nk, tk = np.concatenate([_unzipped(x, 3) for x in replies.column("pairs").to_pylist()], 1).astype(np.int64)
        if len(c) != len(block.v) or len(nv) != len(block.first):
            raise RuntimeError("the texts to score changed between two readings")
        each = np.diff(np.append(block.first, len(c)))
        nv, tv = np.repeat(nv, each), np.repeat(tv, each)
        # a word's count is that of all pairs it begins; those of the head are known
        seen = np.zeros(len(block.index), np.int64)
        seen[block.v] = nv
        head = block.index >= 0
        seen[head] = m.counts[block.index[head]]
        alone = np.where(seen > 0, np.maximum(seen - m.discount[block.kind], 1e-9) / np.maximum(m.class_tokens[block.kind], 1), 10 ** m.unknown_log()[block.kind])
        alone[block.kind < SINGLE] = 1.0
        word = np.log10(_discounted(c, nk, tk, alone[block.w]))
        different, at = np.unique(before, return_inverse=True)
        soft = np.exp(class_logs(different, m.weights))[at, kind]
        told = (block.index[block.v] >= 0) & (block.index[block.v] < NAMED)
        nv[told] = 0  # the class softmax names them
        log = word[block.at] + np.log10(_discounted(nk[block.at], nv[block.at], tv[block.at], soft))
        first = np.cumsum(size) - size
        sums = [np.add.reduceat(x, first) for x in ((seen > 0)[block.number].astype(np.int64), m.base_log(seen)[block.number], log)]
        columns = [texts.column(i) for i in range(len(others))] + [pa.array(x) for x in (size, sums[0], np.full(len(size), m.total), *sums[1:])]
        return pa.Table.from_arrays(columns, names=[*others, *added])

    shape = "__block long, shard int, words binary, pairs binary"
    asked = _asked(docs, model.head, model.total, "__text", "__teach" if teach_col else None).groupBy("shard")
    replies = asked.applyInArrow(lambda table: _answers(table, None, keys.value), shape) if teach_col else asked.cogroup(counts.groupBy("shard")).applyInArrow(answer, shape)
    return texts.mapInArrow(number, numbered).groupBy("__block").cogroup(replies.groupBy("__block")).applyInArrow(scored, kept)
