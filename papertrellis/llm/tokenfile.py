"""Token ids on disk: canonical length-limited Huffman codes of global counts, in blocks that decode on their own.

Files are Parquet tables of blocks, so Spark's committers write them and any executor may be lost. A block holds whole documents in
order; its bytes are a header, the documents' lengths, the bit offsets of every STRIDE-th id, and the code bits. The code lengths
are a table of their own beside the blocks; canonical codes follow from them. Decoding starts at all checkpoints of a block at once
and looks one code up per step and checkpoint.
"""

from __future__ import annotations

import gc
import itertools
import json
import operator
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from papertrellis.llm.tables import slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
MAGIC = b"HUF1"
#: Longest code in bits; the decoding table has 2 to this power entries. It rises with alphabets of over half as many ids.
LIMIT = 16
STRIDE = 256
#: Ids in a block; a longer document is a block of its own.
BLOCK = 1 << 18
#: Different chunks of text whose ids a worker remembers, and the characters and ids that they may have in sum; beyond either, chunks
#: that were met once since the last time are forgotten.
REMEMBER = 700_000
REMEMBER_SIZE = 32 << 20


# The pattern and the byte alphabet of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_CODES = np.array([_ALPHABET[b] for b in range(256)], "<u4")
#: A byte that no UTF-8 has, and its letter; it stands behind each part that goes to the model, if no merge of the vocabulary has it.
FENCE = chr(_ALPHABET[255])
#: Parts that go to the model in one call.
TOGETHER = 16
#: Ids that are gathered, or coded, at a time: arrays that stay in a core's cache, and memory that need not be mapped anew.
AT_ONCE = 1 << 17
_TOKEN_ID = operator.attrgetter("id")


class Encoder:
    """Ids of texts by the tokenizers library.

    The vocabulary's pre-tokenizer always parts a text before a single space that stands beside a visible character, so the chunks
    between such spaces have the same ids alone as in their text, and a task looks each different chunk up once. Chunks of common
    scripts are cut by the vocabulary's pattern and go to the library's model; other chunks, and texts with a space between white
    space (or at the end behind white space), go through the library whole, as do all texts with another kind of vocabulary.
    """

    _PARTS = regex.compile(PATTERN)
    _APART = re.compile("[\u0500-\U0010ffff]|<\\|")
    _ODD = re.compile(r" (?<=\s )(?:\s|\Z)")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        self.fence = self.tokenizer.token_to_id(FENCE)
        fenced = self.fence is not None and not any(FENCE in half for merge in kind["model"].get("merges", []) for half in merge)
        self.plain = fenced and kind["pre_tokenizer"] == BYTE_LEVEL and not kind["normalizer"] and kind["model"]["type"] == "BPE" and all(t["special"] and "<|" in t["content"] for t in kind["added_tokens"])
        # a key is a chunk without its leading space; the first chunk of a text, which has none, is marked by one
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.known = self.chars = 0
        self.ids, self.held = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep the chunks that were met again, the half that were met most often if they are too many."""
        met = self.met[: self.known]
        least = 2
        while np.count_nonzero(met >= least) > REMEMBER // 2 or self.size[: self.known][met >= least].sum() > REMEMBER_SIZE // 2:
            least *= 2
        keep = np.flatnonzero(met >= least)
        keys = list(self.number)
        keys = [keys[k] for k in keep.tolist()]
        self.chars = sum(map(len, keys))
        if self.chars > REMEMBER_SIZE // 2:
            keep, keys, self.chars = keep[:0], [], 0
        size, first = self.size[keep], self.first[keep]
        end = np.cumsum(size)
        self.held, self.known = int(size.sum()), len(keep)
        ids = self.ids[np.arange(self.held) + np.repeat(first - end + size, size)]
        self.ids = np.concatenate([ids, np.zeros(1 << 16, np.uint32)])
        self.first, self.size, self.met = (np.concatenate([x, np.zeros(1 << 14, np.int64)]) for x in (end - size, size, met[keep] // 2))
        self.number = defaultdict(itertools.count(len(keep)).__next__, zip(keys, range(len(keep))))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _tokenized(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each part has, all their ids one behind the other) by the library's model."""
        data = "".join([p + "\udcff" for p in parts]).encode("utf-8", "surrogateescape")
        spelt = _CODES[np.frombuffer(data, np.uint8)]
        ends = np.flatnonzero(spelt == ord(FENCE)) + 1
        text, cuts = spelt.tobytes().decode("utf-32-le"), [0, *ends[TOGETHER - 1:-1:TOGETHER].tolist(), *ends[-1:].tolist()]
        tokens = map(self.tokenizer.model.tokenize, [text[a:b] for a, b in itertools.pairwise(cuts)])
        ids = np.fromiter(map(_TOKEN_ID, itertools.chain.from_iterable(tokens)), np.uint32)
        fence = np.flatnonzero(ids == self.fence)
        return np.diff(fence, prepend=-1) - 1, ids[ids != self.fence]

    def _learn(self, chunks: list[str]) -> None:
        """Store the ids of chunks, in the order of their numbers."""
        whole = [i for i, c in enumerate(chunks) if self._APART.search(c)] if self._APART.search("".join(chunks)) else []
        near = chunks if not whole else [c for c, apart in zip(chunks, np.isin(np.arange(len(chunks)), whole).tolist()) if not apart]
        found = [(c,) if c[1:].isalpha() and c[0] == " " else self._PARTS.findall(c) for c in near]
        # each different part goes to the model once, and its ids are dealt out to the chunks by their places
        order: dict[str, int] = defaultdict(itertools.count().__next__)
        part = np.fromiter(map(order.__getitem__, itertools.chain.from_iterable(found)), np.int64)
        many, of = self._tokenized(list(order))
        own, parts = many[part], np.fromiter(map(len, found), np.int64, len(found))
        ids = of[np.arange(int(own.sum())) + np.repeat((np.cumsum(many) - many)[part] - np.cumsum(own) + own, own)]
        size = np.diff(np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(parts)])])
        if whole:
            lists = iter(np.split(ids, np.cumsum(size)[:-1]) if len(size) else [])
            far = dict(zip(whole, self._whole([chunks[i] for i in whole])))
            every = [np.array(far[i], np.uint32) if i in far else next(lists) for i in range(len(chunks))]
            size, ids = np.fromiter(map(len, every), np.int64, len(every)), np.concatenate(every)
        n, total = self.known, int(size.sum())
        while self.held + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(size) > len(self.size):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        self.ids[self.held:self.held + total] = ids
        self.first[n:n + len(size)], self.size[n:n + len(size)] = self.held + np.cumsum(size) - size, size
        self.held, self.known = self.held + total, n + len(size)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts' chunks, one text behind the other, and where each text begins, with the end); new chunks get the next numbers.

        Arrow tells different chunks apart first, so each is looked up once for all its occurrences in these texts.
        """
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin, chunks = lists.offsets.to_numpy().astype(np.int64), lists.values
        inner = np.ones(len(chunks), bool)
        inner[begin[:-1]] = False
        coded = chunks.filter(pa.array(inner)).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))
        at = np.empty(len(chunks), np.int64)
        at[inner] = number[coded.indices.to_numpy()]
        at[begin[:-1]] = [self.number[" " + x] for x in chunks.take(pa.array(begin[:-1])).to_pylist()]
        return at, begin

    def _gathered(self, at: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text from the numbers of its chunks."""
        for lo, hi in itertools.pairwise([*np.unique(begin // (AT_ONCE // 2), return_index=True)[1].tolist(), len(begin) - 1]):
            own = at[begin[lo]:begin[hi]]
            size = self.size[own]
            end = np.concatenate([[0], np.cumsum(size)])
            every = self.ids[np.arange(end[-1]) + np.repeat(self.first[own] - end[:-1], size)]
            yield from (every[a:b] for a, b in itertools.pairwise(end[begin[lo:hi + 1] - begin[lo]].tolist()))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id; a null text has none."""
        if not self.plain:
            return [np.array(x, np.uint32) for x in self._whole([t or "" for t in texts])]
        if len(self.number) > REMEMBER or self.held + self.chars > REMEMBER_SIZE:
            self._forget()
        apart = [not text or self._ODD.search(text) is not None for text in texts]
        plain = [text for text, whole in zip(texts, apart) if not whole]
        at, begin = self._numbers(plain)
        if len(self.number) > self.known:
            new = list(itertools.islice(reversed(self.number), len(self.number) - self.known))[::-1]
            self.chars += sum(map(len, new))
            self._learn([k[1:] if k[:1] == " " else " " + k for k in new])
        for a, b in itertools.pairwise(begin.tolist()):
            self.met[at[a:b]] += 1
        found = self._gathered(at, begin)
        out = []
        for text, whole in zip(texts, apart):
            if whole:
                out.append(np.array(self._whole([text])[0] if text else [], np.uint32))
            else:
                out.append(next(found))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; the chunks it has met serve its later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ids with these counts (0: no code), by package and merge."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    limit = max(limit, int(len(ids) - 1).bit_length())
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels, now = len(order), [], weight
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)  # which of the sorted entries are single ids
        now = both[at]
    take, depth = 2 * n - 2, np.zeros(n + 1, np.int64)
    for single in reversed(levels):  # the first so many entries: their ids get a bit, their pairs are opened a level below
        one = int(single[:take].sum())
        depth[0] += 1
        depth[one] -= 1
        take = 2 * (take - one)
    depth[0] += 1
    depth[take] -= 1
    lengths[order] = np.cumsum(depth[:-1])
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, table of ids, table of lengths, width of the table) that follow from code lengths: by length, then by id."""
    ids = np.flatnonzero(lengths)
    width = int(lengths.max()) if len(ids) else 1
    order = ids[np.lexsort((ids, lengths[ids]))]
    step = np.int64(1) << (width - lengths[order].astype(np.int64))
    begin = np.cumsum(step) - step
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (begin >> (width - lengths[order].astype(np.int64))).astype(np.uint64)
    symbol, size = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    symbol[: step.sum()] = np.repeat(order, step)
    size[: step.sum()] = np.repeat(lengths[order], step)
    return codes, symbol, size, width


def pack(documents: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bit offsets of every STRIDE-th id, code bits in whole bytes) of each document."""
    many = np.fromiter(map(len, documents), np.int64, len(documents))
    ids = np.concatenate([np.zeros(0, np.uint32), *documents])
    size = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(many)
    bits = total[last] - total[last - many]
    width = (bits + 7) // 8
    place = np.cumsum(width) - width
    begin = total[:-1] + np.repeat(8 * place - total[last - many], many)
    out = np.zeros(int(width.sum()) // 8 + 2, np.uint64)
    if len(ids):
        word, at = begin >> 6, begin & 63
        over = np.maximum(at + size - 64, 0)
        code = codes[ids]
        here = np.where(over > 0, code >> over.astype(np.uint64), code << (64 - at - size + over).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(here, first)
        crossing = np.flatnonzero(over)
        out[word[crossing] + 1] |= code[crossing] << (64 - over[crossing]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)
    return [((begin[b - n:b:STRIDE] - 8 * p).astype("<u8"), data[p:p + w]) for n, b, p, w in zip(many.tolist(), last.tolist(), place.tolist(), width.tolist())]


def unpack(data: np.ndarray, marks: np.ndarray, many: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Rows of up to STRIDE ids that begin at the bit offsets ``marks``, ``many`` in each; all rows are read side by side."""
    symbol, size, width = table
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    # 40 bits from every byte on
    wide = (padded[:-4] << np.uint64(32)) | (padded[1:-3] << np.uint64(24)) | (padded[2:-2] << np.uint64(16)) | (padded[3:-1] << np.uint64(8)) | padded[4:]
    order = np.argsort(-many, kind="stable")
    at, left = marks[order].astype(np.int64), np.searchsorted(-many[order], -np.arange(STRIDE), side="left")
    out = np.zeros((STRIDE, len(marks)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(int(many.max()) if len(many) else 0):
        here = at[:left[k]]
        code = (wide[here >> 3] >> (40 - width - (here & 7)).astype(np.uint64)) & mask
        out[k, :left[k]] = symbol[code]
        here += size[code]
    back = np.empty_like(out.T)
    back[order] = out.T
    return back


def to_block(documents: list[tuple[int | None, int, bytes]]) -> bytes:
    """One block from documents as (id, number of ids, offsets and bits of pack() one behind the other)."""
    number = np.array([n for _, n, _ in documents], np.int64)
    marks = [8 * -(-n // STRIDE) for n in number.tolist()]
    head = struct.pack("<4sII", MAGIC, STRIDE, len(documents))
    names = b"".join(struct.pack("<?q", i is not None, i or 0) for i, _, _ in documents)
    width = np.array([len(x) - m for (_, _, x), m in zip(documents, marks)], "<i8")
    return b"".join([head, names, number.astype("<i8").tobytes(), width.tobytes(), *[x[:m] for (_, _, x), m in zip(documents, marks)], *[x[m:] for (_, _, x), m in zip(documents, marks)]])


def from_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> list[tuple[int | None, np.ndarray]]:
    magic, stride, documents = struct.unpack_from("<4sII", block)
    if magic != MAGIC or stride != STRIDE:
        raise ValueError("not a block of this format")
    at = struct.calcsize("<4sII")
    names = [(i if some else None) for some, i in struct.iter_unpack("<?q", block[at:at + 9 * documents])]
    at += 9 * documents
    number, width = np.frombuffer(block, "<i8", documents, at), np.frombuffer(block, "<i8", documents, at + 8 * documents)
    at += 16 * documents
    lanes = -(-number // STRIDE)
    marks = np.frombuffer(block, "<u8", int(lanes.sum()), at).astype(np.int64) + np.repeat(8 * (np.cumsum(width) - width), lanes)
    data = np.frombuffer(block, np.uint8, offset=at + 8 * len(marks))
    end = np.cumsum(lanes)
    many = np.full(len(marks), STRIDE)
    some = number > 0
    many[end[some] - 1] = number[some] - STRIDE * (lanes[some] - 1)
    read = unpack(data, marks, many, table)
    return [(i, read[b - k:b].ravel()[:n]) for i, b, k, n in zip(names, end.tolist(), lanes.tolist(), number.tolist())]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Encode every text (null: empty) with the end id behind it, and write blocks in ascending order of the ids under ``path``.

    Null ids come first; rows of one id keep an order by their token ids. Ids must be whole numbers. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    ids_at = f"{path}/unsorted"
    kind = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(vocabulary), np.zeros(0, np.int64)
        none = [pa.array([[]], pa.list_(t)) for t in (pa.int32(), pa.int64())]
        gc.disable()  # millions of small lists, none of them in a ring
        try:
            for batch in slices(batches, "text"):
                ids = [np.append(x, end).astype(kind).tobytes() for x in own.encode(batch.column("text").to_pylist())]
                seen = np.bincount(np.frombuffer(b"".join(ids), kind))
                if len(seen) > len(total):
                    seen, total = total, seen.astype(np.int64)
                total[: len(seen)] += seen
                nulls = [pa.nulls(len(ids), x.type) for x in none]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary()), *nulls], names=["id", "ids", "tokens", "counts"])
        finally:
            gc.enable()
        # the task's counts in a row of their own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64()))], names=["id", "ids", "tokens", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(tokens, "id long, ids binary, tokens array<int>, counts array<long>").write.option("compression", "zstd").parquet(ids_at)
    stored = spark.read.parquet(ids_at)
    counted = stored.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    # one row per id of the vocabulary at most
    seen = counted.groupBy(F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("n")).toPandas()
    stored = stored.where("ids is not null").select("id", "ids")
    counts = np.zeros(int(seen["token"].max()) + 1 if len(seen) else 1, np.int64)
    counts[seen["token"].to_numpy(int)] = seen["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast(lengths)

    # ranges of ids from the stored ids alone, so that nothing is coded only to be sampled
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stored.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(found, np.float64))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sent.value
        codes = canonical(size)[0]
        for batch in slices(batches, "ids", AT_ONCE * np.dtype(kind).itemsize):
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            bits = [m.tobytes() + d.tobytes() for m, d in pack(ids, codes, size)]
            part = [0 if i is None else int(np.searchsorted(bounds, float(i))) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(part, pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array(bits, pa.binary())], names=["id", "part", "n", "bits"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number, part, before = [], 0, 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([to_block(held)], pa.binary()),
            ], names=["part", "number", "before", "n", "block"])

        for batch in slices(batches, "bits"):
            for i, k, many, bits in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "n", "bits"))):
                if held and n + many > BLOCK:
                    yield row()
                    held, n, number, before = [], 0, number + 1, before + n
                part = k
                held.append((i, many, bits))
                n += many
        if held:
            yield row()

    # what is shuffled is coded already
    dealt = stored.mapInArrow(coded, "id long, part int, n long, bits binary").repartitionById(parts, F.col("part"))
    dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "bits").mapInArrow(blocks, "part int, number int, before long, n long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids array<int>): the documents of the files, start being the number of ids before them."""
    return _decoded(spark, path, False)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of the documents in the files; the ids themselves stay in the tasks."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, brief: bool) -> DataFrame:
    lengths = spark.read.parquet(f"{path}/code").first()["lengths"]
    sent = spark.sparkContext.broadcast(lengths)
    stored = spark.read.parquet(f"{path}/blocks")
    # ids before each part: one row per written file, so blocks need not move
    parts = stored.groupBy("part").agg(F.sum("n").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = stored.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("before")).alias("block_start"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, symbol, size, width = canonical(np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                found = from_block(batch.column(1)[k].as_py(), (symbol, size, width))
                n = np.array([len(x) for _, x in found], np.int64)
                start = batch.column(0)[k].as_py() + np.cumsum(n) - n
                ids = pa.array([i for i, _ in found], pa.int64())
                if brief:
                    crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), crc], names=["id", "start", "n_tokens", "ids_crc32"])
                else:
                    for a in range(len(found)):
                        yield pa.RecordBatch.from_arrays([ids.slice(a, 1), pa.array(start[a:a + 1]), pa.array([found[a][1].astype(np.int32)], pa.list_(pa.int32()))], names=["id", "start", "ids"])

    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" if brief else "id long, start long, ids array<int>")
