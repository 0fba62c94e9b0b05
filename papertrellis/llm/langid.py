"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A word is scored by the forward algorithm: the probability of all its cuts into vocabulary pieces, where a letter that is no piece
of its own counts as the one piece "other letter". Words of up to WORD characters are summed many at a time; longer ones, of any
length, one by one with sums that are scaled on the way, so no word is cut. Training starts from flat probabilities and takes expected piece counts by
forward and backward sums, per language, over all labelled texts; every round is one pass of Spark tasks that each return at most
one row per piece and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from papertrellis.llm.tables import rows, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
START = "▁"
#: Longest word whose sums fit a double as they are; sums of longer ones are scaled every RESCALE characters.
WORD, RESCALE = 40, 8
#: Longest piece of the vocabulary that is taken.
PIECE = 32
#: Smallest probability of a piece; forty of them still fit a double.
FLOOR = 1e-7
SLICE = 6 << 20
#: Words whose sums are held at a time; what a worker holds doesn't grow with the different words of a slice.
WORDS = 1 << 14
#: Edges of a long word that are weighed at a time.
EDGES = 1 << 18
_ASCII_LETTERS = re.compile(r"[a-z]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PIECE = regex.compile(r"[\p{L}\p{M}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with their word mark; the file is read on the driver only."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if _PIECE.fullmatch(p.removeprefix(START)) and len(p) <= PIECE or p == START)


class Pieces:
    """Finds the pieces in words. Piece 0 is "other letter"; the others follow the list."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash_one(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], (order + 1).astype(np.int32)
        self.first = np.searchsorted(self.keys >> np.uint64(48), np.arange(65537, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.first).max()) if len(pieces) else 0
        self.keys = np.append(self.keys, np.zeros(self.depth + 1, np.uint64))
        self.ids = np.append(self.ids, np.full(self.depth + 1, -1, np.int32))
        self.single = np.zeros(0x110000, np.int32)
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.single[ord(p)] = i + 1

    @staticmethod
    def _mix(h):
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    @classmethod
    def _hash_one(cls, piece: str) -> np.uint64:
        with np.errstate(over="ignore"):
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = h * _BASE + np.uint64(ord(c))
            return cls._mix(h + np.uint64(len(piece)))[0]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        at = self.first[(hashes >> np.uint64(48)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        for d in range(self.depth):
            hit = self.keys[at + d] == hashes
            out[hit] = self.ids[at[hit] + d]
        return out

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Order of the words by falling length, the lengths, and for each end position the (start, word rows, piece ids)."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        length = length[order]
        most = int(length[0])
        code = np.array([words[i] for i in order], f"U{most}").view(np.uint32).reshape(len(words), most)
        active = np.searchsorted(-length, -np.arange(most + 1), side="right")  # rows with at least so many letters
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.full(self.longest + 1, _BASE, np.uint64)) if self.longest else None
            prefix = [np.zeros(len(words), np.uint64)]
            ends = []
            for j in range(1, most + 1):
                n = active[j]
                prefix.append(prefix[-1][:n] * _BASE + code[:n, j - 1].astype(np.uint64))
                here = [(j - 1, np.arange(n), self.single[code[:n, j - 1]])]
                for k in range(2, min(j, self.longest) + 1):
                    ids = self.find(self._mix(prefix[j] - prefix[j - k][:n] * power[k - 1] + np.uint64(k)))
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        here.append((j - k, hit, ids[hit]))
                ends.append(here)
        return order, length, ends

    def forward(self, words: list[str], prob: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray, np.ndarray]:
        """Sums over all segmentations of words of up to WORD characters: (words, columns of prob), and what goes backward again."""
        order, length, ends = self.spans(words)
        alpha = [np.ones((len(words), prob.shape[1]))]
        for here in ends:
            now = np.zeros((len(here[0][1]), prob.shape[1]))
            for start, at, ids in here:
                now[at] += alpha[start][at] * prob[ids]
            alpha.append(now)
        total = np.empty((len(words), prob.shape[1]))
        for j in np.unique(length):
            total[order[length == j]] = alpha[j][length[: len(alpha[j])] == j]
        return total, ends, alpha, order, length

    def edges(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every piece in one word of any length."""
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n = len(code)
        wide = code.astype(np.uint64)
        starts, ends, ids = [np.arange(n)], [np.arange(1, n + 1)], [self.single[code]]
        power = np.ones(1, np.uint64)
        hashes = wide
        with np.errstate(over="ignore"):
            for k in range(2, min(n, self.longest) + 1):
                power = power * _BASE
                hashes = hashes[1:] + wide[: n - k + 1] * power
                found = self.find(self._mix(hashes + np.uint64(k)))
                hit = np.flatnonzero(found >= 0)
                starts.append(hit)
                ends.append(hit + k)
                ids.append(found[hit])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)

    def swept(self, came: np.ndarray, to: np.ndarray, ids: np.ndarray, prob: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums of one word at positions 0 to n as (scaled sums, natural logs of their scales)."""
        order = np.argsort(to, kind="stable")
        came, ids = came[order], ids[order]
        first = np.searchsorted(to[order], np.arange(1, n + 2)).tolist()
        sums, log = np.zeros((n + 1, prob.shape[1])), np.zeros((n + 1, prob.shape[1]))
        sums[0] = 1
        for j in range(1, n + 1):
            here = slice(first[j - 1], first[j])
            sums[j] = (sums[came[here]] * prob[ids[here]]).sum(0)
            log[j] = log[j - 1]
            if j % RESCALE == 0:
                near = slice(max(0, j + 1 - self.longest), j + 1)  # all that later positions look at has one scale
                top = sums[near].max(0)
                sums[near] /= top
                log[near] += np.log(top)
        return sums, log

    @staticmethod
    def _short(size: np.ndarray) -> list[np.ndarray]:
        """The words of up to WORD characters, WORDS at a time, those of like length together."""
        order = np.argsort(size, kind="stable")
        order = order[: np.searchsorted(size[order], WORD, side="right")]
        return [order[k:k + WORDS] for k in range(0, len(order), WORDS)]

    def log_sums(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Natural logs of the sums over all segmentations (words, columns of prob), words of any length."""
        out = np.empty((len(words), prob.shape[1]))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for some in self._short(size):
            out[some] = np.log(self.forward([words[i] for i in some], prob)[0])
        for i in np.flatnonzero(size > WORD):
            sums, log = self.swept(*self.edges(words[i]), prob, int(size[i]))
            out[i] = np.log(sums[-1]) + log[-1]
        return out

    def expected(self, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces, columns of weight) of words of any length that weigh so much in each language."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((self.size, weight.shape[1]))
        for some in self._short(size):
            out += self._expected_short([words[i] for i in some], weight[some], prob)
        for i in np.flatnonzero(size > WORD):
            out += self._expected_long(words[i], weight[i], prob)
        return out

    def _expected_long(self, word: str, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        n = len(word)
        start, end, ids = self.edges(word)
        (before, log_before), (after, log_after) = self.swept(start, end, ids, prob, n), self.swept(n - end, n - start, ids, prob, n)
        before, after = np.log(before) + log_before, np.log(after) + log_after
        out = np.zeros((self.size, len(weight)))
        for lo in range(0, len(ids), EDGES):
            some = slice(lo, lo + EDGES)
            share = np.exp(before[start[some]] + np.log(prob[ids[some]]) + after[n - end[some]] - before[-1]) * weight
            for c in range(len(weight)):
                out[:, c] += np.bincount(ids[some], share[:, c], self.size)
        return out

    def _expected_short(self, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        total, ends, alpha, order, length = self.forward(words, prob)
        share = weight[order] / total[order]
        beta = [np.zeros_like(a) for a in alpha]
        for j in range(len(alpha)):
            beta[j][length[: len(beta[j])] == j] = 1
        ids, many = [], []
        for j in range(len(ends), 0, -1):
            for start, at, piece in ends[j - 1]:
                through = prob[piece] * beta[j][at]
                beta[start][at] += through
                ids.append(piece)
                many.append(alpha[start][at] * through * share[at])
        ids, many = np.concatenate(ids), np.concatenate(many)
        return np.stack([np.bincount(ids, many[:, c], self.size) for c in range(many.shape[1])], 1)


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, word number) of every word, and the different words with their start mark.

    Words are runs of letters and the combining marks behind them, of any length, lower-cased.
    """
    chunks: dict[str, int] = {}  # between white space; only different ones are searched for letters
    held, of_row = [], []
    for t in text.to_pylist():
        found = t.lower().split() if t else []
        held.append(len(found))
        of_row += [chunks.setdefault(w, len(chunks)) for w in found]
    table: dict[str, int] = {}
    size, number = [], []
    for c in chunks:
        found = [c] if c.isalpha() else (_ASCII_LETTERS if c.isascii() else _LETTERS).findall(c)
        size.append(len(found))
        number += [table.setdefault(w, len(table)) for w in found]
    of_row, size, number = np.array(of_row, np.int64), np.array(size, np.int64), np.array(number, np.int64)
    row = np.repeat(np.arange(len(held)), held)
    many = size[of_row]
    first = np.cumsum(size) - size
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(row, many), number[np.repeat(first[of_row], many) + within], [START + w for w in table]


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = 1) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities (pieces + 1, languages)) from the columns text and lang of ``docs``.

    Rows with a null lang are left out; null or letterless texts add nothing. The driver gathers one row per piece and language:
    the vocabulary is fixed, and languages are those that label texts. With nothing to learn from there are no languages.
    """
    pieces = pieces_of(vocabulary)
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    languages: list[str] = []
    prob = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, languages, prob))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known, p = sent.value
            finder, sums = Pieces(names), {}
            for batch in slices(batches, limit=SLICE):
                row, number, words = words_of(batch.column("text"))
                if not words:
                    continue
                lang = batch.column("lang").dictionary_encode()
                langs = lang.dictionary.to_pylist()
                at = lang.indices.to_numpy(zero_copy_only=False)[row]
                weight = np.bincount(number * len(langs) + at, minlength=len(words) * len(langs)).reshape(-1, len(langs)).astype(float)
                own = p[:, [known.index(x) for x in langs]] if known else p
                for x, c in zip(langs, finder.expected(words, weight, own).T):
                    sums[x] = sums.get(x, 0) + c
            out = {"lang": pa.string(), "piece": pa.int32(), "n": pa.float64()}
            for x, c in sums.items():
                some = np.flatnonzero(c)
                yield rows(out, lang=[x] * len(some), piece=some, n=c[some])

        found = docs.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        languages = sorted(found["lang"].unique())
        counts = np.zeros((len(pieces) + 1, len(languages)))
        counts[found["piece"].to_numpy(int), np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object)) if languages else []] = found["n"]
        if not languages:
            return [], pieces, counts
        prob = np.maximum((counts + 1e-3) / (counts + 1e-3).sum(0), FLOOR)
        prob = prob / prob.sum(0)
    return languages, pieces, prob


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """All columns of ``docs`` (any, with a column text) and lang_pred, score; columns of these names are replaced.

    The score is the posterior of the best language under equal priors; ties go to the first in code-point order. A null text, one
    without a letter, or a model without languages gives "und" and 0.0.
    """
    languages, pieces, prob = model
    sent = docs.sparkSession.sparkContext.broadcast((languages, pieces, prob))
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("__text"))
    schema = docs.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, p = sent.value
        finder = Pieces(vocabulary)
        for batch in slices(batches, "__text", limit=SLICE):
            row, number, words = words_of(batch.column("__text"))
            n = batch.num_rows
            best, score, letters = np.zeros(n, np.int64), np.zeros(n), np.bincount(row, minlength=n) > 0
            if words and names:
                log = finder.log_sums(words, p)
                sums = np.stack([np.bincount(row, log[number, c], n) for c in range(len(names))], 1)
                best = sums.argmax(1)
                score = np.where(letters, 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1), 0.0)
            lang = [names[b] if k and names else UNKNOWN for b, k in zip(best, letters)]
            cols = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score)], names=[*others, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
