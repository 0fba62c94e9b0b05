"""op2's word pairs: every word is a history of its own, and the scores are those of plain counts."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from papertrellis.llm import maxent


def words(text):
    return [*(text or "").encode().lower().split(), maxent.END]


def plain_steps(taught, texts, model):
    """Per text, log10 P of each token, from counts in dictionaries; the class softmax and the words' own shares are the model's."""
    reader = maxent.Reader(model.head)
    single = {w: i for i, w in enumerate([maxent.END, *[w for w in model.head if w != maxent.END][: maxent.SINGLE - 1]])}
    named = set(model.head[: maxent.NAMED])
    kind = lambda w: single.get(w, maxent._tail_class(w))
    c, pair, behind, first = (collections.Counter() for _ in range(4))
    for text in taught:
        t = words(text)
        for v, w in zip([maxent.END, *t], t):
            c[w] += 1
            pair[v, w] += 1
            behind[v, kind(w)] += 1
            first[v] += 1
    followers, classes = collections.Counter((v, kind(w)) for v, w in pair), collections.Counter(v for v, _ in behind)
    d, out = maxent.PAIR_DISCOUNT, []
    for text in texts:
        t, steps = words(text), []
        soft = np.exp(maxent.class_logs(reader.read([(text or "").encode()])[4], model.weights))
        for i, (v, w) in enumerate(zip([maxent.END, *t], t)):
            k = kind(w)
            p, q = soft[i, k], 1.0 if k < maxent.SINGLE else 10 ** model.unknown_log()[k]
            if k >= maxent.SINGLE and c[w]:
                q = (c[w] - model.discount[k]) / model.class_tokens[k]
            if v not in named and first[v]:
                p = (max(behind[v, k] - d, 0) + d * classes[v] * p) / first[v]
            if behind[v, k]:
                q = (max(pair[v, w] - d, 0) + d * followers[v, k] * q) / behind[v, k]
            steps.append(np.log10(p) + np.log10(q))
        out.append(steps)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(k)}x" for k in rng.zipf(1.25, 900) if k < 3000) for _ in range(90)]
    texts += [None, "", " \n", "Neverseen words HERE w1x", "w2x", texts[3], texts[3], " ".join(["w5x w2900x"] * 4000)]
    return spark.createDataFrame([(i, t, i % 9 == 4) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(5, "doc_id")


def test_scores_are_those_of_plain_pair_counts(table):
    taught = table.where("not held_out")
    model, counts = maxent.learn(taught, rounds=2)
    assert model.distinct > 2 * maxent.NAMED and maxent.shards(model.total) > 2
    got = {r["doc_id"]: r["score"] for r in maxent.score(table, model, counts).collect()}
    every = table.orderBy("doc_id").collect()
    want = [sum(x) for x in plain_steps([r["text"] for r in every if not r["held_out"]], [r["text"] for r in every], model)]
    assert [got[r["doc_id"]] for r in every] == pytest.approx(want, rel=1e-9)


def test_rare_words_are_told_apart_as_histories(spark):
    """Histories and words beyond the named ones, of equal counts and equal classes, differ by their pairs alone."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(300)]
    texts = [" ".join(rng.permutation(common)) for _ in range(12)] + ["rare1qq then1zz " * 5, "rare2qq then2zz " * 5]
    model, counts = maxent.learn(spark.createDataFrame([(t,) for t in texts], "text string"), rounds=2)
    asked = spark.createDataFrame([(1, "rare1qq then1zz"), (2, "rare1qq then2zz"), (3, "rare2qq then2zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in maxent.score(asked, model, counts).collect()}
    assert got[1] > got[2] + 0.5 and got[3] > got[2] + 0.5


def test_probabilities_sum_to_one_behind_a_rare_word(spark):
    """All words behind one history beyond the named ones, and one unknown word per class."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{int(k)}" for k in rng.integers(0, 700, 400)) for _ in range(8)]
    model, counts = maxent.learn(spark.createDataFrame([(t,) for t in texts], "text string"), rounds=2)
    history = model.head[400].decode()
    unknown = {maxent._tail_class(f"u{i}".encode()): f"u{i}" for i in range(2000)}
    assert len(unknown) == maxent.CLASSES - maxent.SINGLE
    asked = [history, *[f"{history} {w}" for w in [*sorted({w for t in texts for w in t.split()}), *unknown.values()]]]
    got = maxent.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, counts).orderBy("doc_id").collect()
    steps = plain_steps(texts, asked, model)
    assert [r["score"] for r in got] == pytest.approx([sum(x) for x in steps], rel=1e-9)
    assert sum(10 ** x[1] for x in steps) == pytest.approx(1.0, rel=1e-9)
