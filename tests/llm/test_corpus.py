"""Operators of papertrellis.llm against brute force, and every one over awkward tables."""

import collections
import hashlib
import math
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from papertrellis.llm import components, decontam, grades, langid, linededup, maxent, mixing, neighbours, simhash, tokenfile, webtext
from papertrellis.llm.tables import new_folder

WHITE = " \t\n\r\x0b\x0c"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def corpus(n=120, seed=3):
    """Rows with copies, near copies, shared lines, nulls, blanks, repeated rows and one long text."""
    rng = np.random.default_rng(seed)
    shared = "This passage stands in many documents of the corpus, word for word."
    rows = []
    for i in range(n):
        text = sentence(rng, int(rng.integers(5, 80)))
        if i % 7 == 0:
            text += "\n  " + shared.upper() + " \n" + sentence(rng, 12)
        if i % 10 == 3:
            text = rows[i - 1][1]
        if i % 10 == 6 and rows[i - 1][1]:
            text = rows[i - 1][1] + " x"
        rows.append((i, text, ["en", "fr", None][i % 3], f"src{min(i % 6, 2)}" if i % 11 else None, len(text or "")))
    rows += [(n, None, "en", "src1", None), (n + 1, "", "en", "src1", 0), (n + 2, " \n\t ", None, None, 4), (None, "alpha beta", "fr", "src0", 3), rows[5], rows[5]]
    rows += [(n + 3, "§ 12 % — 34", "en", "src2", 11), (n + 4, sentence(rng, 20_000), "en", "src0", 1), (n + 5, "<b>Ünïcödé 猫 ﬀ</b>  double  space \n ", "fr", "src1", 9), (n + 6, "z" * 5000, "en", None, 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS)


@pytest.fixture(scope="module")
def wide(docs):
    """The same with further columns, named as the operators name their own."""
    own = "id fp h size row part key n keys hits score lang_pred tails expected_grade n_words taken copies ids block word kind token c start rank prefix whole plan_source".split()
    return docs.select("*", *[F.lit(7).alias(c) for c in own])


def empty(df):
    return df.where("doc_id = -1")


def links_of(fps, radius=2):
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                part[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, wide):
    rows = docs.select("doc_id", "text").collect()
    fp = {r: plain_fingerprint(r["text"]) for r in rows}
    root = links_of(sorted(set(fp.values())))
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[root[fp[r]]] = min(least.get(root[fp[r]], r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), fp[r], least.get(root[fp[r]])) for r in rows)
    for table, segments in ((wide, 4), (docs, 2), (docs, 8)):
        got = simhash.near_duplicates(table, segments=segments).collect()
        assert sorted((str(r["id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_links_connect_all_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(12)}
    signed = spark.createDataFrame([(int(np.array(f, np.uint64).view(np.int64)),) for f in fps], "fp long")
    for segments, tile in ((4, 1024), (8, 1024), (4, 2)):
        edges = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.links(signed, 2, segments, tile).collect()]
        assert all((a ^ b).bit_count() <= 2 and a != b for a, b in edges)
        part = {f: f for f in fps}

        def root(x, part=part):
            while part[x] != x:
                x = part[x]
            return x

        for a, b in edges:
            part[max(root(a), root(b))] = min(root(a), root(b))
        assert {f: root(f) for f in fps} == links_of(fps)


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r["fp"]: r["root"] for r in components.smallest_reachable(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_maxent_counts_and_normalisation(docs, wide):
    teach = docs.where("coalesce(pmod(doc_id, 4), 0) <> 0")
    model, counts = maxent.learn(teach, rounds=4)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = collections.Counter(w for r in teach.collect() for w in tokens(r["text"]))
    total, v = sum(c.values()), len(c)
    got = maxent.score(wide.withColumn("base_score", F.lit("x")), model, counts)
    assert got.count() == docs.count() and got.columns[-5:] == ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    for r in docs.collect():
        t, g = tokens(r["text"]), by[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(w in c for w in t), total)
        assert g["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert g["score"] < 0
    # the probabilities of all words and one unknown word per class sum to one after any history
    log = maxent.class_logs(np.array([0, 65, 20479]), model.weights)
    kind = np.array([maxent.Reader(model.head).head_class[i] for i in range(len(model.head))])
    inside = np.where(kind < maxent.SINGLE, 1.0, (model.counts - model.discount[kind]) / np.maximum(model.class_tokens[kind], 1))
    mass = np.bincount(kind, inside, maxent.CLASSES) + np.where(np.arange(64) >= maxent.SINGLE, 10 ** model.unknown_log(), 0)
    mass[(model.class_words == 0)] = 1  # an empty class has its unknown word alone
    assert mass == pytest.approx(np.ones(64)) and np.exp(log).sum(1) == pytest.approx(np.ones(3))
    assert got.agg(F.sum("score")).first()[0] > got.agg(F.sum("base_score")).first()[0]


def test_maxent_tail_words_give_the_same(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 200) if k < 900)) for i in range(40)], "doc_id long, text string")
    model, counts = maxent.learn(table.where("doc_id < 30"), rounds=2)
    whole = {r["doc_id"]: r for r in maxent.score(table, model, counts).collect()}
    # the same with a smaller head: what it leaves out is joined
    few = maxent.Model(model.head[:260], model.counts[:260], model.total, model.distinct, model.class_tokens, model.class_words, model.discount, model.weights)
    assert len(model.head) > 300
    for r in maxent.score(table, few, counts).collect():
        want = whole[r["doc_id"]]
        assert r["n_known"] == want["n_known"] and r["score"] == pytest.approx(want["score"], rel=1e-9) and r["base_score"] == pytest.approx(want["base_score"], rel=1e-9)


def test_maxent_without_texts(docs):
    model, counts = maxent.learn(empty(docs))
    got = maxent.score(docs.select("doc_id", "text"), model, counts).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert maxent.score(empty(docs), model, counts).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "bab"]
    found, prob = langid.Pieces(pieces), np.linspace(0.01, 0.4, 16).reshape(8, 2)
    number = {p: i + 1 for i, p in enumerate(pieces)}

    def plain(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            piece = number.get(word[:k], 0 if k == 1 else None)
            if piece is not None:
                out += prob[piece] * plain(word[k:])
        return out

    words = ["▁abab", "▁b", "▁", "▁babxab", "▁猫"]
    assert found.forward(words, prob)[0] == pytest.approx(np.array([plain(w) for w in words]))
    # expected counts: the letters of every word are covered once
    e = found.expected(words, np.ones((5, 1)), prob[:, :1])[:, 0]
    assert sum(n * (len(pieces[i - 1]) if i else 1) for i, n in enumerate(e)) == pytest.approx(sum(map(len, words)))


def test_long_words_are_summed_whole():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "bab"]
    found, prob = langid.Pieces(pieces), np.array([[1e-7, 3e-7]] + [[0.01 * i, 1e-4 / i] for i in range(1, 8)])
    number = {p: i + 1 for i, p in enumerate(pieces)}

    def plain(word, column):
        """Exact fractions: no scale is needed."""
        sums = [Fraction(1)]
        for j in range(1, len(word) + 1):
            ids = [(k, number.get(word[j - k:j], 0 if k == 1 else None)) for k in range(1, min(j, 3) + 1)]
            sums.append(sum(sums[j - k] * Fraction(prob[i, column]) for k, i in ids if i is not None))
        return sums[-1]

    def log(x):
        return math.log(x.numerator) - math.log(x.denominator)

    words = ["▁" + "abbaxb" * 40, "▁a", "▁" + "z" * 300, "▁" + "ab" * 20, "▁" + "ab" * 19 + "a"]
    assert found.log_sums(words, prob) == pytest.approx(np.array([[log(plain(w, c)) for c in range(2)] for w in words]), rel=1e-12)
    # counts by the long form equal those by the short one, and cover every letter once
    short = ["▁abab", "▁babxab", "▁猫"]
    for w in short:
        assert found._expected_long(w, np.array([1.0, 2.0]), prob) == pytest.approx(found._expected_short([w], np.array([[1.0, 2.0]]), prob))
    e = found.expected(words, np.ones((5, 1)), prob[:, :1])[:, 0]
    assert sum(n * (len(pieces[i - 1]) if i else 1) for i, n in enumerate(e)) == pytest.approx(sum(map(len, words)))


def test_words_keep_marks_and_length():
    row, number, words = langid.words_of(pa.array(["Ko\u0308ln, x2y " + "q" * 500, None, "12 \u0301 ²", "हिन्दी"]))
    assert [(r, words[i]) for r, i in zip(row, number)] == [(0, "▁ko\u0308ln"), (0, "▁x"), (0, "▁y"), (0, "▁" + "q" * 500), (3, "▁हिन्दी")]


def test_language_id(spark, docs, wide):
    rng = np.random.default_rng(0)
    kinds = {"aa": "ka ta na ma la".split(), "bb": "öst gru blüm schro".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[k], 3)) for _ in range(30)), k) for i in range(60) for k in kinds]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(table.where("doc_id % 3 <> 1"))
    got = langid.identify(table.where("doc_id % 3 = 1"), model).collect()
    assert model[0] == ["aa", "bb"] and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    odd = langid.identify(wide, model)
    assert odd.count() == docs.count()
    und = {r["doc_id"] for r in odd.where("lang_pred = 'und'").collect()}
    assert und == {r["doc_id"] for r in docs.collect() if not any(map(str.isalpha, r["text"] or ""))}
    assert langid.learn(empty(docs))[0] == [] and langid.learn(docs.where("lang is null"))[0] == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(empty(docs))).collect()} == {"und"}
    assert langid.identify(empty(docs), model).count() == 0


def plain_lines(rows):
    key = lambda line: line.strip(WHITE).translate(LOW)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    heavy = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if i is None or heavy.get(key(line), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def cleaned(store, table):
    return sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in store.cleaned(table).collect())


def test_line_dedup(docs, wide, monkeypatch):
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    store = linededup.LineStore().insert(docs)
    want = plain_lines(pairs(docs))
    assert sum(x[2] for x in want) > 10
    assert cleaned(store, wide) == want
    assert cleaned(store.insert(docs), docs) == want  # again adds nothing
    one, two = docs.where("coalesce(doc_id, 0) % 2 = 0"), docs.where("doc_id % 2 = 1")
    both = linededup.LineStore().insert(one).insert(two)
    assert cleaned(both, docs) == want
    back = both.delete(two.select("doc_id"))
    assert cleaned(back, one) == plain_lines(pairs(one)) and sorted(back.repeated().collect()) == sorted(linededup.LineStore().insert(one).repeated().collect())
    through = sorted(store.repeated().collect())
    assert 0 < len(through) < store.refs.count()
    monkeypatch.setattr(linededup, "SENT_BYTES", -1)
    assert cleaned(store, docs) == want and sorted(store.repeated().collect()) == through
    monkeypatch.setattr(linededup, "PART_REFS", 3)
    assert cleaned(linededup.LineStore().insert(empty(docs)), docs)[0][2] == 0 and store.cleaned(empty(docs)).count() == 0


def test_filters_grow_with_what_is_inserted(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)  # shards are laid out for two keys each
    line = lambda i: f"line {i} of the repeated ones, long enough to count"
    texts = [(d, "\n".join([line(i) for i in range(4 if d < 8 else 30)] + [f"own line of document {d}, which nothing else holds"])) for d in range(16)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, two = docs.where("doc_id < 8"), docs.where("doc_id >= 8")
    small = linededup.LineStore().insert(one)
    grown = small.insert(two)
    assert (small.held, grown.held) == (4, 30) and grown.shards > small.shards
    assert cleaned(grown, docs) == plain_lines(texts)
    monkeypatch.setattr(linededup, "SENT_BYTES", -1)
    monkeypatch.setattr(linededup, "PART_REFS", 3)
    assert cleaned(grown, docs) == plain_lines(texts) and grown.repeated().count() < grown.refs.count()
    back = grown.delete(two.select("doc_id"))
    assert back.held == 4 and cleaned(back, one) == plain_lines(texts[:8])


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    f = linededup.Cuckoo(1024)
    f.insert(keys)
    assert not f.full and f.maybe(keys).all()
    assert f.maybe(rng.integers(0, 256, (5000, 16), dtype=np.uint8)).mean() < 0.01
    f.delete(keys[:1500])
    assert f.maybe(keys[1500:]).all() and f.maybe(keys[:1500]).mean() < 0.02
    again = linededup.Cuckoo.of(f.to_bytes())
    assert (again.table == f.table).all()
    again.insert(rng.integers(0, 256, (5000, 16), dtype=np.uint8))
    assert again.full and again.maybe(keys).all()


def test_token_file(spark, docs, wide):
    path = new_folder(spark, "test-tokens")
    tokenfile.write(wide, path)
    tok = tokenfile.Tokenizer.from_file(tokenfile.VOCABULARY)
    rows = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["id"], list(r["ids"])) for r in got] == rows
    starts = np.cumsum([0, *(len(x) for _, x in rows)])[:-1].tolist()
    brief = sorted(tokenfile.digest(spark, path).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in brief] == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), s in zip(rows, starts)]
    none = new_folder(spark, "test-tokens")
    tokenfile.write(empty(docs), none)
    assert tokenfile.digest(spark, none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a  b", "a \n b", "a\n \nb", " lead", "trail ", "trail  ", "x\n y", "x \ny", "\n\n", "it's  we'll \t tab", "no\xa0break x", "é 猫   wide"])
def test_chunks_encode_like_whole_texts(text):
    encoder = tokenfile.Encoder(tokenfile.VOCABULARY)
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [4, 5, 16])
def test_huffman_round_trip(limit):
    rng = np.random.default_rng(limit)
    counts = np.zeros(40, np.int64)
    counts[rng.choice(40, 15, replace=False)] = 2 ** np.arange(15)
    lengths = tokenfile.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) == 1
    if limit == 16:  # no limit bites: the plain Huffman cost
        heap = sorted(int(c) for c in counts if c)
        cost = 0
        while len(heap) > 1:
            a, b, *heap = sorted(heap)
            cost += a + b
            heap.append(a + b)
        assert int((counts * lengths).sum()) == cost
    codes, symbol, size, width = tokenfile.canonical(lengths)
    documents = [(i or None, rng.choice(np.flatnonzero(counts), n).astype(np.uint32)) for i, n in enumerate((0, 1, 255, 256, 257, 5000, 0))]
    packed = [(i, len(x), m.tobytes() + d.tobytes()) for (i, x), (m, d) in zip(documents, tokenfile.pack([x for _, x in documents], codes, lengths))]
    back = tokenfile.from_block(tokenfile.to_block(packed), (symbol, size, width))
    assert [(i, x.tolist()) for i, x in back] == [(i, x.tolist()) for i, x in documents]


def test_grades(spark, docs, wide):
    rng = np.random.default_rng(2)
    kinds = ["vile nasty".split(), [], "lovely fine".split()]
    rows = [(i, sentence(rng, 30) + " " + " ".join(kinds[i % 3] * 2) + (" | | ##" if i % 3 == 1 else ""), i % 3) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = grades.fit(table.where("doc_id < 450"), table.select("doc_id", "grade"))
    got = grades.grade(table.where("doc_id >= 450"), model).toPandas()
    assert (np.diff(model.thresholds) > 0).all()
    assert (got["expected_grade"].round() == got["grade"]).mean() > 0.95
    tails = np.array(got["tails"].tolist())
    assert (tails[:, 0] >= tails[:, 1]).all() and tails.sum(1) == pytest.approx(got["expected_grade"].to_numpy())
    assert grades.grade(table, model).where(grades.selected(1)).count() == pytest.approx(400, abs=10)
    assert grades.grade(wide, model).count() == docs.count() and grades.grade(empty(docs), model).count() == 0
    none = grades.fit(docs, table.where("doc_id < 0").select("doc_id", "grade"))
    assert grades.grade(docs, none).select("expected_grade").distinct().count() == 1
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 0), (None, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["grade"]) for r in grades.rated(labels).collect()} == {(1, 1), (2, 0), (3, 2)}


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(250 / 3), None: pytest.approx(500 / 3)}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}
    assert mixing.targets([("z", 10), ("é", 1000), ("b", 10)]) == {"b": 20.0, "z": pytest.approx(20), "é": pytest.approx(1490)}


def test_mixing(docs, wide):
    got = mixing.mix(wide).toPandas()
    texts = docs.toPandas()
    assert len(got) == len(texts) and (got["taken"] == got["size"] * got["copies"]).all() and got["copies"].max() <= 2
    size = texts["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert sorted(got["size"]) == sorted(size)
    per = got.fillna({"source": "~"}).groupby("source").agg(n=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    want = mixing.targets([(None if s == "~" else s, int(n)) for s, n in per["n"].items()])
    for s, r in per.iterrows():
        assert r["target"] == pytest.approx(want[None if s == "~" else s])
        assert abs(r["taken"] - r["target"]) <= 3 * r["most"]  # repeated rows share a hash
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda df: sorted(map(str, df[["id", "source", "taken", "copies"]].itertuples(index=False)))
    assert key(got) == key(again)
    rows = mixing.mixed(wide)
    assert rows.columns == wide.columns and rows.count() == got["copies"].sum()
    assert mixing.mix(empty(docs)).count() == 0 and mixing.mixed(empty(docs)).count() == 0


def test_mixing_comes_near_for_many_documents(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 9)), f"s{i % 3}", 0, 0) for i in range(2000)]
    per = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, h int, size int")).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["t"] - r["k"]) <= 8 for r in per)


BENCH = [(1, "Alpha beta, gamma; delta EPSILON zeta eta theta iota kappa lambda mu"), (2, "unique tokens"), (10, "é"), (3, None), (4, " . "), (None, "alpha"), (5, "Alpha beta, gamma; delta EPSILON zeta eta theta iota kappa lambda mu")]


def plain_scan(rows, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in bench:
        w = word.findall((text or "").translate(LOW))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w and item is not None else 0):
            windows[tuple(w[a:a + k])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, items = word.findall((text or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if found := windows.get(tuple(w[a:a + k])):
                    hit |= set(range(a, a + k))
                    items |= found
        out.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination(spark, docs, wide):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    windows = decontam.load(bench)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(900, "see: ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (901, "é unique-tokens é"), (902, "alpha beta gamma delta epsilon zeta eta theta iota"), (903, "unique")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("x")).withColumn("hits", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.scan(table, windows).collect())
    assert got == plain_scan(rows, BENCH) and sum(x[5] for x in got) == 2
    cut = {r["doc_id"]: r["text"] for r in decontam.without_spans(table, windows).collect()}
    assert cut[900] == "see:  nu" and cut[901] == " - " or cut[901].strip() in ("", "-")
    assert cut[903] == "unique" and cut[902] == rows[-2][1]
    clean = decontam.clean_documents(wide, windows)
    assert clean.columns == wide.columns and clean.where("text is null").count() == 1
    nothing = decontam.load(bench.where("item_id < 0"))
    assert decontam.scan(docs, nothing).where("contaminated").count() == 0 and decontam.scan(empty(docs), windows).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[100:110] = v[50]  # ties
    v[111] = v[50] * 3
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [float("inf")] + [1.0] * 11), (905, []), (None, [1.0] * 12), (950, [1.0, 2.0]), (951, [2.0, 1.0]), rows[7]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("dim", F.lit(1))
    usable = neighbours.usable(table)
    assert {r["id"] for r in usable.collect()} == {*range(300), 950, 951}
    got = collections.defaultdict(list)
    for r in neighbours.nearest(usable, usable.where("id % 50 = 0"), query_rows=3, block_rows=17).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert [len(got[q]) for q in range(0, 300, 50)] == [5] * 6 and [i for i, _ in got[950]] == [951]
    x = v.astype(float)
    for q in range(0, 300, 50):
        c = neighbours.cosines(x, np.repeat(x[q:q + 1], 300, 0))
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-c[i], i))[:5]
        assert [i for i, _ in got[q]] == want and [s for _, s in got[q]] == pytest.approx(c[want])
    assert [i for i, _ in got[50]][:1] == [min([*range(100, 110), 111], key=lambda i: (-neighbours.cosines(x[i:i + 1], x[50:51])[0], i))]
    assert neighbours.nearest(usable.where("id < 0"), usable.where("id < 0")).count() == 0


PAGE = """<html><head><title>T</title><script>if (a < b) {"</p>"}</script></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav>
<div class="cookie-notice">We use cookies on this site to improve things</div><article><h1>The&nbsp;head</h1><p>One <b>bold</b> word &amp; more
text<br>next line<p>Second paragraph<!-- no > --> goes on<div class=ad>Buy now</div><ul><li>item one<li>item two</ul>
<section class="comments"><p>I disagree with all of it and say so here</p></section></article><footer>&copy; 2020</footer></body></html>"""


def test_web_text(spark):
    tree = webtext.grow(*webtext.labelled())
    rows, marks = webtext.labelled()
    assert [webtext.is_main(tree, r) for r in rows] == marks.astype(bool).tolist()
    assert webtext.main_text(PAGE, tree) == "The head One bold word & more text next line Second paragraph goes on item one item two"
    hostile = ["", "<", "<a", "<a " + "x" * 1_000_000, "<p>" * 20_000 + "deep", "<!--", "<script>never closed", "a &#xZZ; b &nosuch;", "</p></div>", "<p title='>'>kept</p>", "<div><p>" + "word " * 50]
    for page in hostile:
        assert isinstance(webtext.main_text(page, tree), str)
    table = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = webtext.extract(table).orderBy("page_id").collect()
    assert [len(r["main_text"]) > 0 for r in got] == [True, True, False, False] and webtext.extract(table.where("page_id < 0")).count() == 0


def test_web_text_headers_and_deep_nesting():
    tree = webtext.grow(*webtext.labelled())
    long = "word " * 40
    assert webtext.main_text(f"<header>Site name</header><article><header><h1>The title</h1></header><p>{long}</p></article>", tree) == "The title " + long.strip()
    assert webtext.main_text(f'<div class="site-header">Name</div><div class="post-header"><p>{long}</p></div>', tree) == long.strip()
    began = time.process_time()
    webtext.blocks("<b>" * 200_000 + "</i>" * 200_000 + "text" + "</b>" * 200_000)
    assert time.process_time() - began < 10


def test_cosines_of_very_large_and_very_small_vectors():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 50, 8))
    plain = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    assert (neighbours.cosines(a, b) == plain).all()
    for x, y in ((1e200, 1e200), (1e-200, 1e-200), (1e300, 1e-300), (5e-324, 1.0)):
        assert neighbours.cosines(np.array([[x, x]]), np.array([[y, 2 * y]]))[0] == pytest.approx(3 / np.sqrt(10))


def test_web_text_where_names_tell_nothing():
    tree = webtext.grow(*webtext.labelled())
    split = set()

    def walk(node):
        if len(node) > 1:
            split.add(webtext.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert {"words", "links", "links_before", "links_after"} <= split
    long, linked = "word " * 40, "<a href=x>some place</a> " * 30
    assert webtext.main_text(f"<p>{linked}</p><p>{linked}</p>", tree) == ""
    assert webtext.main_text("<p>A page of one short sentence.</p>", tree) == "A page of one short sentence."
    page = f'<div class="a1"><a>Home</a> <a>News</a> <a>Sport</a></div><div>{long}</div><div>Short line here.</div><div>{long}</div><div class="c3"><a>Imprint</a> <a>Contact</a></div>'
    assert webtext.main_text(page, tree) == f"{long.strip()} Short line here. {long.strip()}"
