"""License scans, conversation tries and manifests against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrellis.llm import licenses, merkle, numbering, turntrie

from .test_corpus import COLUMNS, LOW, corpus, sentence

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- license scans ---


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain_scan(text):
    words = plain_words(text)
    base, labels, best = [], set(), 0.0
    for k, (label, said) in enumerate(licenses.BASE + licenses.NOTICES):
        phrase = said.split()
        size = len(phrase)
        votes = {}
        for i in range(len(words) - 2):
            for j in range(size - 2):
                if words[i:i + 3] == phrase[j:j + 3]:
                    votes.setdefault(i - j, set()).add(j)
        clusters = []
        for d in sorted(votes):
            if not clusters or d - clusters[-1][-1] > licenses.BAND:
                clusters.append([])
            clusters[-1].append(d)
        for cluster in clusters:
            held = {j + x for d in cluster for j in votes[d] for x in range(3)}
            span = max(d + max(votes[d]) + 3 for d in cluster) - min(d + min(votes[d]) for d in cluster)
            whole = [d for d in cluster if len(votes[d]) == size - 2]
            best = max(best, len(held) / size)
            if k < len(licenses.BASE):
                base += [(d, label) for d in whole]
            if whole or len(held) / size >= licenses.LEAST_SHARE and span <= licenses.MOST_LENGTHS * size:
                labels.add(label)
    at = [d for d, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best


def license_texts():
    rng = np.random.default_rng(5)
    mit = licenses.NOTICES[0][1].split()
    cut = [w for i, w in enumerate(mit) if i % 13]
    padded = [x for i, w in enumerate(mit) for x in ([w, "new"] if i % 11 == 5 else [w])]
    return [
        None, "", "  \n", "cc by", "CC BY-NC 4.0", "Released under the MIT License. Under the mit  license!", "ünder the mit licenseé under the mité license",
        "Licensed under the Apache License, Version 2.0", " ".join(mit), " ".join(cut), " ".join(padded), " ".join(mit[:12]), " ".join(reversed(mit)), "liKense apache license version 2",
        "gnu general public license " * 40, "of the software " * 300, sentence(rng, 5000) + " cc by nc " + sentence(rng, 5000), "cc by nc by nc by nc", "CC-BY-SA; CC0; creative commons zero v1.0 universal",
        "x\x00under\x7fthe mit\tlicense", "a " * 3 + "all rights reserved no part of this publication may be reproduced in",
    ]


def test_license_scan(spark):
    texts = license_texts()
    table = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[5])] * 2, "doc_id long, text string")
    wide = table.select("*", *[F.lit("own").alias(c) for c in "id row mark n_words template label base size at key score found run i".split()])
    for df in (table, wide.repartition(3)):
        got = [(r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in licenses.scan(df).collect()]
        want = [(r["doc_id"], *plain_scan(r["text"])[:-1], round(plain_scan(r["text"])[-1], 9)) for r in table.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(table.where("doc_id < 0")).count() == 0
    found = {r["id"]: r["labels"] for r in licenses.scan(table).where("id is not null").collect()}
    assert found[8] == found[9] == "mit" and found[11] == found[12] == ""


def test_license_scan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    # the table of the test itself is an existing RDD; nothing above it is
    assert not re.search("Python|Pandas|InArrow", plan)
    with pytest.raises(ValueError):
        licenses.templates(spark, [("x", "too short")], [])


# --- conversations ---


def plain_trie(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            said.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in said.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100 if c < 0 else c - c % 100
        made[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids, out = {}, []
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        below = [sums[k] for k in kids.get(path, [])]
        sums[path] = own + sum(s for s, _ in below), sum(n for _, n in below) or 1
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), sums[path][1], sums[path][0], H(ends)))
    return sorted(out, key=str)


def conversations(seed=4):
    rng = np.random.default_rng(seed)
    openings = [("system", "Be kind."), ("user", "Hello"), (None, None), ("", ""), ("user", "ünï 猫")]
    rows = []
    for c in [*range(0, 60), *range(100, 140), 200, 205, 301, 302, -5, -150, -100, 10**12, 10**12 + 3]:
        for t in range(int(rng.integers(1, 9))):
            role, text = openings[int(rng.integers(0, 5))] if rng.random() < 0.7 else ("user", sentence(rng, 4))
            rows.append((c, t if rng.random() < 0.9 else None, role, text))
    rows += [(150 + k, t, "user", "copy") for k in range(30) for t in range(7)]  # a group of copies
    rows += [(101, t, "user", f"long {t % 3}") for t in range(40, 160)]  # a long one
    rows += [rows[0], rows[0], (None, 1, "user", "of none"), (77, None, None, None), (77, 3, "user", ""), (77, 3, "user", "tie"), (77, 3, "assistant", "tie")]
    return rows


@pytest.mark.parametrize("block,shard,rows", [(1 << 16, 2048, 1 << 15), (5, 7, 40), (1, 16, 90)])
def test_trie(spark, monkeypatch, block, shard, rows):
    monkeypatch.setattr(turntrie, "SHARD", shard)
    monkeypatch.setattr(numbering, "RANGE_ROWS", rows)
    table = conversations() if block > 1 else [r for r in conversations() if r[0] is None or r[0] < 60 and (r[1] or 0) < 9]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in "key place chars depth total base h part at conv".split()])
    got = turntrie.nodes(df, block=block, rows=rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_chars", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(table)


def test_empty_trie(spark):
    assert turntrie.nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    alone = turntrie.nodes(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    assert alone.count() == 0


# --- manifests ---


def told(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, at):
    """[(siblings before, siblings behind)] up to the root."""
    out = []
    for level in levels[:-1]:
        lo = at // 16 * 16
        out.append((level[lo:at], level[at + 1:lo + 16]))
        at //= 16
    return out


def plain_manifest(rows):
    leaves = {}
    for doc_id, text, lang, source, n in rows:
        own = told(doc_id, source, lang, n, text)
        odd = zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 5 == 0
        said = told(doc_id, source, lang, n, text.translate(LOW)) if odd and text is not None else own
        leaves.setdefault(source, []).append(((doc_id is not None, doc_id or 0), own, said, doc_id))
    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(leaves[s])]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, own, said, doc_id) in enumerate(sorted(leaves[s])):
            steps = plain_proof(trees[s], at) + plain_proof(top, k)
            folded = said
            for a, z in steps:
                folded = H("".join(a) + folded + "".join(z))
            root = top[-1][0]
            out.append((doc_id, own, trees[s][-1][0], root, H("".join(x for a, z in steps for x in a + z)), folded, folded == root))
    return sorted(out, key=str)


def tampered(docs):
    odd = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return F.when(odd, merkle.lower_ascii(F.col("text")))


@pytest.mark.parametrize("rows", [1 << 15, 13])
def test_manifest(spark, rows):
    table = corpus() + [(1000 + i, f"Text {i}", "en", f"s{i}", i) for i in range(40)] + [(2000 + i, "Ä B", None, "", None) for i in range(300)] + [(7, "Same", "en", "hot", 1)] * 50
    docs = spark.createDataFrame(table, COLUMNS).select("*", *[F.lit(1).alias(c) for c in "key leaf changed part at tree place total level digest n".split()])
    made = merkle.build(docs, tampered(docs), rows)
    got = sorted((tuple(r) for r in merkle.proofs(made).collect()), key=str)
    want = plain_manifest(table)
    assert got == want and made.root == want[0][3]
    assert {r[6] for r in got} == {True, False}
    for r in merkle.proofs(made, paths=True).limit(40).collect():
        node = r["leaf"]
        for step in r["path"]:
            node = H("".join([*step["others"][:step["place"]], node, *step["others"][step["place"]:]]))
        assert node == r["root"]


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)], COLUMNS)
    assert [tuple(r) for r in merkle.proofs(merkle.build(docs, tampered(docs))).collect()] == plain_manifest([(None,) * 5])
    none = merkle.build(docs.where(F.lit(False)))
    assert none.root is None and merkle.proofs(none).count() == 0


def test_octopus_is_least():
    known = np.arange(5, 40)
    found = {(level, p) for level, places in merkle.missing(known, 300) for p in places.tolist()}
    assert found == {(0, p) for p in [*range(5), *range(40, 48)]} | {(1, p) for p in range(3, 16)} | {(2, 1)}
    assert merkle.missing(np.arange(300), 300) == [] or not any(len(p) for _, p in merkle.missing(np.arange(300), 300))
