"""Registered queries of the corpus operators, over the whole given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrellis.llm import decontam, grades, langid, licenses, linededup, maxent, merkle, mixing, neighbours, simhash, tokenfile, turntrie, webtext
from papertrellis.llm.tables import new_folder, read, written


def _remainder(n: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_maxent(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text").withColumn("held_out", _remainder(10) == 0)
    model = maxent.fit(docs.where("not held_out"))
    return maxent.score(docs.withColumn("taught", ~F.col("held_out")), model, teach_col="taught").drop("taught")


def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").withColumn("held_out", _remainder(3) == 1)
    model = langid.learn(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_linededup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = linededup.LineStore().insert(docs).cleaned(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_tokenfile(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-file")
    tokenfile.write(read(spark, folder, "documents"), path)
    return tokenfile.digest(spark, path).withColumnRenamed("id", "doc_id")


def op6_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Documents rated in labels whose remainder is not 0 teach; p_clean is P(grade >= 1), p_good P(grade >= 2), keep: p_clean >= 0.5."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    ratings = grades.rated(read(spark, folder, "labels")).where(_remainder(5) != 0)
    found = grades.grade(docs, grades.fit(docs, ratings))
    tail = lambda k: F.element_at("tails", k)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "expected_grade", tail(1).alias("p_clean"), tail(2).alias("p_good"), grades.selected(1).alias("keep"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_decontam(spark: SparkSession, folder: str) -> DataFrame:
    windows = decontam.load(read(spark, folder, "benchmark"))
    return decontam.scan(read(spark, folder, "documents").select("doc_id", "text"), windows).drop("text", "hits")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = written(neighbours.usable(read(spark, folder, "embeddings")), "vectors")
    found = neighbours.nearest(vectors, vectors.where(F.col("id") % 50 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_webtext(spark: SparkSession, folder: str) -> DataFrame:
    found = webtext.extract(read(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_turntrie(spark: SparkSession, folder: str) -> DataFrame:
    return turntrie.nodes(read(spark, folder, "conversations")).drop("key", "parent").withColumnRenamed("saved_chars", "saved_tokens")


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("found")


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return merkle.proofs(merkle.build(docs, F.when(_remainder(5) == 0, merkle.lower_ascii(F.col("text")))))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_maxent, op3_langid, op4_linededup, op5_tokenfile, op6_grades, op7_mixing, op8_decontam, op9_neighbours, op10_webtext, op11_turntrie, op12_licenses, op13_manifest)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TEMPLATES = ", ".join(f"({k}, '{label}', '{text}', {base})" for k, (label, text, base) in enumerate(
    [(*x, True) for x in licenses.BASE] + [(*x, False) for x in licenses.NOTICES]))

#: Unsigned crc32 of a short ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), CAST(4294967295 AS BIGINT))"""


def _told(column: str) -> str:
    said = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({said}) || ':' || {said}, '-')"


ORACLES: dict[str, str] = {
    "op4_linededup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM docs),
        keyed AS (SELECT *, {_LOWER.format(f'trim(line, {_BLANKS})')} AS k FROM lines),
        heavy AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT keyed.*, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN heavy ON heavy.k = keyed.k)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY r""",
    "op8_decontam": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        cut AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM cut),
        doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        spot AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT k FROM win) ks WHERE len(w) >= k),
        met AS (SELECT spot.r, spot.i, spot.k, win.item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM spot) spot
                JOIN win ON win.k = spot.k AND win.g = spot.g),
        hit AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM met) z GROUP BY r),
        named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM met) z GROUP BY r)
        SELECT doc.doc_id, len(doc.w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
               sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit ON hit.r = doc.r LEFT JOIN named ON named.r = doc.r""",
    "op11_turntrie": f"""
        WITH said AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body, turn FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (SELECT c, list({{'role': role, 'body': body}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || body)) AS ts,
                 {_CRC.format("CAST(any_value(c) AS VARCHAR)")} % 6 AS h FROM said GROUP BY c),
        made AS (SELECT a.c, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM conv a LEFT JOIN conv b ON b.c = a.c - a.c % 100),
        path AS (SELECT c, len(ts) AS n, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM made) z),
        node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends,
                 CASE WHEN d > 0 THEN length(p[d].body) ELSE 0 END AS chars FROM path GROUP BY p, d),
        kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
        tree AS (SELECT up.p, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((low.n_convs - 1) * low.chars) AS saved
                 FROM (SELECT p, d, unnest(range(0, d + 1)) AS k, n_convs, chars FROM node) low JOIN node up ON up.p = low.p[1:low.k]
                 LEFT JOIN kids ON kids.p = low.p GROUP BY up.p)
        SELECT node.conv_id, node.d AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, tree.n_leaves,
               CAST(tree.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
        FROM node LEFT JOIN kids ON kids.p = node.p JOIN tree ON tree.p = node.p
        LEFT JOIN node above ON node.d > 0 AND above.p = node.p[1:node.d - 1]""",
    "op12_licenses": f"""
        WITH said AS (SELECT t, label, base, string_split(body, ' ') AS w FROM (VALUES {_TEMPLATES}) v(t, label, body, base)),
        run AS (SELECT t, label, base, len(w) AS size, j - 1 AS j, w[j] AS a, w[j + 1] AS b, w[j + 2] AS c
                FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM said) s),
        doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        word AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM doc),
        vote AS (SELECT r, t, label, base, size, j, i - 1 - j AS d
                 FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM word) g JOIN run USING (a, b, c)),
        diag AS (SELECT r, t, label, base, size, d, list(j) AS js, count(*) = any_value(size) - 2 AS whole FROM vote GROUP BY r, t, label, base, size, d),
        gap AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d) > {licenses.BAND} THEN 1 ELSE 0 END AS cut FROM diag),
        part AS (SELECT *, sum(cut) OVER (PARTITION BY r, t ORDER BY d) AS g FROM gap),
        span AS (SELECT r, t, label, base, size, list_distinct(flatten(list(js))) AS js, min(d + list_min(js)) AS lo, max(d + list_max(js)) + 2 AS hi,
                        count(*) FILTER (whole) AS exact, min(d) FILTER (whole) AS a, max(d) FILTER (whole) AS z FROM part GROUP BY r, t, label, base, size, g),
        share AS (SELECT *, len(list_distinct(flatten(list_transform(js, lambda x: [x, x + 1, x + 2])))) / size AS share FROM span),
        fits AS (SELECT *, exact > 0 OR (share >= {licenses.LEAST_SHARE} AND hi - lo + 1 <= {licenses.MOST_LENGTHS} * size) AS fit FROM share),
        per AS (SELECT r, coalesce(sum(exact) FILTER (base), 0) AS n_base, min(a) FILTER (base) AS first_word, max(z) FILTER (base) AS last_word,
                       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND exact > 0) AS base_labels,
                       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (fit) AS labels, max(share) AS score FROM fits GROUP BY r)
        SELECT doc.doc_id, len(doc.w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM doc LEFT JOIN per ON per.r = doc.r""",
    "op13_manifest": f"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree, sha256({" || ".join(map(_told, merkle.FIELDS))}) AS leaf,
                   CASE WHEN {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN
                   sha256({" || ".join(map(_told, merkle.FIELDS[:-1]))} || {_told(_LOWER.format("text"))}) ELSE
                   sha256({" || ".join(map(_told, merkle.FIELDS))}) END AS said FROM documents),
        laid AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM doc),
        low AS (
            SELECT tree, 0 AS level, pos, leaf AS d FROM laid
            UNION ALL
            SELECT tree, level + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) z
            WHERE n > 1 GROUP BY tree, level, pos // 16),
        sub AS (SELECT tree, arg_max(d, level) AS d FROM low GROUP BY tree),
        high AS (
            SELECT 't' AS tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM sub
            UNION ALL
            SELECT tree, level + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM high) z
            WHERE n > 1 GROUP BY tree, level, pos // 16),
        node AS (SELECT * FROM low UNION ALL SELECT * FROM high),
        run AS (SELECT tree, level, pos, coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z,
                count(*) OVER (PARTITION BY tree, level) > 1 AS more FROM node),
        place AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM sub),
        up AS (
            SELECT r, tree, 0 AS level, pos, said AS d, '' AS proof, false AS done FROM laid
            UNION ALL
            SELECT up.r, CASE WHEN run.more THEN up.tree ELSE 't' END, CASE WHEN run.more THEN up.level + 1 ELSE 0 END,
                   CASE WHEN run.more THEN up.pos // 16 ELSE coalesce(place.pos, 0) END, CASE WHEN run.more THEN sha256(run.a || up.d || run.z) ELSE up.d END,
                   CASE WHEN run.more THEN up.proof || run.a || run.z ELSE up.proof END, NOT run.more AND up.tree = 't'
            FROM up JOIN run ON run.tree = up.tree AND run.level = up.level AND run.pos = up.pos LEFT JOIN place ON place.tree = up.tree WHERE NOT done),
        root AS (SELECT arg_max(d, level) AS d FROM high)
        SELECT laid.doc_id, laid.leaf, sub.d AS subroot, root.d AS root, sha256(up.proof) AS proof_sha256, up.d AS folded_root, up.d = root.d AS verified
        FROM laid JOIN up ON up.r = laid.r AND up.done JOIN sub ON sub.tree = laid.tree CROSS JOIN root""",
}
