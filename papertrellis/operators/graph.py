"""Bounded typed graph over the relation arrays.

Nodes are ``table:id`` texts. A node's own edges come from its row, sorted and
cut inside the row; hops are joins of a small frontier (at most the entity
budget per query) with the tables; the final best-first walk runs per query on
that bounded subgraph.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import isclose

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papertrellis.functions.text import id_array
from papertrellis.operators.scores import METADATA_TABLES, namespaced
from papertrellis.schemas import with_optional
from papertrellis.session import broadcast_if_small, cut_lineage

# Tables in the order a hop visits them.
TABLE_ORDER = ("university", "faculty", "discipline", "field", "journal", "academic", "research_paper")

# Relation, array column, target table; authorship always points from academic to paper.
ACADEMIC_RELATIONS = (
    ("AUTHORED", "research_paper_ids", "research_paper"),
    ("AFFILIATED_WITH", "university_ids", "university"),
    ("ACADEMIC_IN_DISCIPLINE", "discipline_ids", "discipline"),
    ("EXPERTISE_IN_FIELD", "field_ids", "field"),
)
PAPER_RELATIONS = (
    ("AUTHORED", "academic_ids", "academic"),
    ("CITES", "outgoing_citations", "research_paper"),
    ("PAPER_AT_UNIVERSITY", "university_ids", "university"),
    ("PAPER_IN_FACULTY", "faculty_ids", "faculty"),
    ("PUBLISHED_IN", "journal_id", "journal"),
)
RELATIONS = (
    "AUTHORED", "CITES", "AFFILIATED_WITH", "ACADEMIC_IN_DISCIPLINE", "EXPERTISE_IN_FIELD",
    "PAPER_AT_UNIVERSITY", "PAPER_IN_FACULTY", "PUBLISHED_IN",
)

# Authors of a paper that pair in one task.
LIST_AUTHORS = 256

EDGE = "array<struct<edge_id:string,source_id:string,target_id:string,relation:string,other_id:string>>"


@dataclass(frozen=True)
class Budget:
    max_hops: int = 2
    max_entities: int = 50
    max_relationships: int = 100
    max_neighbors: int = 20
    hop_decay: float = 0.80
    min_confidence: float = 0.50
    relations: tuple[str, ...] = RELATIONS

    def __post_init__(self) -> None:
        if self.max_hops < 0 or min(self.max_entities, self.max_relationships, self.max_neighbors) <= 0:
            raise ValueError("graph budgets must be positive")
        if not 0 <= self.hop_decay <= 1 or not 0 <= self.min_confidence <= 1:
            raise ValueError("decay and confidence must be in [0, 1]")


def split_entity_id(c: Column) -> tuple[Column, Column]:
    """Table and raw id; an id without a table has an empty table name."""
    has = c.contains(":")
    return (
        F.when(has, F.substring_index(c, ":", 1)).otherwise(F.lit("")),
        F.when(has, F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)).otherwise(c),
    )


def namespace_values(table: str, c: Column) -> Column:
    return F.transform(id_array(c), lambda x: F.concat(F.lit(f"{table}:"), x))


def own_edges(df: DataFrame, table: str) -> Column:
    """All distinct edges a row of ``academic`` or ``research_paper`` states, sorted by edge id."""
    parts = []
    me = namespaced(table, "id")
    for relation, column, target in ACADEMIC_RELATIONS if table == "academic" else PAPER_RELATIONS:
        if column not in df.columns:
            continue
        values = F.array(F.col(column).cast("string")) if column == "journal_id" else F.col(column)
        flip = table == "research_paper" and relation == "AUTHORED"
        parts.append(_edges(relation, me, namespace_values(target, values), flip))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _edges(relation: str, me: Column, others: Column, flip: bool) -> Column:
    def edge(other: Column) -> Column:
        source, target = (other, me) if flip else (me, other)
        return F.struct(
            F.concat(F.lit(f"{relation}:"), source, F.lit(":"), target).alias("edge_id"),
            source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relation"),
            other.alias("other_id"),
        )

    return F.transform(others, edge)


def _related(relation: str, table: str):
    return lambda x: F.struct(F.lit(relation).alias("relation"), F.lit(table).alias("_table"), x.alias("_t"))


def project_edges(academics: DataFrame | None, papers: DataFrame | None) -> DataFrame:
    """Distinct (edge_id, source_id, target_id, relation) of the eight relation types."""
    once, authored = [], []
    for df, table, relations in ((academics, "academic", ACADEMIC_RELATIONS), (papers, "research_paper", PAPER_RELATIONS)):
        if df is None:
            continue
        rows = df.where(F.col("id").isNotNull())
        lists = []
        for relation, column, target in relations:
            if column not in df.columns:
                continue
            values = F.array(F.col(column).cast("string")) if column == "journal_id" else F.col(column)
            others = F.array_distinct(id_array(values))
            if relation == "AUTHORED":
                pair = rows.select(F.col("id").cast("string").alias("_me"), F.explode(others).alias("_other"))
                names = ("_me", "_other") if table == "academic" else ("_other", "_me")
                authored.append(pair.select(F.col(names[0]).alias("_s"), F.col(names[1]).alias("_t")))
            else:
                lists.append(F.transform(others, _related(relation, target)))
        if lists:
            own = rows.select(F.lit(table).alias("_own"), F.col("id").cast("string").alias("_s"), F.inline(F.concat(*lists)))
            # a table whose ids are unique states no edge twice
            if not rows.groupBy(F.col("id").cast("string")).count().where("count > 1").isEmpty():
                own = own.distinct()
            once.append(own)
    if authored:
        # both sides may state an authorship: two raw ids are compared, texts are built last
        pairs = authored[0] if len(authored) == 1 else authored[0].unionByName(authored[1])
        once.append(pairs.distinct().select(
            F.lit("academic").alias("_own"), "_s", F.lit("AUTHORED").alias("relation"), F.lit("research_paper").alias("_table"), "_t"))
    out = once[0]
    for extra in once[1:]:
        out = out.unionByName(extra)
    source, target = F.concat("_own", F.lit(":"), "_s"), F.concat("_table", F.lit(":"), "_t")
    return out.select(
        F.concat("relation", F.lit(":"), source, F.lit(":"), target).alias("edge_id"),
        source.alias("source_id"), target.alias("target_id"), "relation")


def bounded_relations(df: DataFrame, table: str, maximum: int) -> DataFrame:
    """node_id, its first ``maximum`` edges by edge id, and whether any were cut."""
    if table not in ("academic", "research_paper"):
        none = F.array().cast(EDGE)
        return df.select(namespaced(table, "id").alias("node_id"), none.alias("edges"), F.lit(False).alias("cut"))
    whole = df.select(namespaced(table, "id").alias("node_id"), own_edges(df, table).alias("_all"))
    return whole.select(
        "node_id", F.slice("_all", 1, maximum).alias("edges"), (F.size("_all") > maximum).alias("cut")
    )


@dataclass
class Neighbourhood:
    """Per query: loaded nodes, the edges their rows state, and whether a bound was hit."""

    nodes: DataFrame  # query_id, node_id
    edges: DataFrame  # query_id, edge_id, source_id, target_id, relation
    truncated: DataFrame  # query_id, prefetch_truncated


ADJACENCY = f"node_id string, edges {EDGE}, bucket int"


def write_adjacency(tables: dict[str, DataFrame], path: str, max_neighbors: int = Budget.max_neighbors, buckets: int = 64) -> Adjacency:
    """Every node's first ``max_neighbors`` edges and one more by edge id, clustered by node under a new ``path``. Nodes without edges are there too."""
    out = None
    for table in TABLE_ORDER:
        if table not in tables:
            continue
        df = tables[table].where(F.col("id").isNotNull())
        if table in METADATA_TABLES:
            df = df.where(F.coalesce(F.col("name"), F.lit("")) != "")
        edges = own_edges(df, table) if table in ("academic", "research_paper") else F.array().cast(EDGE)
        part = df.select(namespaced(table, "id").alias("node_id"), F.slice(edges, 1, max_neighbors + 1).alias("edges"))
        out = part if out is None else out.unionByName(part)
    placed = out.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket", F.pmod(F.hash("node_id"), F.lit(8))).sortWithinPartitions("bucket", "node_id").write.partitionBy("bucket").parquet(path)
    return Adjacency(out.sparkSession, path, max_neighbors, buckets)


@dataclass
class Adjacency:
    """Stored adjacency lists; a hop reads the folders of its frontier, and no table of rows."""

    spark: SparkSession
    path: str
    max_neighbors: int = Budget.max_neighbors
    buckets: int = 64

    def load(self, frontier: DataFrame, budget: Budget) -> DataFrame:
        """(query_id, node_id, edges, cut) of the frontier nodes that are stored."""
        if budget.max_neighbors > self.max_neighbors:
            raise ValueError(f"stored lists have {self.max_neighbors} neighbours, the budget asks for {budget.max_neighbors}")
        wanted = frontier.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(self.buckets)).cast("int"))
        some = sorted(r[0] for r in wanted.select("bucket").distinct().collect())
        stored = self.spark.read.schema(ADJACENCY).parquet(self.path).where(F.col("bucket").isin(some) if some else F.lit(False))
        return stored.join(broadcast_if_small(wanted), ["bucket", "node_id"]).select(
            "query_id", "node_id", F.slice("edges", 1, budget.max_neighbors).alias("edges"), (F.size("edges") > budget.max_neighbors).alias("cut"))


def neighbourhood(seeds: DataFrame, tables: dict[str, DataFrame], budget: Budget | None = None, adjacency: Adjacency | None = None) -> Neighbourhood:
    """Hop by hop from the seeds (query_id, node_id), within the entity and relation budgets.

    With ``adjacency`` the hops read stored lists, else the rows of ``tables``, whose edges are then built anew per hop.

    Visits follow one total order - hop, table, node id, edge id - so the
    budgets are running counts: a target already scheduled is dropped, a new
    one keeps its first row, and the first ones that fit are admitted.
    """
    budget = budget or Budget()
    place = F.create_map(*[x for i, t in enumerate(TABLE_ORDER) for x in (F.lit(t), F.lit(i))])
    frontier = cut_lineage(
        seeds.where(split_entity_id(F.col("node_id"))[0].isin("academic", "research_paper"))
        .select("query_id", "node_id").distinct()
    )
    scheduled, loaded, edges, flags = frontier, None, None, None
    for depth in range(budget.max_hops + 1):
        rows = cut_lineage(adjacency.load(frontier, budget) if adjacency else _load(frontier, tables, budget))
        loaded = rows.select("query_id", "node_id") if loaded is None else loaded.unionByName(
            rows.select("query_id", "node_id"))
        stated = rows.select("query_id", F.inline("edges")).drop("other_id")
        edges = stated if edges is None else edges.unionByName(stated)
        cut = rows.where("cut").select("query_id")
        flags = cut if flags is None else flags.unionByName(cut)
        if depth == budget.max_hops:
            break
        table, raw = split_entity_id(F.col("node_id"))
        refs = rows.select(
            "query_id", F.try_element_at(place, table).alias("_t"), raw.alias("_raw"),
            F.posexplode("edges").alias("_pos", "_e"),
        ).select("query_id", F.struct("_t", "_raw", "_pos").alias("_at"), F.col("_e.other_id").alias("node_id"))
        new = (
            refs.join(scheduled, ["query_id", "node_id"], "left_anti")
            .groupBy("query_id", "node_id").agg(F.min("_at").alias("_at"))
        )
        used = scheduled.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        seeds_n = seeds_count(seeds)
        order = Window.partitionBy("query_id").orderBy("_at")
        room = F.least(
            F.lit(budget.max_entities) - F.col("_n"),
            F.lit(budget.max_relationships) - (F.col("_n") - F.col("_s")),
        )
        judged = cut_lineage(
            new.withColumn("_rn", F.row_number().over(order))
            .join(used, "query_id").join(seeds_n, "query_id")
            .select("query_id", "node_id", (F.col("_rn") <= room).alias("ok"))
        )
        flags = flags.unionByName(judged.where("NOT ok").select("query_id"))
        frontier = judged.where("ok").select("query_id", "node_id")
        scheduled = scheduled.unionByName(frontier)
    truncated = flags.distinct().withColumn("prefetch_truncated", F.lit(True))
    return Neighbourhood(loaded.distinct(), edges.distinct(), truncated)


def seeds_count(seeds: DataFrame) -> DataFrame:
    kept = seeds.where(split_entity_id(F.col("node_id"))[0].isin("academic", "research_paper"))
    return kept.groupBy("query_id").agg(F.count_distinct("node_id").alias("_s"))


def _load(frontier: DataFrame, tables: dict[str, DataFrame], budget: Budget) -> DataFrame:
    """Rows of the frontier nodes with their bounded edges; ids without a row disappear.

    The frontier is counted first and broadcast only while small, so a table
    is scanned, not shuffled, per hop.
    """
    wanted = broadcast_if_small(frontier)
    out = None
    for table in TABLE_ORDER:
        if table not in tables:
            continue
        df = tables[table]
        if table in METADATA_TABLES:
            df = df.where(F.coalesce(F.col("name"), F.lit("")) != "")
        rows = df.withColumn("node_id", namespaced(table, "id")).join(wanted, "node_id")
        part = rows.select("query_id", *[c for c in df.columns])
        edges = (
            F.slice(own_edges(part, table), 1, budget.max_neighbors + 1)
            if table in ("academic", "research_paper") else F.array().cast(EDGE)
        )
        part = part.select("query_id", namespaced(table, "id").alias("node_id"), edges.alias("_all")).select(
            "query_id", "node_id", F.slice("_all", 1, budget.max_neighbors).alias("edges"),
            (F.size("_all") > budget.max_neighbors).alias("cut"),
        )
        out = part if out is None else out.unionByName(part)
    return out


PATH_SCHEMA = (
    "query_id string, kind string, target_id string, seed_id string, edge_ids array<string>, "
    "relevance double, evidence_ids array<string>, truncated boolean"
)


def expand(
    seeds: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    budget: Budget | None = None,
    seed_limit: int = 10,
) -> DataFrame:
    """Best-first paths per query over its bounded subgraph.

    seeds: query_id, entity_id, rrf_score, fused_rank, evidence_ids [, seed_limit];
    nodes: query_id, node_id; edges: query_id, edge_id, source_id, target_id,
    relation [, confidence, evidence_ids].
    Gives 'path' rows for reached entities and 'edge' rows for used relations.
    """
    budget = budget or Budget()
    edges = with_optional(edges, confidence="double", evidence_ids="array<string>")
    limit = F.col("seed_limit") if "seed_limit" in seeds.columns else F.lit(seed_limit)
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = (
        seeds.select(
            "query_id", F.lit("seed").alias("kind"), F.col("entity_id").alias("a"), null_s.alias("b"),
            null_s.alias("edge_id"), null_s.alias("relation"), F.col("rrf_score").cast("double").alias("x"),
            F.col("fused_rank").cast("int").alias("n"), limit.cast("int").alias("m"), "evidence_ids",
        )
        .unionByName(
            nodes.select(
                "query_id", F.lit("node").alias("kind"), F.col("node_id").alias("a"), null_s.alias("b"),
                null_s.alias("edge_id"), null_s.alias("relation"), null_d.alias("x"), F.lit(0).alias("n"),
                F.lit(0).alias("m"), F.array().cast("array<string>").alias("evidence_ids"),
            )
        )
        .unionByName(
            edges.select(
                "query_id", F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"),
                "edge_id", "relation", F.coalesce("confidence", F.lit(1.0)).alias("x"), F.lit(0).alias("n"),
                F.lit(0).alias("m"),
                F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
            )
        )
    )
    # a query's rows become one row, so that a task walks many queries for each batch that it is handed
    row = F.struct("kind", "a", "b", "edge_id", "relation", "x", "n", "m", "evidence_ids")
    return rows.groupBy("query_id").agg(F.collect_list(row).alias("rows")).mapInArrow(_walks(budget), PATH_SCHEMA)


#: Queries whose rows a task holds as Python values at a time.
WALKS = 256


def _walks(budget: Budget):
    """Batches of (query_id, rows) to rows of PATH_SCHEMA."""
    names = [part.split()[0] for part in PATH_SCHEMA.split(", ")]
    text, texts = pa.string(), pa.list_(pa.string())
    kinds = [text, text, text, text, texts, pa.float64(), texts, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, WALKS):
                part = batch.slice(begin, WALKS)
                lists = part.column(1)
                *plain, proofs = lists.flatten().flatten()
                proof = iter(_values(proofs.flatten()))
                proofs = [tuple(islice(proof, k)) for k in _values(proofs.value_lengths().fill_null(0))]
                rows = list(zip(*map(_values, plain), proofs))
                out, at = [], 0
                for query_id, many in zip(part.column(0).to_pylist(), lists.value_lengths().to_pylist()):
                    out += _walk(query_id, rows[at:at + many], budget)
                    at += many
                columns = zip(*out) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _values(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _walk(query_id: str, rows: list[tuple], budget: Budget) -> list[tuple]:
    """One query's walk: pop the strongest path, extend it over its neighbours in edge-id order."""
    seeds = sorted((r for r in rows if r[0] == "seed"), key=lambda r: r[6])
    known = {r[1] for r in rows if r[0] == "node"}
    edges: dict[str, tuple] = {}
    for r in rows:
        if r[0] == "edge":
            edges.setdefault(r[3], r)
    adjacency: dict[str, list] = {}
    for edge_id in sorted(edges):
        _, a, b, _, relation, x, _, _, proof = edges[edge_id]
        if relation in budget.relations and x >= budget.min_confidence:
            for node, other in ((a, b), (b, a)):
                adjacency.setdefault(node, []).append((edge_id, other, x, proof))
    allowed = min(seeds[0][7] if seeds else 0, budget.max_entities)
    truncated = len(seeds) > allowed
    best: dict[str, tuple] = {}
    used: set[str] = set()
    queue: list[tuple] = []
    for _, a, _, _, _, x, _, _, proof in seeds[:allowed]:
        known.add(a)
        best[a] = (a, (), x, proof)
        heapq.heappush(queue, (-x, a, a, (), proof))
    while queue:
        minus, seed, here, trail, proof = heapq.heappop(queue)
        if len(trail) >= budget.max_hops:
            continue
        around = adjacency.get(here, [])
        truncated |= len(around) > budget.max_neighbors
        for edge_id, other, confidence, edge_proof in around[: budget.max_neighbors]:
            if edge_id not in used and len(used) >= budget.max_relationships:
                truncated = True
                continue
            if other not in known:
                continue
            relevance = -minus * confidence * budget.hop_decay
            path = (*trail, edge_id)
            old = best.get(other)
            if old is None:
                if len(best) >= budget.max_entities:
                    truncated = True
                    continue
            elif not (relevance > old[2] or (isclose(relevance, old[2]) and path < old[1])):
                continue
            evidence = tuple(dict.fromkeys((*proof, *edge_proof)))
            best[other] = (seed, path, relevance, evidence)
            used.add(edge_id)
            heapq.heappush(queue, (-relevance, seed, other, path, evidence))
    return [
        (query_id, "path", target, seed, list(path), relevance, list(evidence), truncated)
        for target, (seed, path, relevance, evidence) in best.items()
    ] + [(query_id, "edge", edge_id, None, [], 0.0, [], truncated) for edge_id in sorted(used)]


def coauthors(links: DataFrame) -> DataFrame:
    """(academic_id, coauthor_id, n_papers): two authorship hops.

    The pair counts are the result itself. A paper's authors pair once, the
    smaller id first, and the counts are mirrored. Links move once, to the lists
    of their papers; only a paper of more than ``LIST_AUTHORS`` authors has several
    lists, which meet each other over tasks, so that it is not one task's work.
    """
    of = Window.partitionBy("paper_id")
    parts = F.ceil(F.count(F.lit(1)).over(of) / F.lit(LIST_AUTHORS)).cast("int")
    dealt = links.where(F.col("paper_id").isNotNull() & F.col("academic_id").isNotNull()).select("paper_id", "academic_id", parts.alias("_parts"))
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("academic_id"), F.col("_parts")).cast("int"))
    lists = dealt.groupBy("paper_id", "_parts", "_part").agg(F.sort_array(F.collect_list("academic_id")).alias("_a"))
    # an author's repeats stand in one list, side by side, and make no pair with each other
    others = lambda x, i: F.filter(F.slice(F.col("_a"), i + 2, F.size("_a")), lambda y: y > x)
    inside = lists.where(F.size("_a") > 1).select(F.posexplode("_a").alias("_i", "academic_id"), "_a").select(
        "academic_id", F.explode(others(F.col("academic_id"), F.col("_i"))).alias("coauthor_id"))
    several = lists.where("_parts > 1")
    left = several.where("_part < _parts - 1").select("paper_id", F.explode(F.expr("sequence(_part + 1, _parts - 1)")).alias("_part"), F.col("_a").alias("_x"))
    across = left.join(several.select("paper_id", "_part", F.col("_a").alias("_y")), ["paper_id", "_part"])
    across = across.select(F.explode("_x").alias("x"), "_y").select("x", F.explode("_y").alias("y"))
    across = across.select(F.least("x", "y").alias("academic_id"), F.greatest("x", "y").alias("coauthor_id"))
    counted = inside.unionByName(across).groupBy("academic_id", "coauthor_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return counted.select(F.explode(F.array(
        F.struct("academic_id", "coauthor_id", "n_papers"),
        F.struct(F.col("coauthor_id").alias("academic_id"), F.col("academic_id").alias("coauthor_id"), "n_papers"),
    )).alias("_p")).select("_p.*")


def merge_candidates(fused: DataFrame, paths: DataFrame, entities: DataFrame, queries: DataFrame) -> DataFrame:
    """Retrieval and graph results as ranking candidates with their entity columns.

    A seed or a retrieval-only result has graph score 0; evidence is the
    entity's, then the path's.
    """
    p = paths.where(F.col("kind") == "path").select(
        "query_id", F.col("target_id").alias("entity_id"), "edge_ids", "relevance",
        F.col("evidence_ids").alias("_path_evidence"),
    )
    both = fused.select("query_id", "entity_id", "rrf_score").join(p, ["query_id", "entity_id"], "full_outer")
    empty = F.array().cast("array<string>")
    both = both.select(
        "query_id", "entity_id",
        F.coalesce("rrf_score", F.lit(0.0)).alias("retrieval_score"),
        F.when(F.size(F.coalesce("edge_ids", empty)) > 0, F.col("relevance")).otherwise(0.0).alias("graph_score"),
        F.coalesce("edge_ids", empty).alias("path_edge_ids"),
        F.coalesce("_path_evidence", empty).alias("_path_evidence"),
        F.col("rrf_score").isNull().alias("_graph_only"),
    )
    # At most (seed limit + entity budget) rows per query meet the entity table.
    rows = entities.join(broadcast_if_small(both), "entity_id").join(
        queries.select("query_id", "target_kinds"), "query_id"
    ).where(F.array_contains("target_kinds", F.col("kind")))
    is_academic = F.col("entity_id").startswith("academic:")
    return rows.withColumns(
        {
            "evidence_ids": F.array_distinct(F.concat("evidence_ids", "_path_evidence")),
            # academics met only in the graph carry no authority score
            "academic_authority_score": F.when(~(F.col("_graph_only") & is_academic), F.col("academic_authority_score")),
        }
    ).drop("_path_evidence", "_graph_only", "target_kinds")


def truncation_flag(paths: DataFrame, prefetch: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, truncated): a bound was hit while fetching or while walking."""
    walked = paths.groupBy("query_id").agg(F.bool_or("truncated").alias("_w"))
    return queries.select("query_id").join(walked, "query_id", "left").join(prefetch, "query_id", "left").select(
        "query_id", (F.coalesce("_w", F.lit(False)) | F.coalesce("prefetch_truncated", F.lit(False))).alias("truncated")
    )


def prefer_path(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the path of highest relevance, equal ones by the smaller edge-id list."""
    best = F.min_by(F.struct("edge_ids", "relevance"), F.struct(-F.col("relevance"), F.col("edge_ids")))
    return paths.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
