"""Dense, sparse, hybrid and graph retrieval."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawloom.functions.scalar import snippet, terms
from lawloom.operators import graph
from lawloom.operators.enrich import inverse_frequencies
from lawloom.schemas import CHUNKS, SETTINGS

log = logging.getLogger(__name__)
#: Queries that are sent to every task at once; more of them are asked in several passes.
QUERIES = 4096


@dataclass(frozen=True)
class Request:
    """What is looked for. ``vector`` is the query's dense vector."""

    query_text: str | None = None
    vector: list[float] | None = None
    metadata_filters: dict[str, str] = field(default_factory=dict)
    target_unit_id: str | None = None
    max_hops: int = SETTINGS.max_hops
    allowed_edge_types: tuple[str, ...] = SETTINGS.edge_types
    extracted_concepts: tuple[str, ...] = ()
    top_k: int = SETTINGS.top_k


def filtered(points: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Points that equal every given value; a name that points don't have is an error."""
    for name, value in filters.items():
        if name not in points.columns:
            raise ValueError(f"no such field: {name}")
        points = points.where(F.col(name) == F.lit(value))
    return points


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``dim`` finite values, not all zero, and the places of these rows."""
    fits = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False))
    x = np.asarray(column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], fits[good]


def _nearest(batches, queries: np.ndarray, names: Sequence, k: int, kind: pa.DataType):
    """Of each query the ``k`` nearest rows of a task: a matrix product a batch, and what is left of the batches before."""
    best: pa.Table | None = None
    for b in batches:
        x, at = _unit(b.column(1), queries.shape[1])
        if not len(at) or not len(names):
            continue
        score = np.clip(queries @ x.T, -1, 1)
        n = min(k, len(at))
        # equal ones at the edge come along, for the keys to decide
        q, i = np.nonzero(score >= -np.partition(-score, n - 1, axis=1)[:, n - 1 : n])
        t = pa.table({"query": pa.array([names[j] for j in q], kind), "key": b.column(0).take(pa.array(at[i])), "score": pa.array(score[q, i])})
        best = t if best is None else pa.concat_tables([best, t])
        if best.num_rows > 4 * k * len(names):
            best = _first(best, k)
    if best is not None:
        yield from _first(best, k).to_batches()


def _first(t: pa.Table, k: int) -> pa.Table:
    t = t.sort_by([("query", "ascending"), ("score", "descending"), ("key", "ascending")])
    q = t["query"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return t.filter(pa.array(place < k))


def nearest(points: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], k: int, key: str = "point_id", dense: str = "dense", name: str = "query") -> DataFrame:
    """``<name>, <key>, score, rank``: for each of ``queries`` (a name and a vector) the ``k`` points of largest cosine.

    Vectors go through Arrow to a matrix product. A task sends on its ``k`` best of each query, so what is shuffled does
    not grow with the points but with the tasks. Ties go to the smaller key; a vector that is null, zero, not finite or
    of another length is no point.
    """
    spark = points.sparkSession
    kinds = dict(points.select(key).dtypes)
    kind = "long" if not queries or isinstance(queries[0][0], int) else "string"
    out = f"query {kind}, key {kinds[key]}, score double"
    parts = []
    for a in range(0, len(queries), QUERIES):
        part = queries[a : a + QUERIES]
        v = np.array([q[1] for q in part], dtype=np.float64)
        norm = np.linalg.norm(v, axis=1)
        ok = np.flatnonzero(np.isfinite(norm) & (norm > 0))
        shared = spark.sparkContext.broadcast((v[ok] / norm[ok, None], [part[i][0] for i in ok]))

        def run(batches, shared=shared):
            return _nearest(batches, *shared.value, k, pa.int64() if kind == "long" else pa.string())

        parts.append(points.select(F.col(key).alias("key"), F.col(dense).alias("v")).mapInArrow(run, out))
    if not parts:
        return spark.createDataFrame([], f"{name} {kind}, {key} {kinds[key]}, score double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return batch_top(every, "query", "key", k).select(F.col("query").alias(name), F.col("key").alias(key), "score", "rank")


def dense_top(points: DataFrame, vector: list[float], k: int, key: str = "point_id", dense: str = "dense") -> DataFrame:
    """``key, score, rank`` of the ``k`` points with the largest cosine; ties go to the smaller key."""
    return nearest(points, [("", vector)], k, key, dense).drop("query")


def sparse_top(weights: DataFrame, text: str, k: int, key: str = "key", n: Column | None = None) -> DataFrame:
    """``key, score, rank`` of the ``k`` documents with the largest BM25 score for the distinct terms of ``text``.

    ``weights`` as from ``term_weights``: an inverted index, of which only the query's terms are read and summed; ``n``
    is the number of its documents, if known.
    """
    if n is None:
        n = weights.select(F.countDistinct("key").alias("n")).scalar()
    # a query has few terms: as a filter on the term they reach below the aggregation that counts them
    hits = weights.where(F.col("term").isin(_terms(weights, text)))
    hits = hits.join(inverse_frequencies(hits, n), "term")
    return _ranked(hits.groupBy(key).agg(F.sum(F.col("weight") * F.col("idf")).alias("score")), k, key)


def _terms(df: DataFrame, text: str) -> list[str]:
    return df.sparkSession.range(1).select(F.array_distinct(terms(F.lit(text))).alias("t")).first()["t"]


def stored_sparse_top(points: DataFrame, text: str, k: int, every: DataFrame | None = None) -> DataFrame:
    """``point_id, score, rank`` by the sparse vectors that are stored with the points; no text is read.

    A vector's indices are hashes of terms, so a query reads the points that share one with it. Frequencies are those
    over ``every`` point (by default of ``points``), of which only the number with each term is needed.
    """
    spark = points.sparkSession
    asked = spark.range(1).select(F.array_distinct(F.transform(terms(F.lit(text)), lambda t: F.xxhash64(t))).alias("t")).first()["t"]
    wanted = F.array(*[F.lit(h).cast("long") for h in asked]) if asked else F.array().cast("array<bigint>")

    def hits(df: DataFrame) -> DataFrame:
        met = df.where(F.arrays_overlap("sparse.indices", wanted)).select("point_id", F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("z"))
        return met.select("point_id", F.col("z.indices").alias("term"), F.col("z.values").alias("weight")).where(F.col("term").isin(asked))

    held = (points if every is None else every).where(F.size("sparse.indices") > 0)
    found = hits(points)
    frequencies = inverse_frequencies(found if every is None else hits(every), held.select(F.count("*").alias("n")).scalar())
    return _ranked(found.join(frequencies, "term").groupBy("point_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score")), k, "point_id")


def _ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    # the k rows are few, so the window over them has no partitions
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def fuse(*branches: DataFrame, key: str = "key", rrf_k: int = SETTINGS.rrf_k, first: int = 0) -> DataFrame:
    """``key, fusion_score``: reciprocal ranks, summed over the branches; ranks count from ``first``."""
    every = branches[0].select(key, "rank")
    for b in branches[1:]:
        every = every.unionByName(b.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1 / (F.col("rank") - 1 + first + rrf_k)).alias("fusion_score"))


def batch_top(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query of ``scored(query, key, score)``, ranked; pruned before the shuffle."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def chunks(fused: DataFrame, points: DataFrame, strategy: str, key: str = "point_id") -> DataFrame:
    """Result rows of fused points (at most ``top_k``), best first."""
    text = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("question_text"), F.lit(""))
    rows = points.join(F.broadcast(fused), key).orderBy(F.desc("fusion_score"), key)
    return rows.select(
        F.coalesce("unit_id", F.lit("unknown")).alias("unit_id"), text.alias("content"), "parent_id", F.lit(strategy).alias("source_strategy"),
        F.col("fusion_score").alias("raw_score"), "fusion_score", F.lit(0.0).alias("cross_encoder_score"),
    )


class Strategy(ABC):
    """A way of retrieving. ``retrieve`` may fail; ``search`` does not: an error gives no rows, and is logged and kept."""

    name = "strategy"

    def __init__(self) -> None:
        self.errors: list[str] = []

    @abstractmethod
    def retrieve(self, request: Request) -> DataFrame: ...

    @abstractmethod
    def empty(self) -> DataFrame: ...

    def search(self, request: Request) -> DataFrame:
        try:
            return self.retrieve(request)
        except Exception as e:  # noqa: BLE001  an error of one strategy is not one of the search
            self.errors.append(f"{type(e).__name__}: {e}")
            log.warning("strategy %s gives no rows: %s", self.name, e)
            return self.empty()


class HybridStrategy(Strategy):
    """Dense and sparse candidates of filtered points, fused; points, not units, are ranked."""

    name = "hybrid"

    def __init__(self, points: DataFrame, rrf_k: int = SETTINGS.rrf_k):
        super().__init__()
        self.points, self.rrf_k = points, rrf_k

    def empty(self) -> DataFrame:
        return self.points.sparkSession.createDataFrame([], CHUNKS)

    def retrieve(self, request: Request) -> DataFrame:
        if not request.query_text or not request.query_text.strip():
            return self.empty()
        points, wide = filtered(self.points, request.metadata_filters), SETTINGS.prefetch * request.top_k
        branches = [dense_top(points, request.vector, wide)] if request.vector else []
        branches.append(stored_sparse_top(points, request.query_text, wide, self.points if request.metadata_filters else None))
        fused = fuse(*branches, key="point_id", rrf_k=self.rrf_k).orderBy(F.desc("fusion_score"), "point_id").limit(request.top_k)
        return chunks(fused, points, self.name)


class GraphStrategy(Strategy):
    """Units around a target unit, by hops over the allowed kinds of edges, and units that mention the concepts asked for.

    ``edges(src, dst, type)``, ``mentions(source_unit_id, target_concept_name)``, ``units(id, parent_id, content)``. A unit
    scores 1 / (1 + hops), and for concepts the share of those asked for that it mentions; the better of both holds.
    """

    name = "graph"

    def __init__(self, units: DataFrame, edges: DataFrame, mentions: DataFrame | None = None):
        super().__init__()
        self.units, self.edges, self.mentions = units, edges, mentions

    def empty(self) -> DataFrame:
        return self.units.sparkSession.createDataFrame([], CHUNKS)

    def retrieve(self, request: Request) -> DataFrame:
        spark, found = self.units.sparkSession, []
        if request.target_unit_id:
            start = spark.createDataFrame([(request.target_unit_id,)], "id string")
            near = graph.k_hop(start, self.edges, request.max_hops, request.allowed_edge_types)
            found.append(near.select("id", (1 / (1 + F.col("hops"))).alias("score")))
        if request.extracted_concepts and self.mentions is not None:
            names = spark.createDataFrame([(n,) for n in dict.fromkeys(request.extracted_concepts)], "name string")
            met = graph.concept_walk(names, self.mentions, self.units)
            found.append(met.select("id", (F.col("n_concepts") / len(set(request.extracted_concepts))).alias("score")))
        if not found:
            return self.empty()
        scored = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        best = scored.groupBy("id").agg(F.max("score").alias("score")).join(self.units.select("id", "parent_id", "content"), "id")
        best = best.orderBy(F.desc("score"), "id").limit(request.top_k)
        return best.select(
            F.col("id").alias("unit_id"), F.coalesce("content", F.lit("")).alias("content"), "parent_id", F.lit(self.name).alias("source_strategy"),
            F.col("score").alias("raw_score"), F.lit(0.0).alias("fusion_score"), F.lit(0.0).alias("cross_encoder_score"),
        ).orderBy(F.desc("raw_score"), "unit_id")


class FusionEngine:
    """Fuses the chunks of several strategies by reciprocal rank, reranks them by a hook, and prunes."""

    def __init__(self, rrf_k: int = SETTINGS.rrf_k, rerank: Callable[[Column, Column], Column] | None = None):
        self.rrf_k, self.rerank = rrf_k, rerank

    def search(self, request: Request, strategies: Sequence[Strategy]) -> DataFrame:
        """What the strategies find, fused; a strategy that fails adds nothing."""
        found = [s.search(request) for s in strategies]
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return self.fuse_and_rank(request, every)

    def fuse_and_rank(self, request: Request, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("source_strategy").orderBy(F.desc("raw_score"), "unit_id", "content"))
        score = found.withColumn("r", rank).groupBy("unit_id", "content", "parent_id").agg(
            F.sum(1 / (F.col("r") - 1 + self.rrf_k)).alias("fusion_score"), F.max("raw_score").alias("raw_score"), F.array_join(F.array_sort(F.collect_set("source_strategy")), "+").alias("source_strategy")
        )
        cross = self.rerank(F.lit(request.query_text or ""), F.col("content")) if self.rerank else F.lit(0.0)
        out = score.withColumn("cross_encoder_score", cross.cast("double")).orderBy(F.desc("cross_encoder_score"), F.desc("fusion_score"), "unit_id").limit(request.top_k)
        return out.select("unit_id", "content", "parent_id", "source_strategy", "raw_score", "fusion_score", "cross_encoder_score")


def console(found: DataFrame) -> DataFrame:
    """Score with four places, unit and the first 100 characters of the text."""
    return found.select(F.format_string("%.4f", F.col("fusion_score")).alias("score"), "unit_id", snippet(F.col("content")).alias("snippet"))
