"""The engine: ingest, enrich, build the graph, search, report, reconcile."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import enrich, entities, graph, models, parse, reconcile, retrieval
from lawloom.schemas import LAW_UNITS, OUTBOX, POINTS, SETTINGS, Settings
from lawloom.session import discard, materialize
from lawloom.sources.corpus import read_corpus
from lawloom.sources.store import Staged, Store
from lawloom.streaming.worker import consume

VECTORS, GRAPH = "ingest_vectors", "ingest_graph"
MODEL = "_vector_model"
#: Edge tables: their two ends, and the vertices that each must be among.
EDGES = {
    "e_part_of": ("child_id", "v_law_unit", "id", "parent_id", "v_law_unit", "id"),
    "e_references": ("source_id", "v_law_unit", "id", "target_id", "v_law_unit", "id"),
    "e_refers_external": ("source_unit_id", "v_law_unit", "id", "target_external_id", "v_external", "id"),
    "e_belongs_to": ("source_concept_name", "v_concept", "name", "target_category_name", "v_category", "name"),
    "e_mentions": ("source_unit_id", "v_law_unit", "id", "target_concept_name", "v_concept", "name"),
}
VERTICES = {"v_law_unit": ("id string, unit_type string", "id"), "v_external": ("id string, name string, law_type string", "id"), "v_concept": ("name string, surface_forms array<string>", "name"), "v_category": ("name string", "name")}


def waiting(name: str) -> str:
    """The table of edges that wait for one of their ends."""
    return name.replace("e_", "d_", 1)


class Engine:
    """One store and its models; every method is a batch over tables.

    ``embedder`` makes vectors, ``answer`` the answers to prompts as an expression or ``chat`` as a model; entities come
    from a ``tagger`` (with ``labels``) or from a ``gazetteer`` of phrases. All have offline stand-ins. ``scope`` is the
    prefix of ids within which citations are meant, such as the act.
    """

    def __init__(
        self, spark: SparkSession, root: str, embedder: enrich.Embedder | None = None, gazetteer: DataFrame | None = None, chat: models.Model | None = None,
        tagger: Callable[[], models.Tagger] | None = None, labels: Sequence[str] = (), settings: Settings | None = None, scope: Column | None = None,
    ):
        self.spark, self.store = spark, Store(spark, root)
        self.settings = settings or Settings.load(spark)
        self.embedder = embedder or enrich.hash_embedder(self.settings.dimension)
        self.gazetteer, self.chat, self.tagger, self.labels, self.scope = gazetteer, chat, tagger, tuple(labels), scope
        self.store.create("law_units", LAW_UNITS, "id")
        self.store.create("points", POINTS, "point_id")
        self.errors: list[str] = []

    # -- ingest

    def ingest(self, directory: str, trigger_tasks: bool = True, on_duplicate: str = "last") -> int:
        """Parse the files of a directory and upsert the units, with their ids in the outbox in the same commit; their number."""
        units = materialize(parse.parse_lines(read_corpus(self.spark, directory)), "units")
        if on_duplicate == "error" and parse.duplicates(units).count():
            raise ValueError("ids occur more than once")
        n = self.put(parse.as_units(parse.last_wins(units)), trigger_tasks)
        discard(units)
        return n

    def put(self, units: DataFrame, trigger_tasks: bool = True) -> int:
        """Upsert units (each id once), and put their ids into the outbox in the same commit; their number."""
        units = materialize(units, "units")
        staged = self.store.stage_upsert("law_units", units, "id")
        messages = [self.store.stage_messages(self._messages(units, t)) for t in (VECTORS, GRAPH)] if trigger_tasks and staged.rows else []
        self.store.commit({"law_units": staged}, messages)
        return staged.rows

    def _messages(self, ids: DataFrame, task: str) -> DataFrame:
        return reconcile.messages(ids, task, self.settings.batch).select(*[c.split()[0] for c in OUTBOX.split(", ")])

    def requeue(self, ids: DataFrame, tasks: tuple[str, ...] = (VECTORS, GRAPH)) -> None:
        self.store.commit({}, [self.store.stage_messages(self._messages(ids, t)) for t in tasks])

    def work(self, checkpoint: str) -> None:
        """Handle the messages of the outbox that have not been handled."""
        consume(self.store, {VECTORS: self.ingest_vectors, GRAPH: self.ingest_graph}, checkpoint).awaitTermination()

    def of_ids(self, ids: Sequence[str]) -> DataFrame:
        """The stored units of some ids, as one batch."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        return self.store.read("law_units").join(F.broadcast(wanted), "id", "left_semi").withColumn("batch_id", F.lit(0).cast("long"))  # the ids were given one by one

    def vector_ids(self, ids: Sequence[str]) -> None:
        self.ingest_vectors(self.of_ids(ids))

    def graph_ids(self, ids: Sequence[str]) -> None:
        self.ingest_graph(self.of_ids(ids))

    def ingest_vectors(self, units: DataFrame) -> None:
        """Points of units; their length is that of all points in the store."""
        enriched = enrich.enrich(units.drop("batch_id"), self.embedder, most=self.settings.questions, chat=self.chat)
        points = materialize(enrich.to_points(enriched), "points")
        self._check_dimension(points)
        staged = self.store.stage_upsert("points", points, "point_id")
        self.store.commit({"points": staged})
        discard(points)

    def _check_dimension(self, points: DataFrame) -> None:
        """The first points fix the length of vectors and the measure (cosine); points of another length are refused."""
        sizes = sorted(r[0] for r in points.select(F.size("dense")).distinct().collect())
        if not sizes:
            return
        if not self.store.exists(MODEL):
            self.store.publish(MODEL, self.spark.createDataFrame([(sizes[0], "cosine")], "dimension int, metric string"))
        dimension = self.store.read(MODEL).first()["dimension"]
        if sizes != [dimension]:
            raise ValueError(f"vectors of {sizes} values where the store has {dimension}")

    def ingest_graph(self, units: DataFrame) -> None:
        """Vertices, then edges of which both ends are there, in one commit; the other edges wait for theirs.

        An edge that waits comes in with whatever batch brings its end, so citations of later units are not lost. A
        batch of a message is one group of the clustering of entities.
        """
        if "batch_id" not in units.columns:
            units = units.withColumn("batch_id", F.lit(0).cast("long"))
        units = materialize(units, "batch")
        payload = graph.skeleton(units, self.scope)
        vertices = {"v_law_unit": payload.law_units, "v_external": payload.externals}
        edges = {"e_part_of": payload.part_of, "e_references": payload.references, "e_refers_external": payload.refers_external}
        raw = self._entities(units)
        if raw is not None:
            found = entities.resolve_entities(materialize(raw, "entities"), self.embedder)
            vertices |= {"v_concept": found["concepts"], "v_category": found["categories"]}
            edges |= {"e_belongs_to": found["belongs_to"], "e_mentions": graph.merge_mentions(found["mentions"])}
        staged: dict[str, Staged] = {}
        every: dict[str, DataFrame] = {}
        for name, new in vertices.items():
            schema, key = VERTICES[name]
            staged[name] = self._stage_vertices(name, new, schema, key)
            every[name] = self._after(name, staged[name])
        for name, new in edges.items():
            a, va, ka, b, vb, kb = EDGES[name]
            ends = (a, every[va], ka, b, every[vb], kb)
            old = self.store.read(waiting(name)).drop("missing") if self.store.exists(waiting(name)) else None
            tried = new if old is None else graph.united(new, old, a, b)
            tried = materialize(tried, "edges")
            ready = graph.existing(tried, *ends)
            if name == "e_mentions" and self.store.exists(name):
                ready = graph.united(ready, self.store.read(name).join(ready.select(a, b), [a, b], "left_semi"), a, b)
            staged[name] = self.store.stage_upsert(name, ready, [a, b])
            staged[waiting(name)] = self.store.stage(waiting(name), graph.dangling(tried, *ends))
        self.store.commit(staged)
        discard(units)

    def _entities(self, units: DataFrame) -> DataFrame | None:
        if self.tagger is not None:
            raw = models.tag(units, self.labels, self.tagger)
        elif self.gazetteer is not None:
            raw = entities.gazetteer_entities(units, self.gazetteer)
        else:
            return None
        return raw.join(units.select(F.col("id").alias("source_unit_id"), "batch_id"), "source_unit_id")

    def _stage_vertices(self, name: str, new: DataFrame, schema: str, key: str) -> Staged:
        """Merge new vertices with the stored ones of the same key; others are not read."""
        merge = {"v_law_unit": graph.merge_units, "v_external": graph.merge_externals, "v_concept": graph.merge_concepts, "v_category": lambda old, rows: rows.union(old).distinct()}[name]
        old = self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], schema)
        return self.store.stage_upsert(name, merge(old.join(new.select(key), key, "left_semi"), new), key)

    def _after(self, name: str, staged: Staged) -> DataFrame:
        return self.store._frame(staged.entry)

    def dangling(self) -> DataFrame:
        """``edge, source, target, missing`` of all edges that wait for an end."""
        out = self.spark.createDataFrame([], "edge string, source string, target string, missing string")
        for name, (a, _, _, b, _, _) in EDGES.items():
            if self.store.exists(waiting(name)):
                out = out.unionByName(self.store.read(waiting(name)).select(F.lit(name).alias("edge"), F.col(a).alias("source"), F.col(b).alias("target"), "missing"))
        return out

    def edges(self) -> DataFrame:
        """``src, dst, type`` of the edges between units."""
        out = self.spark.createDataFrame([], "src string, dst string, type string")
        for name in ("e_part_of", "e_references"):
            if self.store.exists(name):
                a, _, _, b, _, _ = EDGES[name]
                out = out.unionByName(self.store.read(name).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(name[2:].upper()).alias("type")))
        return out

    # -- search

    def search(self, text: str = "", k: int | None = None, filters: dict[str, str] | None = None, rerank: Callable[[Column, Column], Column] | None = None, **graph_request) -> DataFrame:
        """The best chunks for a query; with a target unit or concepts, fused with what the graph has around them.

        A part that fails, such as a filter on a field that points don't have, gives no rows; ``errors`` says why.
        """
        k = self.settings.top_k if k is None else k
        vector = None
        if text.strip():
            vector = enrich.embed(self.spark.createDataFrame([(text,)], "t string"), "t", "v", self.embedder).first()["v"]
        request = retrieval.Request(query_text=text, vector=vector, metadata_filters=filters or {}, top_k=k, **graph_request)
        strategies: list[retrieval.Strategy] = [retrieval.HybridStrategy(self.store.read("points"))]
        if request.target_unit_id or request.extracted_concepts:
            mentions = self.store.read("e_mentions") if self.store.exists("e_mentions") else None
            strategies.append(retrieval.GraphStrategy(self.store.read("law_units"), self.edges(), mentions))
        if len(strategies) == 1 and rerank is None:
            found = strategies[0].search(request)
        else:
            found = retrieval.FusionEngine(rerank=rerank).search(request, strategies)
        self.errors = [e for s in strategies for e in s.errors]
        return found

    def console(self, text: str, k: int | None = None) -> DataFrame:
        """What a search prints: score, unit and the beginning of the text."""
        return retrieval.console(self.search(text, k))

    # -- reports

    def stats(self) -> DataFrame:
        names = [n for n in VERTICES if self.store.exists(n)]
        return reconcile.store_counts(self.store.read("law_units"), self.store.read("points"), {n: self.store.read(n) for n in names})

    def reconcile(self, fix: bool = False) -> DataFrame:
        """Units that the vector or graph store lacks; with ``fix`` they are put into the outbox again."""
        graph_ids = self.store.read("v_law_unit") if self.store.exists("v_law_unit") else self.spark.createDataFrame([], "id string")
        found = materialize(reconcile.drift(self.store.read("law_units"), self.store.read("points").select(F.col("unit_id").alias("id")), graph_ids), "drift")
        if fix:
            for task, store in ((VECTORS, "vector"), (GRAPH, "graph")):
                self.requeue(found.where(F.col("store") == store), (task,))
        return found

    def wipe(self, confirm: bool = False) -> None:
        """Empty all tables and the outbox."""
        self.store.wipe("law_units", "points", MODEL, *VERTICES, *EDGES, *map(waiting, EDGES), "outbox", confirm=confirm)
