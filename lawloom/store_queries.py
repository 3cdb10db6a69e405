"""Queries of files, stores, the engine, its worker and its models, with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions import scalar
from lawloom.operators import enrich, entities, graph, models, parse, retrieval
from lawloom.plans.engine import GRAPH, VECTORS, Engine
from lawloom.queries import query
from lawloom.session import materialize, shared_dir
from lawloom.sources import corpus
from lawloom.sources.store import Store, repeated_keys
from lawloom.sources.tables import table
from lawloom.streaming.worker import consume
from lawloom.unit_queries import ACT, DENSE_SQL, EXT_SQL, REFS_SQL, _vector


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _units(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units").where(F.col("id").isNotNull()).select("id", "parent_id", "unit_type", "content", "meta_info", "loaded_at", "unit_seq")
    return parse.as_units(parse.last_wins(u, "loaded_at", "unit_seq"))


# -- files


@query("s01_u01_scan", """
WITH l AS (SELECT coalesce(source_file, 'none') AS file, unnest(regexp_split_to_array(content, '\\r\\n|\\r|\\n')) AS l FROM law_units WHERE content IS NOT NULL),
c AS (SELECT file, translate(trim(l, chr(13) || chr(10) || ' '), 'şţŞŢ', 'șțȘȚ') AS line FROM l)
SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM c WHERE length(line) > 0 GROUP BY file""")  # fmt: skip
def scan(spark: SparkSession, d: str) -> DataFrame:
    """The content of the units written as text files, one folder a source file, and read as a corpus."""
    folder = _folder(spark)
    rows = table(spark, d, "law_units").where(F.col("content").isNotNull()).select(F.coalesce("source_file", F.lit("none")).alias("file"), "content")
    rows.withColumnRenamed("content", "value").write.partitionBy("file").text(folder)
    lines = corpus.in_order(corpus.read_corpus(spark, f"{folder}/*"))
    file = F.url_decode(F.regexp_extract("file", r"file=([^/]+)/", 1))
    return lines.groupBy(file.alias("file")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("s02_decode", "SELECT id, 'UTF-8' AS charset, translate(name, 'şţŞŢ', 'șțȘȚ') AS name FROM v_external UNION ALL SELECT id, 'ISO-8859-2', translate(name, 'şţŞŢ', 'șțȘȚ') FROM v_external")
def decode(spark: SparkSession, d: str) -> DataFrame:
    """Names as bytes of both charsets, the first behind a byte order mark, and what is read from them."""
    e = table(spark, d, "v_external").select("id", "name")
    central = F.encode(F.translate(F.translate("name", "șțȘȚ", "şţŞŢ"), corpus.LATIN2, corpus.LATIN1), "ISO-8859-1")
    utf8 = F.encode(F.concat(F.lit("﻿"), "name"), "UTF-8")
    every = e.select("id", F.lit("UTF-8").alias("charset"), utf8.alias("b")).unionByName(e.select("id", F.lit("ISO-8859-2").alias("charset"), central.alias("b")))
    return every.select("id", "charset", corpus.clean(corpus.decode(F.col("b"))).alias("name"))


@query("s04_ontology", "SELECT category_label AS label, CAST(row_number() OVER (ORDER BY category_label) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT category_label FROM raw_entities WHERE category_label IS NOT NULL)")
def ontology(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    labels = table(spark, d, "raw_entities").where(F.col("category_label").isNotNull()).agg(F.array_sort(F.collect_set("category_label")).alias("labels"))
    labels.select(F.lit("d").alias("domain"), F.lit("1").alias("version"), "labels").coalesce(1).write.json(folder)
    return corpus.read_ontology(spark, folder)


# -- the store


@query("s05_k03_stored_unit", "SELECT id, parent_id, unit_type, content FROM (SELECT id, arg_max([parent_id], k)[1] AS parent_id, arg_max([unit_type], k)[1] AS unit_type, arg_max([content], k)[1] AS content FROM (SELECT *, (loaded_at, unit_seq) AS k FROM law_units) GROUP BY id) WHERE id = (SELECT min(id) FROM law_units)")
def stored_unit(spark: SparkSession, d: str) -> DataFrame:
    """The first unit by id, read from its bucket of the store."""
    s = Store(spark, _folder(spark))
    s.upsert("law_units", _units(spark, d), "id")
    first = table(spark, d, "law_units").agg(F.min("id")).first()[0]
    return s.get("law_units", "id", first).select("id", "parent_id", "unit_type", "content")


@query("k02_k21_insert", "SELECT id, name, law_type FROM v_external")
def insert(spark: SparkSession, d: str) -> DataFrame:
    """A table created, and filled by inserts of new keys only."""
    s = Store(spark, _folder(spark))
    s.create("v_external", "id string, name string, law_type string", "id")
    rows = table(spark, d, "v_external").select("id", "name", "law_type")
    for typed in (F.col("law_type").isNull(), F.col("law_type").isNotNull()):
        s.insert("v_external", rows.where(typed), "id")
    return s.read("v_external")


@query("k06_points_upsert", "SELECT point_id, arg_max([unit_id], k)[1] AS unit_id, arg_max([content], k)[1] AS content, count(*) > 1 AS again FROM (SELECT *, (indexed_at, unit_id, coalesce(content, ''), coalesce(question_text, '')) AS k FROM points) GROUP BY point_id")
def points_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points stored at their first state, then upserted with their last."""
    s = Store(spark, _folder(spark))
    order = F.struct("indexed_at", "unit_id", F.coalesce("content", F.lit("")).alias("c"), F.coalesce("question_text", F.lit("")).alias("q"))
    by_point = table(spark, d, "points").groupBy("point_id")
    value = F.struct("unit_id", "content")
    for best in (F.min_by, F.max_by):
        state = by_point.agg(best(value, order).alias("m"), (F.count("*") > 1).alias("again")).select("point_id", "m.unit_id", "m.content", "again")
        s.upsert("points", state, "point_id")
    return s.read("points")


@query("k07_repeated_keys", "SELECT id, count(*) AS n FROM law_units GROUP BY id HAVING count(*) > 1")
def repeated(spark: SparkSession, d: str) -> DataFrame:
    return repeated_keys(table(spark, d, "law_units"), "id")


@query("a16_p20_counts", "SELECT 'units' AS what, count(DISTINCT id) AS n FROM law_units WHERE id IS NOT NULL UNION ALL SELECT 'again', count(DISTINCT id) FROM law_units WHERE id IS NOT NULL UNION ALL SELECT 'stored', count(DISTINCT id) FROM law_units WHERE id IS NOT NULL")
def counts(spark: SparkSession, d: str) -> DataFrame:
    """What upserts say they wrote, the first and the second time, and what is there."""
    s, units = Store(spark, _folder(spark)), _units(spark, d)
    written = [("units", s.upsert("law_units", units, "id")), ("again", s.upsert("law_units", units, "id")), ("stored", s.read("law_units").count())]
    return spark.createDataFrame(written, "what string, n long")


@query("k20_wipe", "SELECT unnest(['law_units', 'points', 'outbox']) AS name, CAST(0 AS BIGINT) AS n")
def wipe(spark: SparkSession, d: str) -> DataFrame:
    """What is left of all units and their messages after a wipe."""
    e = Engine(spark, _folder(spark), enrich.hash_embedder(16))
    e.put(_units(spark, d))
    e.wipe(confirm=True)
    names = ["law_units", "points"]
    left = [(n, e.store.read(n).count()) for n in names]
    outbox = e.store._fs.exists(e.store._path(f"{e.store.root}/outbox"))
    return spark.createDataFrame([*left, ("outbox", int(outbox))], "name string, n long")


# -- the engine: two ingests, the second of which has what the first cites


@lru_cache(maxsize=4)
def _engine(spark: SparkSession, d: str) -> Engine:
    """An engine after two ingests; queries of one session on the same tables look at the same."""
    engine = Engine(spark, _folder(spark), enrich.hash_embedder(16), scope=F.regexp_extract("id", ACT, 1))
    units = materialize(_units(spark, d), "units")
    for half in (0, 1):
        part = units.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half)
        engine.put(part)
        engine.ingest_graph(part)
    return engine


_HELD = "(SELECT id FROM law_units)"
_PART_OF_SQL = "SELECT DISTINCT id AS source, parent_id AS target FROM (SELECT id, arg_max([parent_id], (loaded_at, unit_seq))[1] AS parent_id FROM law_units GROUP BY id) WHERE parent_id IS NOT NULL AND parent_id <> ''"


@query("k08_k14_k17_g06_edges", REFS_SQL + EXT_SQL.replace("\nWITH m AS", ", me AS").replace("FROM m)", "FROM me)").replace("t AS (SELECT id, trim", "te AS (SELECT id, trim").replace("FROM t)", "FROM te)") + f"""
SELECT 'e_references' AS edge, source_id AS source, target_id AS target FROM refs WHERE target_id IN {_HELD} AND source_id IS NOT NULL
UNION ALL SELECT 'e_part_of', source, target FROM ({_PART_OF_SQL}) WHERE target IN {_HELD}
UNION ALL SELECT DISTINCT 'e_refers_external', source_unit_id, target_external_id FROM ext""")  # fmt: skip
def engine_edges(spark: SparkSession, d: str) -> DataFrame:
    """All edges after two ingests: none that crosses from one to the other is lost."""
    s = _engine(spark, d).store
    ends = {"e_references": ("source_id", "target_id"), "e_part_of": ("child_id", "parent_id"), "e_refers_external": ("source_unit_id", "target_external_id")}
    parts = [s.read(n).select(F.lit(n).alias("edge"), F.col(a).alias("source"), F.col(b).alias("target")) for n, (a, b) in ends.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k16_dangling", REFS_SQL + f"""
SELECT 'e_references' AS edge, source_id AS source, target_id AS target, 'target' AS missing FROM refs WHERE target_id NOT IN {_HELD}
UNION ALL SELECT 'e_part_of', source, target, 'target' FROM ({_PART_OF_SQL}) WHERE target NOT IN {_HELD}""")  # fmt: skip
def engine_dangling(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).dangling()


@query("k09_k11_vertices", EXT_SQL + "SELECT 'v_law_unit' AS label, id, unit_type AS kind FROM (SELECT id, arg_max([unit_type], (loaded_at, unit_seq))[1] AS unit_type FROM law_units GROUP BY id) UNION ALL SELECT 'v_external', target_external_id, max((name, law_type))[2] FROM ext GROUP BY target_external_id")
def engine_vertices(spark: SparkSession, d: str) -> DataFrame:
    s = _engine(spark, d).store
    return s.read("v_law_unit").select(F.lit("v_law_unit").alias("label"), "id", F.col("unit_type").alias("kind")).unionByName(s.read("v_external").select(F.lit("v_external").alias("label"), "id", F.col("law_type").alias("kind")))


@query("u02_skeleton", REFS_SQL + EXT_SQL.replace("\nWITH m AS", ", me AS").replace("FROM m)", "FROM me)").replace("t AS (SELECT id, trim", "te AS (SELECT id, trim").replace("FROM t)", "FROM te)") + f"""
SELECT 'law_units' AS part, count(DISTINCT id) AS n FROM law_units UNION ALL SELECT 'part_of', count(*) FROM ({_PART_OF_SQL}) UNION ALL SELECT 'references', count(*) FROM refs
UNION ALL SELECT 'externals', count(DISTINCT target_external_id) FROM ext UNION ALL SELECT 'refers_external', count(*) FROM (SELECT DISTINCT source_unit_id, target_external_id FROM ext)""")  # fmt: skip
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    payload = graph.skeleton(_units(spark, d), F.regexp_extract("id", ACT, 1)).tables()
    payload["externals"] = payload["externals"].select("id")
    out = None
    for name, t in payload.items():
        n = t.distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("s09_p09_vertices", "SELECT DISTINCT id, unit_type FROM law_units")
def vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(table(spark, d, "law_units")).distinct()


# -- the outbox and its worker


_MESSAGES_SQL = "WITH u AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS batch_id FROM (SELECT DISTINCT id FROM law_units WHERE id IS NOT NULL))"


@query("k18_messages", _MESSAGES_SQL + ", m AS (SELECT batch_id, count(*) AS n_units, min(id) AS first_id, max(id) AS last_id FROM u GROUP BY batch_id) SELECT task, m.* FROM m, (SELECT unnest(['ingest_vectors', 'ingest_graph']) AS task)")
def messages(spark: SparkSession, d: str) -> DataFrame:
    """What a commit of all units hands to the outbox."""
    engine = Engine(spark, _folder(spark), enrich.hash_embedder(16))
    engine.put(_units(spark, d))
    m = spark.read.parquet(f"{engine.store.root}/outbox")
    return m.select("task", "batch_id", F.size("unit_ids").cast("long").alias("n_units"), F.array_min("unit_ids").alias("first_id"), F.array_max("unit_ids").alias("last_id"))


@query("x01_j10_worker", _MESSAGES_SQL + "SELECT id, batch_id FROM u")
def worker(spark: SparkSession, d: str) -> DataFrame:
    """The units that the worker hands to a task, with the batch of their message."""
    engine = Engine(spark, _folder(spark), enrich.hash_embedder(16))
    engine.put(_units(spark, d))
    seen = lambda units: engine.store.upsert("seen", units.select("id", "batch_id"), "id")
    consume(engine.store, {VECTORS: seen, GRAPH: lambda units: None}, f"{engine.store.root}/_checkpoint").awaitTermination()
    return engine.store.read("seen")


# -- models


_LEAD_SQL = "array_to_string(string_split(content, ' ')[1:6], ' ')"


@query("m03_m04_answers", f"SELECT DISTINCT id, 'Ce prevede: ' || {_LEAD_SQL} || '?' AS q1, 'Când se aplică: ' || {_LEAD_SQL} || '?' AS q3 FROM law_units WHERE content IS NOT NULL AND trim(content) <> ''")
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions out of the JSON answers of a chat model (a stand-in that is asked in batches)."""

    def load():
        import json

        def call(prompts):
            out = []
            for p in prompts:
                content = json.loads(p)[1]["content"].split("\n\n", 1)[1]
                lead = " ".join(content.split(" ")[:6])
                out.append(json.dumps({"questions": [f"{q}: {lead}?" for q in ("Ce prevede", "Cui se aplică", "Când se aplică", "De ce")]}))
            return out

        return call

    u = table(spark, d, "law_units").where(F.col("content").isNotNull() & (F.trim("content") != "")).select("id", "content").distinct()
    asked = enrich.asked_answers(u, models.batched(load)).withColumn("q", scalar.questions_of(F.col("answer")))
    return asked.select("id", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"))


@query("t09_m07_tagged", "SELECT lower(m) AS surface_form, 'Act' AS category_label, id AS source_unit_id, CAST(ord AS BIGINT) AS ord FROM (SELECT id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS ord FROM (SELECT DISTINCT id, regexp_extract_all(content, '(?:Legea|Ordonanța|Decizia) nr\\. [0-9]+/[0-9]+') AS ms FROM law_units WHERE content IS NOT NULL))")
def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a tagger (a stand-in by a pattern) that is asked for two labels in batches of eight texts."""

    def load():
        import re

        pattern = re.compile(r"(?:Legea|Ordonanța|Decizia) nr\. [0-9]+/[0-9]+")
        return lambda texts, labels: [[(m, labels[0]) for m in pattern.findall(t)] for t in texts]

    return models.tag(table(spark, d, "law_units").select("id", "content").distinct(), ["Act", "Loc"], load)


@query("f21_f22_prompts", "SELECT DISTINCT 'prompt' AS kind, id AS key, printf('Write 3 questions that readers of this passage of an act might have and that it answers, as JSON with a list under \"questions\".\n\n%s', content) AS text FROM law_units WHERE content IS NOT NULL UNION ALL SELECT DISTINCT 'anchor', CAST(entity_id AS VARCHAR), category_label || ': ' || surface_form FROM raw_entities WHERE category_label IS NOT NULL AND surface_form IS NOT NULL")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units").where(F.col("content").isNotNull()).select(F.lit("prompt").alias("kind"), F.col("id").alias("key"), enrich.question_prompt(F.col("content")).alias("text"))
    r = table(spark, d, "raw_entities").where(F.col("category_label").isNotNull() & F.col("surface_form").isNotNull())
    return u.unionByName(r.select(F.lit("anchor").alias("kind"), F.col("entity_id").cast("string").alias("key"), entities.anchor().alias("text"))).distinct()


# -- checks and entities


@query("p18_all_rejected", """
SELECT 'points' AS name, count(*) AS n FROM points WHERE point_id IS NULL OR unit_id IS NULL OR CASE vector_type WHEN 'content' THEN content WHEN 'question' THEN question_text END IS NULL
UNION ALL SELECT 'raw_entities', count(*) FROM raw_entities WHERE coalesce(trim(surface_form), '') = '' OR category_label IS NULL OR source_unit_id IS NULL
UNION ALL SELECT 'e_references', count(*) FROM e_references WHERE source_id IS NULL OR target_id IS NULL OR source_id = target_id
UNION ALL SELECT 'law_units', count(*) FROM law_units WHERE id IS NULL OR content IS NULL OR unit_type IS NULL OR unit_type NOT IN ('chapter', 'section', 'article', 'prologue', 'paragraph', 'letter_item', 'num_item')""")  # fmt: skip
def all_rejected(spark: SparkSession, d: str) -> DataFrame:
    bad = {
        "points": parse.rejected_points(table(spark, d, "points")), "raw_entities": parse.rejected_entities(table(spark, d, "raw_entities")),
        "e_references": parse.rejected_edges(table(spark, d, "e_references"), "source_id", "target_id"), "law_units": parse.rejected(table(spark, d, "law_units")),
    }
    out = None
    for name, t in bad.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("p13_noise", """
WITH f AS (SELECT DISTINCT concept_id, unnest(surface_forms) AS f FROM v_concept)
SELECT concept_id, arg_min(f, (length(f), f)) AS name, count(*) AS n_forms FROM f WHERE len(string_split(f, ' ')) > 2 GROUP BY concept_id""")  # fmt: skip
def noise(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of labelled forms, of which those of one or two words are noise."""
    f = table(spark, d, "v_concept").select(F.lit(0).cast("long").alias("batch_id"), F.col("concept_id").cast("int").alias("label"), F.explode("surface_forms").alias("surface_form")).distinct()
    f = f.withColumn("label", F.when(F.size(F.split("surface_form", " ")) > 2, F.col("label")).otherwise(-1))
    return entities.concepts(f).select(F.col("label").cast("long").alias("concept_id"), "name", F.size("surface_forms").cast("long").alias("n_forms"))


@query("a04_categories", """
WITH n AS (SELECT surface_form, category_label, count(*) AS n, min(ord) AS o FROM raw_entities WHERE surface_form IS NOT NULL GROUP BY ALL),
m AS (SELECT surface_form, coalesce(arg_max(category_label, (n, -o)) FILTER (category_label IS NOT NULL), 'General') AS c FROM n GROUP BY surface_form)
SELECT c AS category_label, count(*) AS n_forms FROM m GROUP BY c""")  # fmt: skip
def categories(spark: SparkSession, d: str) -> DataFrame:
    return entities.dominant_categories(table(spark, d, "raw_entities")).groupBy("category_label").agg(F.count("*").alias("n_forms"))


# -- fusion of strategies

_FOUND_SQL = f"""WITH {DENSE_SQL},
a AS (SELECT CAST(vec_id AS VARCHAR) AS unit_id, row_number() OVER (ORDER BY round(score, 6) DESC, CAST(vec_id AS VARCHAR)) AS r FROM dt),
b AS (SELECT CAST(vec_id AS VARCHAR) AS unit_id, row_number() OVER (ORDER BY CAST(label AS DOUBLE) DESC, CAST(vec_id AS VARCHAR)) AS r FROM (SELECT vec_id, label FROM embeddings ORDER BY label DESC, vec_id LIMIT 20)),
f AS (SELECT unit_id, sum(1 / (r - 1 + 2.0e0)) AS s, string_agg(strategy, '+' ORDER BY strategy) AS strategies FROM (SELECT *, 'dense' AS strategy FROM a UNION ALL SELECT *, 'label' FROM b) GROUP BY unit_id)
"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    dense = retrieval.dense_top(e, _vector(spark, d), 10, "vec_id", "embedding").select(F.col("vec_id").cast("string").alias("unit_id"), F.round("score", 6).alias("raw_score"), F.lit("dense").alias("source_strategy"))
    label = e.orderBy(F.desc("label"), "vec_id").limit(20).select(F.col("vec_id").cast("string").alias("unit_id"), F.col("label").cast("double").alias("raw_score"), F.lit("label").alias("source_strategy"))
    return dense.unionByName(label).select("*", F.concat(F.lit("text "), "unit_id").alias("content"), F.lit(None).cast("string").alias("parent_id"))


@query("r03_r04_fusion", _FOUND_SQL + "SELECT unit_id, strategies AS source_strategy, round(s, 6) AS fusion_score FROM f ORDER BY s DESC, unit_id LIMIT 7")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.FusionEngine().fuse_and_rank(retrieval.Request("x", top_k=7), _found(spark, d))
    return found.select("unit_id", "source_strategy", F.round("fusion_score", 6).alias("fusion_score"))


@query("m11_reranked", _FOUND_SQL + "SELECT unit_id, -CAST(unit_id AS DOUBLE) AS cross_encoder_score FROM f ORDER BY CAST(unit_id AS BIGINT) LIMIT 7")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    engine = retrieval.FusionEngine(rerank=lambda query, content: -F.regexp_extract(content, r"(\d+)", 1).cast("double"))
    return engine.fuse_and_rank(retrieval.Request("x", top_k=7), _found(spark, d)).select("unit_id", "cross_encoder_score")


@query("k22_f26_console", _FOUND_SQL + "SELECT printf('%.4f', s) AS score, unit_id, 'text ' || unit_id AS snippet FROM f ORDER BY s DESC, unit_id LIMIT 7")
def console(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.console(retrieval.FusionEngine().fuse_and_rank(retrieval.Request("x", top_k=7), _found(spark, d)))


@query("g07_r01_graph_strategy", """
WITH RECURSIVE e AS (SELECT DISTINCT id AS src, parent_id AS dst FROM law_units WHERE parent_id IS NOT NULL),
s AS (SELECT min(id) AS id FROM law_units WHERE unit_type = 'letter_item'), w AS (SELECT id, 0 AS hops FROM s UNION SELECT e.dst, w.hops + 1 FROM w JOIN e ON w.id = e.src WHERE w.hops < 3),
b AS (SELECT id, 1.0e0 / (1 + min(hops)) AS raw_score FROM w WHERE id IN (SELECT id FROM law_units) GROUP BY id)
SELECT id AS unit_id, round(raw_score, 6) AS raw_score FROM b ORDER BY raw_score DESC, id LIMIT 10""")  # fmt: skip
def graph_strategy(spark: SparkSession, d: str) -> DataFrame:
    """What the graph has within three hops over a unit: the first letter item by id."""
    u = table(spark, d, "law_units")
    start = u.where(F.col("unit_type") == "letter_item").agg(F.min("id")).first()[0]
    edges = graph.part_of(u).select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("PART_OF").alias("type"))
    request = retrieval.Request(target_unit_id=start, max_hops=3, top_k=10)
    return retrieval.GraphStrategy(_units(spark, d), edges).search(request).select("unit_id", F.round("raw_score", 6).alias("raw_score"))
