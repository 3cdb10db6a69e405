"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm import canonical, density, leakage, lookalikes, mojibake, packing, similar
from lawloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- problem 1: free values to a canonical list


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    concepts = table(spark, d, "v_concept")
    forms = canonical.free_values(table(spark, d, "raw_entities"), "entity_id", "surface_form", concepts, "name")
    return canonical.map_to_reference(forms, "entity_id", "surface_form", concepts, "concept_id", "name")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select(F.col("row_key").alias("entity_id"), F.col("entry_id").alias("concept_id"))


@query("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows per entry and number of matched content words; -1 counts the unmatched."""
    return _mapped(spark, d).groupBy(F.col("entry_id").alias("concept_id"), "matched").agg(F.count("*").alias("n_entities"))


# -- problem 2: clusters of spellings


def _clusters(spark: SparkSession, d: str) -> density.Clusters:
    raw = table(spark, d, "raw_entities").where(F.col("category_label") == "General").select(F.col("surface_form").alias("form"))
    known = table(spark, d, "v_concept").select(F.explode("surface_forms").alias("form"))
    return density.cluster_forms(raw.unionByName(known), "form")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).pairs()


@query("p2_links")
def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """The clusters as membership: each form with the representative of its cluster."""
    return _clusters(spark, d).links()


@query("p2_clusters")
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).describe()


# -- problem 4: most similar vectors

DIM, NEIGHBOURS, FLOOR = 64, 5, 0.9


def _collections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units = table(spark, d, "law_units").select(F.concat("id", F.lit("_embedding")).alias("key"), F.col("embedding").alias("v"))
    enriched = table(spark, d, "law_unit_enriched")
    content = enriched.select(F.concat("id", F.lit("_content")).alias("key"), F.col("content_vector").alias("v"))
    questions = enriched.select("id", F.posexplode("question_vectors").alias("n", "v")).select(F.concat("id", F.lit("_question_"), "n").alias("key"), "v")
    return units, content.unionByName(questions)


def _similar_pairs(vectors: DataFrame) -> DataFrame:
    near = similar.similar(vectors, "key", "v", DIM, NEIGHBOURS, FLOOR)
    return near.select(F.least("key", "neighbour").alias("vec_a"), F.greatest("key", "neighbour").alias("vec_b")).distinct()


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    units, enriched = _collections(spark, d)
    return _similar_pairs(units).unionByName(_similar_pairs(enriched))


_NEAREST_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS cosine FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, neighbour_id, round(cosine, 6) AS cosine, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, CAST(neighbour_id AS VARCHAR)) AS INTEGER) AS rank FROM s QUALIFY rank <= 5
"""


@query("p4_neighbours", _NEAREST_SQL)
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors, at any cosine, of every embedding whose vec_id is divisible by 100, against all."""
    near = similar.similar(table(spark, d, "embeddings"), "vec_id", "embedding", DIM, NEIGHBOURS, probes=None, asks=F.col("vec_id") % 100 == 0)
    return near.select(F.col("key").cast("long").alias("vec_id"), F.col("neighbour").cast("long").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


# -- problem 5: look-alike characters


def _lookalikes(spark: SparkSession, d: str) -> DataFrame:
    units = lookalikes.find_lookalikes(table(spark, d, "law_units"), F.col("id"), "content").select(F.lit("law_units").alias("table_name"), "*")
    forms = lookalikes.find_lookalikes(table(spark, d, "raw_entities"), F.col("entity_id").cast("string"), "surface_form")
    return units.unionByName(forms.select(F.lit("raw_entities").alias("table_name"), "*"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _lookalikes(spark, d).select("table_name", "row_key").distinct()


@query("p5_normalized")
def p5_normalized(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every record that is not ordinary throughout."""
    return _lookalikes(spark, d)


# -- problem 8: containers

CAPACITY = 4096


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, d, "documents"), "doc_id", "text"), CAPACITY)


@query("p8_packed")
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("key", "doc_id")


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d), CAPACITY)


@query("p8_invariants", f"""SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_cut_needlessly, CAST(0 AS BIGINT) AS n_gaps,
  true AS near_least FROM (SELECT DISTINCT doc_id FROM documents)""")
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: every ruling and each of its tokens is in one container, none of which holds more than
    its capacity; only rulings beyond the capacity are cut, into pieces that follow each other; and the containers are
    within 1 % (and 8) of the least number that could hold the tokens."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    packed = packing.materialize(packing.pack(packing.count_tokens(docs, "doc_id", "text"), CAPACITY), "packed")
    return packing.invariants(docs.select(F.col("doc_id").alias("key")), packed, CAPACITY)


# -- problem 9: evaluation items in the corpus


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("key").alias("doc_id"), F.col("item_key").alias("item_id"))


@query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item the number of rulings it leaked into and the longest run of its words found."""
    return _leaks(spark, d).groupBy(F.col("item_key").alias("item_id")).agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))


_RUNS_SQL = """
WITH d AS (SELECT DISTINCT doc_id AS k, regexp_extract_all(lower(strip_accents(regexp_replace(text, '[\\x{AD}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}]', '', 'g'))), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id AS k, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT k, n, array_to_string(ws[n:n + 11], ' ') AS run FROM (SELECT k, ws, unnest(range(1, len(ws) - 10)) AS n FROM d)),
iw AS (SELECT k, n, array_to_string(ws[n:n + 11], ' ') AS run FROM (SELECT k, ws, unnest(range(1, len(ws) - 10)) AS n FROM i)),
m AS (SELECT dw.k AS d, iw.k AS i, dw.n AS n, dw.n - iw.n AS diagonal FROM dw JOIN iw USING (run)),
g AS (SELECT *, n - row_number() OVER (PARTITION BY d, i, diagonal ORDER BY n) AS island FROM (SELECT DISTINCT * FROM m)),
r AS (SELECT d, i, count(*) + 11 AS n_words FROM g GROUP BY d, i, diagonal, island)
"""


@query("p9_stored", _RUNS_SQL + "SELECT d AS doc_id, i AS item_id, max(n_words) AS n_words FROM r GROUP BY d, i")
def p9_stored(spark: SparkSession, d: str) -> DataFrame:
    """What leaked into the rulings as they are stored, without restoring any, and the most words in a row."""
    found = leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", restored=False)
    return found.select(F.col("key").alias("doc_id"), F.col("item_key").alias("item_id"), "n_words")


# -- problem 10: wrong encodings


def _restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore_documents(table(spark, d, "documents"), "doc_id", "text")


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select(F.col("key").alias("doc_id")).distinct()


@query("p10_restored")
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The restored text of every ruling of which something was decoded wrongly."""
    return _restored(spark, d).select(F.col("key").alias("doc_id"), "restored")
