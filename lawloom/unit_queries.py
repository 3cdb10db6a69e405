"""Queries of the operators on units, graph, points and retrieval, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.functions import scalar
from lawloom.operators import enrich, entities, graph, parse, reconcile, references, retrieval
from lawloom.queries import query
from lawloom.session import materialize
from lawloom.sources.corpus import clean, split_lines
from lawloom.sources.store import upserted
from lawloom.sources.tables import table

ACT = r"^(a\d+)_"
NS = scalar.NAMESPACE


def _round(c: Column) -> Column:
    return F.round(c, 6)


# -- lines, markers, units: the content of law_units in order is the text of its file

# The same markers and citation forms as in the operators, in the dialect of the other engine, whose classes
# of spaces and digits have to be written out; the constants are theirs.
SP = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
N = r"\p{Nd}+(?:\.\p{Nd}+)?"
RE2 = {
    "CHAPTER": rf"(?i)^(CAPITOLUL|TITLUL){SP}+([IVXLCDM]+)(?::{SP}*(.*))?",
    "SECTION": rf"(?i)^SEC[TȚ]IUNEA{SP}+(?:nr\.{SP}*)?(\p{{Nd}}+|a{SP}+[a-z0-9-]+-a)(?:{SP}*(.*))?",
    "ARTICLE": rf"(?i)^Art\.{SP}*({N})\.?{SP}*(.*)",
    "PARAGRAPH": rf"^\(({N})\){SP}*(.*)",
    "LETTER": rf"^([a-z])\){SP}*(.*)",
    "NUMBERED": rf"^({N})\.{SP}*(.*?)(?:{SP}*-{SP}*(.*))?$",
}
LINES_SQL = f"""
lines AS (SELECT coalesce(source_file, regexp_extract(id, '{ACT}', 1)) AS file, unit_seq AS line_no,
            translate(trim(content, chr(13) || chr(10) || ' '), 'şţŞŢ', 'șțȘȚ') AS line FROM law_units WHERE content IS NOT NULL),
lexed AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in RE2.items())} ELSE 'TEXT' END AS token FROM lines WHERE length(line) > 0)
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units").where(F.col("content").isNotNull())
    file = F.coalesce("source_file", F.regexp_extract("id", ACT, 1)).alias("file")
    return u.select(file, F.col("unit_seq").alias("line_no"), clean(F.col("content")).alias("line")).where(F.length("line") > 0)


@query("s03_p01_p02_lines", """
SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(DISTINCT line) AS n_distinct FROM (
  SELECT translate(trim(l, chr(13) || chr(10) || ' '), 'şţŞŢ', 'șțȘȚ') AS line FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS l FROM documents)) WHERE length(line) > 0""")  # fmt: skip
def lines(spark: SparkSession, d: str) -> DataFrame:
    t = split_lines(table(spark, d, "documents"), "doc_id", "text")
    return t.agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.countDistinct("line").alias("n_distinct"))


@query("p03_tokens", f"WITH {LINES_SQL} SELECT token, count(*) AS n FROM lexed GROUP BY token")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return parse.lex(_lines(spark, d)).groupBy("token").agg(F.count("*").alias("n"))


_OVER = "OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
UNITS_SQL = f"""WITH {LINES_SQL},
g AS (SELECT *, CASE token WHEN 'CHAPTER' THEN regexp_extract(line, '{RE2["CHAPTER"]}', 2) WHEN 'SECTION' THEN regexp_extract(line, '{RE2["SECTION"]}', 1) WHEN 'ARTICLE' THEN regexp_extract(line, '{RE2["ARTICLE"]}', 1)
        WHEN 'PARAGRAPH' THEN regexp_extract(line, '{RE2["PARAGRAPH"]}', 1) WHEN 'LETTER' THEN regexp_extract(line, '{RE2["LETTER"]}', 1) WHEN 'NUMBERED' THEN regexp_extract(line, '{RE2["NUMBERED"]}', 1) END AS num,
        CASE token WHEN 'CHAPTER' THEN coalesce(nullif(regexp_extract(line, '{RE2["CHAPTER"]}', 3), ''), line) WHEN 'SECTION' THEN coalesce(nullif(regexp_extract(line, '{RE2["SECTION"]}', 2), ''), line) END AS title FROM lexed),
c AS (SELECT *, replace(num, '.', '_') AS u, last_value(CASE WHEN token = 'CHAPTER' THEN 'cap_' || num END IGNORE NULLS) {_OVER} AS chapter FROM g),
s AS (SELECT *, nullif(last_value(CASE token WHEN 'SECTION' THEN coalesce(chapter || '_sec_', 'sec_') || replace(num, ' ', '_') WHEN 'CHAPTER' THEN '' END IGNORE NULLS) {_OVER}, '') AS section FROM c),
a AS (SELECT *, nullif(last_value(CASE WHEN token = 'ARTICLE' THEN 'art_' || u WHEN token IN ('CHAPTER', 'SECTION') THEN '' END IGNORE NULLS) {_OVER}, '') AS article FROM s),
p AS (SELECT *, nullif(last_value(CASE WHEN token = 'PARAGRAPH' THEN coalesce(article, 'None') || '_alin_' || u WHEN token IN ('CHAPTER', 'SECTION', 'ARTICLE') THEN '' END IGNORE NULLS) {_OVER}, '') AS paragraph,
        sum(CASE WHEN token <> 'TEXT' THEN 1 ELSE 0 END) {_OVER} AS seq FROM a),
h AS (SELECT *, CASE token WHEN 'CHAPTER' THEN chapter WHEN 'SECTION' THEN section WHEN 'ARTICLE' THEN article WHEN 'PARAGRAPH' THEN paragraph
         WHEN 'LETTER' THEN coalesce(paragraph, article, 'None') || '_lit_' || num WHEN 'NUMBERED' THEN coalesce(article, 'anexa') || '_pct_' || u END AS key,
        CASE token WHEN 'SECTION' THEN chapter WHEN 'ARTICLE' THEN coalesce(section, chapter) WHEN 'PARAGRAPH' THEN article WHEN 'LETTER' THEN coalesce(paragraph, article) WHEN 'NUMBERED' THEN coalesce(paragraph, article) END AS up,
        CASE token WHEN 'CHAPTER' THEN 'chapter' WHEN 'SECTION' THEN 'section' WHEN 'ARTICLE' THEN 'article' WHEN 'PARAGRAPH' THEN 'paragraph' WHEN 'LETTER' THEN 'letter_item' WHEN 'NUMBERED' THEN 'num_item' END AS kind FROM p WHERE seq > 0),
units AS (SELECT file, CAST(seq AS BIGINT) AS unit_seq, max(key) AS id, max(up) AS parent_id, max(kind) AS unit_type, max(title) AS title, max(CASE WHEN token <> 'CHAPTER' AND token <> 'LETTER' THEN CASE WHEN token = 'SECTION' THEN replace(num, ' ', '_') ELSE num END END) AS number,
        max(CASE WHEN token = 'LETTER' THEN num END) AS letter, string_agg(line, ' ' ORDER BY line_no) AS content FROM h GROUP BY file, seq)
"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_lines(_lines(spark, d))


@query("w01_units", UNITS_SQL + "SELECT file, unit_seq, id, parent_id, unit_type, content, title, number, letter FROM units")
def units(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    return u.select(F.col("source_file").alias("file"), "unit_seq", "id", "parent_id", "unit_type", "content", *[F.col("meta_info")[k].alias(k) for k in ("title", "number", "letter")])


@query("a01_units_by_type", UNITS_SQL + "SELECT unit_type, count(*) AS n FROM units GROUP BY unit_type")
def units_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).groupBy("unit_type").agg(F.count("*").alias("n"))


@query("k01_last_wins", UNITS_SQL + "SELECT id, max_by(content, (file, unit_seq)) AS content FROM units GROUP BY id")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return parse.last_wins(_units(spark, d)).select("id", "content")


@query("a11_duplicates", UNITS_SQL + "SELECT id, count(*) AS n FROM units GROUP BY id HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return parse.duplicates(_units(spark, d))


@query("p18_rejected", """SELECT count(*) AS n FROM law_units WHERE id IS NULL OR content IS NULL OR unit_type IS NULL
  OR unit_type NOT IN ('chapter', 'section', 'article', 'prologue', 'paragraph', 'letter_item', 'num_item')""")  # fmt: skip
def rejected(spark: SparkSession, d: str) -> DataFrame:
    return parse.rejected(table(spark, d, "law_units")).agg(F.count("*").alias("n"))


# -- relational store

@query("s05_unit_get", "SELECT id, parent_id, unit_type, content FROM law_units WHERE id = 'a12_art_5'")
def unit_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_units").where(F.col("id") == "a12_art_5").select("id", "parent_id", "unit_type", "content")


@query("s06_children", """
WITH top AS (SELECT parent_id FROM law_units WHERE parent_id IS NOT NULL GROUP BY parent_id ORDER BY count(DISTINCT id) DESC, parent_id LIMIT 1)
SELECT DISTINCT parent_id, id, unit_type FROM law_units WHERE parent_id IN (SELECT parent_id FROM top)""")  # fmt: skip
def children(spark: SparkSession, d: str) -> DataFrame:
    """The children of the unit that has most."""
    units = table(spark, d, "law_units").where(F.col("parent_id").isNotNull()).select("parent_id", "id", "unit_type").distinct()
    top = units.groupBy("parent_id").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "parent_id").limit(1)
    return units.join(F.broadcast(top.select("parent_id")), "parent_id")  # one row


@query("s07_ids", "SELECT DISTINCT id FROM law_units")
def ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "law_units").select("id").distinct()


@query("s08_point_units", "SELECT DISTINCT unit_id FROM points WHERE unit_id IS NOT NULL")
def point_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points").select("unit_id").where(F.col("unit_id").isNotNull()).distinct()


@query("s10_j10_fetch", "SELECT DISTINCT id, unit_type FROM law_units WHERE id IN (SELECT target_id FROM e_references)")
def fetch(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "e_references").select(F.col("target_id").alias("id")).distinct()
    return table(spark, d, "law_units").select("id", "unit_type").join(wanted, "id", "left_semi").distinct()


@query("j02_parent_join", "SELECT DISTINCT c.id, c.unit_type, p.unit_type AS parent_type FROM law_units c LEFT JOIN law_units p ON c.parent_id = p.id")
def parent_join(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units").select("id", "parent_id", "unit_type").distinct()
    up = u.select(F.col("id").alias("parent_id"), F.col("unit_type").alias("parent_type"))
    return u.join(up, "parent_id", "left").select("id", "unit_type", "parent_type")


@query("k01_j11_upsert", """
WITH n AS (SELECT unit_id AS id, max_by([content], (indexed_at, point_id))[1] AS content FROM points WHERE vector_type = 'content' AND unit_id IS NOT NULL GROUP BY unit_id),
c AS (SELECT id, max_by([content], (loaded_at, unit_seq))[1] AS content FROM law_units WHERE id IS NOT NULL GROUP BY id)
SELECT id, content FROM c WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, content FROM n""")  # fmt: skip
def upsert(spark: SparkSession, d: str) -> DataFrame:
    def latest(t: DataFrame, key: str, *order: str) -> DataFrame:
        return t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max_by(F.struct("content"), F.struct(*order)).alias("m")).select("id", "m.content")

    now = latest(table(spark, d, "law_units"), "id", "loaded_at", "unit_seq")
    new = latest(table(spark, d, "points").where(F.col("vector_type") == "content"), "unit_id", "indexed_at", "point_id")
    return upserted(now, new, "id")


@query("w04_t07_batches", "SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS batch FROM (SELECT DISTINCT id FROM law_units)")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.numbered_batches(table(spark, d, "law_units").select("id").distinct(), 50)


@query("k18_k19_outbox", """SELECT CAST(batch AS BIGINT) AS batch_id, 'ingest_vectors' AS task, count(*) AS n_units, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT id, floor((row_number() OVER (ORDER BY id) - 1) / 50) AS batch FROM (SELECT DISTINCT id FROM law_units WHERE id NOT IN (SELECT unit_id FROM points WHERE unit_id IS NOT NULL))) GROUP BY batch""")  # fmt: skip
def outbox(spark: SparkSession, d: str) -> DataFrame:
    units, points = table(spark, d, "law_units").select("id"), table(spark, d, "points").select(F.col("unit_id").alias("id"))
    lost = reconcile.drift(units, points, units).where(F.col("store") == "vector")
    m = reconcile.messages(lost, "ingest_vectors", 50)
    return m.select("batch_id", "task", F.size("unit_ids").cast("long").alias("n_units"), F.array_min("unit_ids").alias("first_id"), F.array_max("unit_ids").alias("last_id"))


@query("k20_cascade", """
WITH RECURSIVE u AS (SELECT DISTINCT id, parent_id FROM law_units), gone AS (
  SELECT DISTINCT id FROM u WHERE id IN (SELECT removed_id FROM removals WHERE table_name = 'law_units') AND id NOT IN (SELECT id FROM u WHERE parent_id = id)
  UNION SELECT u.id FROM u JOIN gone ON u.parent_id = gone.id) SELECT id FROM gone""")  # fmt: skip
def cascade(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "law_units")
    removed = table(spark, d, "removals").where(F.col("table_name") == "law_units").select(F.col("removed_id").alias("id"))
    return graph.cascade(units, removed)


# -- graph

@query("g01_p08_part_of", "SELECT DISTINCT id AS child_id, parent_id FROM law_units WHERE parent_id IS NOT NULL AND parent_id <> ''")
def part_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.part_of(table(spark, d, "law_units")).distinct()


_INT = rf"art\.{SP}*{N}{SP}*-{SP}*{N}|art\.{SP}*{N}{SP}*alin\.{SP}*\([a-z0-9.]+\)|art\.{SP}*{N}|alin\.{SP}*\([a-z0-9.]+\)"
REFS_SQL = f"""
WITH m AS (SELECT id, regexp_extract(id, '{ACT}', 1) AS act, unnest(regexp_extract_all(content, '(?i){_INT}')) AS m FROM law_units),
t AS (SELECT id, act, CASE
    WHEN regexp_matches(m, '(?i)^art\\.{SP}*{N}{SP}*-{SP}*{N}$') THEN ['art_' || replace(regexp_extract(m, '(?i)^art\\.{SP}*({N})', 1), '.', '_'), 'art_' || replace(regexp_extract(m, '-{SP}*({N})$', 1), '.', '_')]
    WHEN regexp_matches(m, '(?i)^art\\.{SP}*{N}{SP}*alin') THEN ['art_' || replace(regexp_extract(m, '(?i)^art\\.{SP}*({N})', 1), '.', '_') || '_alin_' || replace(regexp_extract(m, '\\(([^)]*)\\)$', 1), '.', '_')]
    WHEN regexp_matches(m, '(?i)^art') THEN ['art_' || replace(regexp_extract(m, '(?i)^art\\.{SP}*({N})', 1), '.', '_')]
    WHEN regexp_extract(substr(id, length(act) + 2), '^(art_[0-9]+(?:_[0-9]+)?)', 1) <> '' THEN [regexp_extract(substr(id, length(act) + 2), '^(art_[0-9]+(?:_[0-9]+)?)', 1) || '_alin_' || replace(regexp_extract(m, '\\(([^)]*)\\)$', 1), '.', '_')]
    ELSE [] END AS ts FROM m),
refs AS (SELECT DISTINCT id AS source_id, act || '_' || x AS target_id FROM (SELECT id, act, unnest(ts) AS x FROM t) WHERE id <> act || '_' || x)
"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    return references.internal_references(table(spark, d, "law_units"), F.regexp_extract("id", ACT, 1)).distinct()


@query("g02_internal_references", REFS_SQL + "SELECT source_id, target_id FROM refs")
def internal_references(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


@query("j01_existing_edges", REFS_SQL + "SELECT source_id, target_id FROM refs WHERE target_id IN (SELECT id FROM law_units)")
def existing_edges(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units")
    return graph.existing(_references(spark, d), "source_id", u, "id", "target_id", u, "id")


@query("j01_dangling_edges", REFS_SQL + "SELECT source_id, target_id, 'target' AS missing FROM refs WHERE target_id NOT IN (SELECT id FROM law_units)")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units")
    return graph.dangling(_references(spark, d), "source_id", u, "id", "target_id", u, "id")


_EXT = rf"(Legea|Ordonan[tț][aă](?:{SP}+Guvernului|{SP}+de{SP}+urgen[tț][aă])?|Regulamentul{SP}*\(UE\)){SP}+nr\.{SP}*(\p{{Nd}}+/\p{{Nd}}{{4}})"
EXT_SQL = f"""
WITH m AS (SELECT id, unnest(regexp_extract_all(content, '(?i){_EXT}')) AS m FROM law_units),
t AS (SELECT id, trim(regexp_extract(m, '(?i){_EXT}', 1)) AS kind, regexp_extract(m, '(?i){_EXT}', 2) AS num FROM m),
e AS (SELECT id, num, replace(array_to_string(list_transform(string_split(lower(kind), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '(ue)', '(Ue)') AS law_type FROM t),
ext AS (SELECT id AS source_unit_id, lower(regexp_extract(law_type, '^(\\S+)', 1)) || '_' || replace(num, '/', '_') AS target_external_id, law_type || ' nr. ' || num AS name, law_type FROM e)
"""


@query("g03_external_references", EXT_SQL + "SELECT DISTINCT source_unit_id, target_external_id, name, law_type FROM ext")
def external_references(spark: SparkSession, d: str) -> DataFrame:
    return references.external_references(table(spark, d, "law_units")).distinct()


@query("k12_externals", EXT_SQL + ", v AS (SELECT target_external_id AS id, max((name, law_type)) AS m FROM ext GROUP BY 1) SELECT coalesce(v.id, o.id) AS id, coalesce(v.m[1], o.name) AS name, CASE WHEN v.id IS NULL THEN o.law_type ELSE v.m[2] END AS law_type FROM v FULL JOIN v_external o ON v.id = o.id")
def externals(spark: SparkSession, d: str) -> DataFrame:
    new = references.external_references(table(spark, d, "law_units")).select(F.col("target_external_id").alias("id"), "name", "law_type")
    return graph.merge_externals(table(spark, d, "v_external"), new)


_MEN = """
WITH c AS (SELECT name, unnest(list_distinct(surface_forms)) AS f FROM v_concept),
m AS (SELECT source_unit_id, name, surface_form, min(ord) AS o FROM raw_entities r JOIN c ON r.surface_form = c.f WHERE source_unit_id IS NOT NULL GROUP BY ALL)
"""


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "v_concept").select(F.col("name").alias("target_concept_name"), F.explode(F.array_distinct("surface_forms")).alias("surface_form"))
    raw = table(spark, d, "raw_entities").where(F.col("source_unit_id").isNotNull()).join(c, "surface_form")
    return graph.merge_mentions(raw.select("source_unit_id", "target_concept_name", F.col("surface_form").alias("extracted_text"), "ord"))


@query("j03_k15_mentions", _MEN + "SELECT source_unit_id, name AS target_concept_name, array_to_string(list(surface_form ORDER BY o, surface_form), '|') AS texts FROM m GROUP BY 1, 2")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("source_unit_id", "target_concept_name", F.array_join("extracted_texts", "|").alias("texts"))


@query("k10_a09_concepts", """
WITH f AS (SELECT name, unnest(surface_forms) AS f FROM v_concept UNION SELECT c.name, r.surface_form FROM raw_entities r JOIN v_concept c ON lower(trim(r.surface_form)) = c.name)
SELECT name, array_to_string(list_sort(list(DISTINCT f)), '|') AS forms FROM f GROUP BY name""")  # fmt: skip
def concepts(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "v_concept").select("name", "surface_forms")
    raw = table(spark, d, "raw_entities").select(F.lower(F.trim("surface_form")).alias("name"), F.array("surface_form").alias("surface_forms")).distinct()
    return graph.merge_concepts(old, raw.join(old.select("name"), "name", "left_semi")).select("name", F.array_join("surface_forms", "|").alias("forms"))


@query("g07_k_hop", """
WITH RECURSIVE e AS (SELECT DISTINCT id AS src, parent_id AS dst FROM law_units WHERE parent_id IS NOT NULL),
s AS (SELECT DISTINCT id FROM law_units WHERE unit_type = 'num_item'), w AS (SELECT id AS start, id, 0 AS hops FROM s UNION SELECT w.start, e.dst, w.hops + 1 FROM w JOIN e ON w.id = e.src WHERE w.hops < 3)
SELECT start, id, min(hops) AS hops FROM w GROUP BY start, id""")  # fmt: skip
def k_hop(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "law_units")
    edges = graph.part_of(u).select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("PART_OF").alias("type"))
    return graph.k_hop(u.where(F.col("unit_type") == "num_item").select("id"), edges, 3, ("PART_OF",))


@query("g08_concept_walk", _MEN + """SELECT DISTINCT u.id, count(DISTINCT m.name) AS n_concepts FROM (SELECT DISTINCT id FROM law_units) u JOIN m ON m.source_unit_id = u.id
  GROUP BY u.id""")  # fmt: skip
def concept_walk(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "v_concept").select("name")
    return graph.concept_walk(names, _mentions(spark, d), table(spark, d, "law_units")).select("id", "n_concepts").distinct()


# -- entities

@query("a03_t06_dominant_category", """
WITH n AS (SELECT surface_form, category_label, count(*) AS n, min(ord) AS o FROM raw_entities WHERE surface_form IS NOT NULL GROUP BY ALL)
SELECT surface_form, coalesce(arg_max(category_label, (n, -o)) FILTER (category_label IS NOT NULL), 'General') AS category_label FROM n GROUP BY surface_form""")  # fmt: skip
def dominant_category(spark: SparkSession, d: str) -> DataFrame:
    return entities.dominant_categories(table(spark, d, "raw_entities"))


@query("a05_a06_canonical_names", """
WITH f AS (SELECT DISTINCT concept_id, unnest(surface_forms) AS f FROM v_concept)
SELECT concept_id, arg_min(f, (length(f), f)) AS name, count(*) AS n_forms FROM f GROUP BY concept_id""")  # fmt: skip
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "v_concept").select(F.lit(0).cast("long").alias("batch_id"), F.col("concept_id").cast("int").alias("label"), F.explode("surface_forms").alias("surface_form")).distinct()
    return entities.concepts(f).select(F.col("label").cast("long").alias("concept_id"), "name", F.size("surface_forms").cast("long").alias("n_forms"))


@query("a07_j04_categories", """
WITH n AS (SELECT surface_form, category_label, count(*) AS n, min(ord) AS o FROM raw_entities WHERE surface_form IS NOT NULL GROUP BY ALL),
m AS (SELECT surface_form, coalesce(arg_max(category_label, (n, -o)) FILTER (category_label IS NOT NULL), 'General') AS c FROM n GROUP BY surface_form)
SELECT DISTINCT name AS source_concept_name, coalesce(c, 'General') AS target_category_name FROM v_concept LEFT JOIN m ON name = surface_form""")  # fmt: skip
def belongs_to(spark: SparkSession, d: str) -> DataFrame:
    main = entities.dominant_categories(table(spark, d, "raw_entities")).withColumnRenamed("surface_form", "name")
    return table(spark, d, "v_concept").select("name").join(main, "name", "left").select(F.col("name").alias("source_concept_name"), F.coalesce("category_label", F.lit(entities.GENERAL)).alias("target_category_name")).distinct()


@query("p12_m07_f19_gazetteer", """
WITH p AS (SELECT DISTINCT lower(trim(f)) AS s, label, list_filter(regexp_split_to_array(lower(f), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ps FROM
  (SELECT unnest(list_append(surface_forms, name)) AS f, name AS label FROM v_concept UNION ALL SELECT name, coalesce(law_type, 'Act') FROM v_external)),
lengths AS (SELECT DISTINCT len(ps) AS n FROM p WHERE len(ps) > 0),
u AS (SELECT DISTINCT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM law_units WHERE content IS NOT NULL),
r AS (SELECT id, n, ws, unnest(range(1, greatest(1, len(ws) - n + 1) + 1)) AS ord FROM u, lengths WHERE len(ws) > 0)
SELECT DISTINCT s AS surface_form, label AS category_label, id AS source_unit_id, ord FROM (SELECT id, ord, array_to_string(ws[ord:ord + n - 1], ' ') AS run FROM r) JOIN p ON run = array_to_string(ps, ' ')""")  # fmt: skip
def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """All names and known spellings of concepts, and all names of external laws, wherever the units have them."""
    c, e = table(spark, d, "v_concept"), table(spark, d, "v_external")
    phrases = c.select(F.explode(F.array_append("surface_forms", F.col("name"))).alias("phrase"), F.col("name").alias("label"))
    phrases = phrases.unionByName(e.select(F.col("name").alias("phrase"), F.coalesce("law_type", F.lit("Act")).alias("label")))
    return entities.gazetteer_entities(table(spark, d, "law_units"), phrases)


@query("m08_hdbscan")
def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the forms of each message's units."""
    raw = table(spark, d, "raw_entities").where(F.col("source_unit_id").isNotNull() & F.col("surface_form").isNotNull())
    of = reconcile.numbered_batches(raw.select(F.col("source_unit_id").alias("id")).distinct(), 50)
    forms = raw.select(F.col("source_unit_id").alias("id"), "surface_form").join(of, "id").select(F.col("batch").alias("batch_id"), "surface_form").distinct()
    return entities.cluster_batches(enrich.embed(forms, "surface_form", "vector", enrich.hash_embedder(64)))


# -- points and enrichment

@query("k05_u05_points", f"""
WITH e AS (SELECT DISTINCT * FROM law_unit_enriched), q AS (SELECT id, unit_type, hypothetical_questions AS t, question_vectors AS v, unnest(range(0, least(len(hypothetical_questions), len(question_vectors)))) AS n FROM e),
p AS (SELECT id || '_content' AS k, id, unit_type, 'content' AS vector_type, NULL AS question_text, len(content_vector) AS size FROM e WHERE len(content_vector) > 0
      UNION ALL SELECT id || '_question_' || n, id, unit_type, 'question', t[n + 1], len(v[n + 1]) FROM q WHERE v[n + 1] IS NOT NULL),
s AS (SELECT *, sha1(from_hex('{NS}') || encode(k)) AS h FROM p)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '1' THEN '9' WHEN '2' THEN 'a' WHEN '3' THEN 'b' WHEN '4' THEN '8' WHEN '5' THEN '9' WHEN '6' THEN 'a' WHEN '7' THEN 'b'
   WHEN '8' THEN '8' WHEN '9' THEN '9' WHEN 'a' THEN 'a' WHEN 'b' THEN 'b' WHEN 'c' THEN '8' WHEN 'd' THEN '9' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
   id AS unit_id, unit_type, vector_type, question_text, CAST(size AS INTEGER) AS size FROM s""")  # fmt: skip
def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "law_unit_enriched")
    whole = e.dropDuplicates(["id"])
    return enrich.to_points(whole).select("point_id", "unit_id", "unit_type", "vector_type", "question_text", F.size("dense").alias("size"))


@query("p04_p05_m01_enriched", """
WITH u AS (SELECT id, arg_max([unit_type], loaded_at)[1] AS unit_type, arg_max([content], loaded_at)[1] AS content FROM law_units WHERE id IS NOT NULL GROUP BY id),
c AS (SELECT id, coalesce(unit_type IN ('chapter', 'section'), false) AS header, trim(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) <> '' AS has_text, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ts FROM u WHERE content IS NOT NULL)
SELECT id, CASE WHEN header THEN 0 ELSE 3 END AS n_questions, CASE WHEN has_text THEN 64 END AS n_dense, CASE WHEN header THEN 0 ELSE 3 END AS n_question_vectors, CASE WHEN NOT header AND len(ts) > 0 THEN len(ts) END AS n_terms FROM c""")  # fmt: skip
def enriched(spark: SparkSession, d: str) -> DataFrame:
    u = parse.last_wins(table(spark, d, "law_units").select("id", "parent_id", "unit_type", "content", "meta_info", "loaded_at"), "loaded_at").where(F.col("content").isNotNull())
    out = enrich.enrich(u, enrich.hash_embedder(64))
    return out.select("id", F.size("hypothetical_questions").alias("n_questions"), F.size("content_vector").alias("n_dense"), F.size("question_vectors").alias("n_question_vectors"), F.size("sparse_vector.indices").alias("n_terms"))


@query("f20_t05_questions", """SELECT event_id, coalesce(json_extract_string(j, '$.questions[0]'), '') AS q1, CAST(least(3, coalesce(json_array_length(j, '$.questions'), 0)) AS INTEGER) AS n FROM (
  SELECT event_id, '{"questions": ["' || event_type || '", "b", "' || user_id || '", "d"]}' AS j FROM events)""")  # fmt: skip
def questions(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit('{"questions": ["'), "event_type", F.lit('", "b", "'), F.col("user_id").cast("string"), F.lit('", "d"]}'))
    q = table(spark, d, "events").select("event_id", scalar.questions_of(answer).alias("q"))
    return q.select("event_id", F.coalesce(F.get("q", F.lit(0)), F.lit("")).alias("q1"), F.size("q").alias("n"))


_TERMS = "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ts FROM documents WHERE text IS NOT NULL"
BM25_SQL = f"""
WITH d AS ({_TERMS}), t AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT doc_id, term, tf, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / 256)) AS weight FROM tf),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(DISTINCT doc_id) FROM w) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM w GROUP BY term),
sparse AS (SELECT doc_id, sum(weight * idf) AS score FROM w JOIN idf USING (term) WHERE term IN ('recursul', 'semaforul', 'defect', 'court') GROUP BY doc_id),
st AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sparse QUALIFY rank <= 10)
"""
TEXT = "Recursul: semaforul defect, court"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return enrich.term_weights(table(spark, d, "documents"), "doc_id", "text")


@query("a15_m05_weights", BM25_SQL + "SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS total FROM w GROUP BY doc_id")
def weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_terms"), _round(F.sum("weight")).alias("total"))


@query("a14_frequencies", BM25_SQL + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return enrich.inverse_frequencies(_weights(spark, d)).select("term", "df", _round(F.col("idf")).alias("idf"))


# -- retrieval

def _vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


DENSE_SQL = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q),
dt AS (SELECT vec_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dense QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, d: str, filters: dict[str, str] | None = None) -> DataFrame:
    return retrieval.dense_top(retrieval.filtered(table(spark, d, "embeddings"), filters or {}), _vector(spark, d), 10, "vec_id", "embedding")


@query("t02_f23_dense_top", f"WITH {DENSE_SQL} SELECT vec_id, round(score, 6) AS score, rank FROM dt")
def dense_top(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("vec_id", _round(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("p14_dense_filtered", f"WITH {DENSE_SQL} SELECT vec_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS BIGINT) AS rank FROM dense WHERE label = 3 QUALIFY rank <= 10")
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, {"label": 3}).select("vec_id", _round(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t03_m06_sparse_top", BM25_SQL + "SELECT doc_id, round(score, 6) AS score, rank FROM st")
def sparse_top(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_top(_weights(spark, d), TEXT, 10, n=enrich.documents_with_terms(table(spark, d, "documents"), "text")).select(F.col("key").alias("doc_id"), _round(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


_HYBRID_SQL = """
WITH u AS (SELECT id, arg_max([unit_type], loaded_at)[1] AS unit_type, arg_max([content], loaded_at)[1] AS content, arg_max([embedding], loaded_at)[1] AS e FROM law_units WHERE id IS NOT NULL GROUP BY id),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT id, CAST(e AS DOUBLE[]) AS v FROM u WHERE unit_type = 'paragraph' AND len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
dt AS (SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(v, q), 9) DESC, id) AS rank FROM v, q QUALIFY rank <= 10),
t AS (SELECT id, unit_type, len(ts) AS dl, unnest(ts) AS term FROM (SELECT id, unit_type, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ts FROM u WHERE content IS NOT NULL)),
w AS (SELECT id, unit_type, term, count(*) * 2.2e0 / (count(*) + 1.2e0 * (0.25e0 + 0.75e0 * dl / 256)) AS weight FROM t GROUP BY id, unit_type, dl, term),
idf AS (SELECT term, ln(1 + ((SELECT count(DISTINCT id) FROM w) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM w GROUP BY term),
s AS (SELECT id, sum(weight * idf) AS score FROM w JOIN idf USING (term) WHERE unit_type = 'paragraph' AND term IN ('remorca', 'albastră', 'semaforul', 'art') GROUP BY id),
st AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10),
f AS (SELECT id, sum(1 / (rank - 1 + 2.0e0)) AS fusion FROM (SELECT * FROM dt UNION ALL SELECT * FROM st) GROUP BY id)
"""


def _points_of_units(spark: SparkSession, d: str) -> DataFrame:
    """Units as points: their own vectors, and sparse vectors of their content."""
    u = parse.last_wins(table(spark, d, "law_units").select("id", "parent_id", "unit_type", "content", "embedding", "loaded_at").where(F.col("id").isNotNull()), "loaded_at")
    sparse = enrich.sparse_vectors(enrich.term_weights(u.where(F.col("content").isNotNull()), "id", "content")).withColumnRenamed("key", "id")
    return u.join(sparse, "id", "left").select(
        F.col("id").alias("point_id"), F.col("id").alias("unit_id"), "unit_type", F.lit("content").alias("vector_type"), "content", F.lit(None).cast("string").alias("question_text"), "parent_id", F.col("embedding").alias("dense"), "sparse"
    )


@query("p15_r02_j09_hybrid", _HYBRID_SQL + "SELECT id AS unit_id, round(fusion, 6) AS fusion_score FROM f ORDER BY fusion DESC, id LIMIT 5")
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    points = materialize(_points_of_units(spark, d), "points")
    request = retrieval.Request("Remorca albastră, semaforul: art", _vector(spark, d), {"unit_type": "paragraph"})
    return retrieval.HybridStrategy(points).search(request).select("unit_id", _round(F.col("fusion_score")).alias("fusion_score"))


@query("w03_batch_top", """
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def batch_top(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of a stated set, those whose vec_id is divisible by 100, among all."""
    e = table(spark, d, "embeddings")
    asked = [(r["vec_id"], r["embedding"]) for r in e.where(F.col("vec_id") % 100 == 0).select("vec_id", "embedding").orderBy("vec_id").toLocalIterator()]
    found = retrieval.nearest(e, asked, 5, "vec_id", "embedding")
    return found.select("query", F.col("vec_id").alias("key"), _round(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("p16_p17_console", """SELECT point_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS snippet FROM (SELECT point_id, coalesce(nullif(content, ''), question_text, '') AS t FROM points)""")
def console(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("question_text"), F.lit(""))
    return table(spark, d, "points").select("point_id", scalar.snippet(text).alias("snippet"))


# -- reconciliation

@query("j05_u03_missing_vector", "SELECT DISTINCT id FROM law_units WHERE id NOT IN (SELECT unit_id FROM points WHERE unit_id IS NOT NULL)")
def missing_vector(spark: SparkSession, d: str) -> DataFrame:
    u, p = table(spark, d, "law_units"), table(spark, d, "points").select(F.col("unit_id").alias("id"))
    return reconcile.drift(u, p, u).where(F.col("store") == "vector").select("id")


@query("j06_r06_drift", """
WITH r AS (SELECT DISTINCT id FROM law_units), v AS (SELECT DISTINCT unit_id AS id FROM points WHERE unit_id IS NOT NULL), g AS (SELECT DISTINCT source_id AS id FROM e_references WHERE source_id IS NOT NULL)
SELECT id, 'vector' AS store, 'missing' AS side FROM r WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'graph', 'missing' FROM r WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT id, 'vector', 'surplus' FROM v WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'graph', 'surplus' FROM g WHERE id NOT IN (SELECT id FROM r)""")  # fmt: skip
def drift(spark: SparkSession, d: str) -> DataFrame:
    p, g = table(spark, d, "points").select(F.col("unit_id").alias("id")), table(spark, d, "e_references").select(F.col("source_id").alias("id"))
    return reconcile.drift(table(spark, d, "law_units"), p, g, both_ways=True)


@query("a02_r05_stats", "SELECT 'relational' AS store, count(*) AS n FROM law_units UNION ALL SELECT 'vector', count(*) FROM points UNION ALL SELECT 'graph', (SELECT count(*) FROM v_concept) + (SELECT count(*) FROM v_external)")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.store_counts(table(spark, d, "law_units"), table(spark, d, "points"), {n: table(spark, d, n) for n in ("v_concept", "v_external")})
