"""Queries of the core and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import hierarchy, orphans, tablediff
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


# -- problem 3: differences between two copies

_COPIES_SQL = """
WITH l AS (SELECT id, arg_max(parent_id, k) AS parent_id, arg_max(unit_type, k) AS unit_type, arg_max(content, k) AS content FROM
             (SELECT id, [parent_id] AS parent_id, [unit_type] AS unit_type, [content] AS content, (loaded_at, unit_seq) AS k FROM law_units WHERE id IS NOT NULL) GROUP BY id),
r AS (SELECT unit_id, arg_max(parent_id, k) AS parent_id, arg_max(unit_type, k) AS unit_type, arg_max(content, k) AS content FROM
        (SELECT unit_id, [parent_id] AS parent_id, [unit_type] AS unit_type, [content] AS content, (indexed_at, point_id) AS k FROM points WHERE vector_type = 'content' AND unit_id IS NOT NULL) GROUP BY unit_id),
j AS (SELECT id, unit_id, l.parent_id[1] AS lp, r.parent_id[1] AS rp, l.unit_type[1] AS lt, r.unit_type[1] AS rt, l.content[1] AS lc, r.content[1] AS rc FROM l FULL JOIN r ON id = unit_id),
cells AS (
  SELECT id AS unit_id, 'only_law_units' AS diff, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM j WHERE unit_id IS NULL
  UNION ALL SELECT unit_id, 'only_points', NULL, NULL FROM j WHERE id IS NULL
  UNION ALL SELECT id, 'parent_id', lp, rp FROM j WHERE id IS NOT NULL AND unit_id IS NOT NULL AND lp IS DISTINCT FROM rp
  UNION ALL SELECT id, 'unit_type', lt, rt FROM j WHERE id IS NOT NULL AND unit_id IS NOT NULL AND lt IS DISTINCT FROM rt
  UNION ALL SELECT id, 'content', lc, rc FROM j WHERE id IS NOT NULL AND unit_id IS NOT NULL AND lc IS DISTINCT FROM rc)
"""


def _copies(spark: SparkSession, d: str) -> DataFrame:
    cells = tablediff.diff_tables(
        table(spark, d, "law_units"), table(spark, d, "points").where(F.col("vector_type") == "content"), "id", "unit_id",
        ["parent_id", "unit_type", "content"], ["loaded_at", "unit_seq"], ["indexed_at", "point_id"], "law_units", "points",
    )
    return cells.withColumnRenamed("key", "unit_id")


@query("p3_found", _COPIES_SQL + "SELECT unit_id, diff FROM cells")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).select("unit_id", "diff")


@query("p3_cells", _COPIES_SQL + "SELECT unit_id, diff, left_value, right_value FROM cells")
def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)


@query("p3_summary", _COPIES_SQL + "SELECT diff, count(*) AS n FROM cells GROUP BY diff")
def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).groupBy("diff").agg(F.count("*").alias("n"))


# -- problem 6: hierarchies

_TREE_SQL = """
WITH RECURSIVE nodes AS (SELECT id, arg_max([parent_id], loaded_at)[1] AS parent_id FROM law_units WHERE id IS NOT NULL GROUP BY id),
tree AS (
  SELECT id, id AS path, 0 AS depth, id AS root FROM nodes WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT n.id, t.path || '/' || n.id, t.depth + 1, t.root FROM nodes n JOIN tree t ON n.parent_id = t.id)
"""


@query(
    "p6_found",
    """
WITH RECURSIVE nodes AS (SELECT id, arg_max([parent_id], loaded_at)[1] AS parent_id FROM law_units WHERE id IS NOT NULL GROUP BY id),
tree AS (
  SELECT id FROM nodes WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM nodes)
  UNION ALL SELECT n.id FROM nodes n JOIN tree t ON n.parent_id = t.id),
u AS (SELECT id, parent_id FROM nodes WHERE id NOT IN (SELECT id FROM tree)),
reach AS (SELECT id, parent_id AS to_id FROM u UNION SELECT r.id, u.parent_id FROM reach r JOIN u ON r.to_id = u.id),
circle AS (SELECT r.id, min(r.to_id) AS cycle_key FROM reach r WHERE r.id IN (SELECT id FROM reach WHERE id = to_id) GROUP BY r.id)
SELECT u.id, any_value(c.cycle_key) AS cycle_key, CASE WHEN u.id IN (SELECT id FROM circle) THEN 'on' ELSE 'below' END AS kind
FROM u JOIN reach r ON r.id = u.id JOIN circle c ON c.id = r.to_id GROUP BY u.id
""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "law_units"), order_col="loaded_at", paths=False).cycles()


@query("p6_paths", _TREE_SQL + "SELECT id, path, depth, root FROM tree")
def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "law_units"), order_col="loaded_at").paths()


@query(
    "p6_descendants",
    _TREE_SQL
    + """, parts AS (SELECT id, string_split(path, '/') AS a FROM tree)
SELECT a[g.i] AS ancestor_id, id AS descendant_id, CAST(len(a) - g.i AS INTEGER) AS distance FROM parts, (SELECT unnest(range(1, 2000)) AS i) g WHERE g.i < len(a)""",
)
def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "law_units"), order_col="loaded_at").descendants()


# -- problem 7: orphan references

_ORPHANS_SQL = """
WITH p AS (SELECT 'law_units' AS t, id AS k, min(loaded_at) AS first_at FROM law_units WHERE id IS NOT NULL GROUP BY id
           UNION ALL SELECT 'v_external', id, min(first_seen_at) FROM v_external WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT ref_table, t, s, k, min(ts) AS ts FROM (
        SELECT 'e_references' AS ref_table, 'law_units' AS t, source_id AS s, target_id AS k, created_at AS ts FROM e_references
        UNION ALL SELECT 'law_units', 'law_units', id, parent_id, loaded_at FROM law_units
        UNION ALL SELECT 'e_refers_external', 'v_external', source_unit_id, target_external_id, created_at FROM e_refers_external) WHERE k IS NOT NULL GROUP BY ALL),
o AS (SELECT ref_table, s AS source_key, r.k AS target_key, r.ts, CASE WHEN p.k IS NOT NULL THEN 'late' WHEN m.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
      FROM r LEFT JOIN p USING (t, k) LEFT JOIN (SELECT DISTINCT table_name AS t, removed_id AS k FROM removals) m USING (t, k)
      WHERE p.k IS NULL OR p.first_at > r.ts)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "law_units")
    refs = (
        orphans.references(table(spark, d, "e_references"), "e_references", "source_id", "target_id", "created_at", "law_units")
        .unionByName(orphans.references(units, "law_units", "id", "parent_id", "loaded_at", "law_units"))
        .unionByName(orphans.references(table(spark, d, "e_refers_external"), "e_refers_external", "source_unit_id", "target_external_id", "created_at", "v_external"))
    )
    parents = orphans.records(units, "law_units", "id", "loaded_at").unionByName(orphans.records(table(spark, d, "v_external"), "v_external", "id", "first_seen_at"))
    removed = table(spark, d, "removals").select(F.col("table_name").alias("target_table"), F.col("removed_id").alias("target_key"))
    return orphans.find_orphans(refs, parents, removed)


@query("p7_found", _ORPHANS_SQL + "SELECT ref_table, source_key, target_key, reason FROM o")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "source_key", "target_key", "reason")


@query("p7_report", _ORPHANS_SQL + "SELECT ref_table, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, reason, count(*) AS n_refs, count(DISTINCT target_key) AS n_targets FROM o GROUP BY ALL")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))
