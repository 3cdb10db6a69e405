"""The layered graph: vertices, edges, their upserts, and walks over it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.operators.references import external_references, internal_references
from lawloom.session import materialize


@dataclass(frozen=True)
class Payload:
    """Four vertex and five edge tables; any may be None, which stands for empty."""

    law_units: DataFrame | None = None
    concepts: DataFrame | None = None
    categories: DataFrame | None = None
    externals: DataFrame | None = None
    references: DataFrame | None = None
    part_of: DataFrame | None = None
    mentions: DataFrame | None = None
    belongs_to: DataFrame | None = None
    refers_external: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}


def vertices(units: DataFrame) -> DataFrame:
    return units.select("id", "unit_type")


def part_of(units: DataFrame) -> DataFrame:
    return units.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != "")).select(F.col("id").alias("child_id"), "parent_id")


def skeleton(units: DataFrame, scope: Column | None = None) -> Payload:
    """The structural layer of a batch of units: vertices, part-of edges, citations."""
    ext = external_references(units)
    return Payload(
        law_units=vertices(units), part_of=part_of(units), references=internal_references(units, scope), externals=ext.select(F.col("target_external_id").alias("id"), "name", "law_type"),
        refers_external=ext.select("source_unit_id", "target_external_id"),
    )


def existing(edges: DataFrame, source: str, sources: DataFrame, source_key: str, target: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges both ends of which exist, each once: two semi joins, as only the vertices' keys matter."""
    a = sources.select(F.col(source_key).alias(source)).distinct()
    b = targets.select(F.col(target_key).alias(target)).distinct()
    return edges.distinct().join(a, source, "left_semi").join(b, target, "left_semi").select(*edges.columns)


def dangling(edges: DataFrame, source: str, sources: DataFrame, source_key: str, target: str, targets: DataFrame, target_key: str) -> DataFrame:
    """The edges that :func:`existing` leaves out, with the end that is missing."""
    a = sources.select(F.col(source_key).alias(source)).distinct().withColumn("has_source", F.lit(True))
    b = targets.select(F.col(target_key).alias(target)).distinct().withColumn("has_target", F.lit(True))
    all_ = edges.distinct().join(a, source, "left").join(b, target, "left").where(F.col("has_source").isNull() | F.col("has_target").isNull())
    which = F.when(F.col("has_source").isNull() & F.col("has_target").isNull(), "both").when(F.col("has_source").isNull(), "source").otherwise("target")
    return all_.select(*edges.columns, which.alias("missing"))


def united(new: DataFrame, old: DataFrame, source: str, target: str) -> DataFrame:
    """Edges of both tables, each pair of ends once; columns of lists hold the different values of both, old ones first."""
    lists = [c for c in new.columns if c not in (source, target)]
    every = old.select("*", F.lit(0).alias("_o")).unionByName(new.select("*", F.lit(1).alias("_o")))
    if not lists:
        return every.drop("_o").distinct()
    merged = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", c))), lambda x, c=c: x[c]))).alias(c) for c in lists]
    return every.groupBy(source, target).agg(*merged).select(*new.columns)


def merge_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices by id; the new type holds."""
    rows = old.select("id", "unit_type", F.lit(0).alias("o")).unionByName(new.select("id", "unit_type", F.lit(1).alias("o")))
    return rows.groupBy("id").agg(F.max_by("unit_type", F.struct("o", "unit_type")).alias("unit_type"))


def merge_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices by name; surface forms are the distinct ones of both, in order of the alphabet."""
    forms = old.select("name", F.explode_outer("surface_forms").alias("f")).unionByName(new.select("name", F.explode_outer("surface_forms").alias("f")))
    return forms.groupBy("name").agg(F.array_sort(F.collect_set("f")).alias("surface_forms"))


def merge_externals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices by id; the new name and type hold (of several new ones the greatest)."""
    rows = old.select("id", "name", "law_type", F.lit(0).alias("o")).unionByName(new.select("id", "name", "law_type", F.lit(1).alias("o")))
    return rows.groupBy("id").agg(F.max(F.struct("o", "name", "law_type")).alias("m")).select("id", "m.name", "m.law_type")


def merge_mentions(raw: DataFrame) -> DataFrame:
    """``source_unit_id, target_concept_name, extracted_texts``: texts once each, in order of first appearance (``ord``)."""
    first = raw.groupBy("source_unit_id", "target_concept_name", "extracted_text").agg(F.min("ord").alias("o"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "extracted_text"))), lambda x: x["extracted_text"])
    return first.groupBy("source_unit_id", "target_concept_name").agg(texts.alias("extracted_texts"))


def k_hop(starts: DataFrame, edges: DataFrame, max_hops: int, types: tuple[str, ...] = ()) -> DataFrame:
    """``start, id, hops``: what is reached from each start over at most ``max_hops`` edges, by the fewest.

    ``starts(id)``, ``edges(src, dst, type)``. Frontier joins: each round extends only what was new in the last one.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    links = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).where(F.col("id").isNotNull()).distinct()
    frontier = seen
    for n in range(1, max_hops + 1):
        step = frontier.join(links, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(n)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def concept_walk(names: DataFrame, mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Units that mention one of the concepts, with the number of them."""
    hits = mentions.join(names.select(F.col("name").alias("target_concept_name")).distinct(), "target_concept_name", "left_semi")
    hits = hits.groupBy(F.col("source_unit_id").alias("id")).agg(F.countDistinct("target_concept_name").alias("n_concepts"))
    return units.select("id", "parent_id", "content").join(hits, "id")


def cascade(units: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids that go when ``removed`` ids go: they and all below them, over every parent link, on and below circles too.

    By doubling: after n rounds a link leads 2^n parents up, and gone is what has a removed one less than 2^n above it.
    A round that adds nothing is the last, as whatever is still to come would have a node half way that it adds.
    """
    ups = units.select("id", F.col("parent_id").alias("up")).where(F.col("id").isNotNull() & F.col("up").isNotNull()).distinct()
    gone = materialize(removed.select("id").intersect(units.select("id")).where(F.col("id").isNotNull()), "gone")
    before, n = 0, gone.count()
    while n > before:
        below = ups.join(gone.select(F.col("id").alias("up")), "up", "left_semi").select("id")
        gone = materialize(gone.union(below).distinct(), "gone")
        before, n = n, gone.count()
        if n > before:
            ahead = ups.select(F.col("id").alias("up"), F.col("up").alias("next"))
            ups = materialize(ups.join(ahead, "up").select("id", F.col("next").alias("up")).distinct(), "ups")
    return gone
