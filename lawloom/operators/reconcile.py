"""Counts of the stores and the drift between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drift(relational: DataFrame, vector: DataFrame, graph: DataFrame, both_ways: bool = False) -> DataFrame:
    """``id, store, side`` for ids (column ``id``) of the relational store that the vector or graph store lacks.

    ``both_ways`` adds ids that only those have. Distinct ids, two anti joins; null ids are left out.
    """
    r, v, g = (t.select("id").where(F.col("id").isNotNull()).distinct() for t in (relational, vector, graph))
    out = r.join(v, "id", "left_anti").select("id", F.lit("vector").alias("store"), F.lit("missing").alias("side"))
    out = out.unionByName(r.join(g, "id", "left_anti").select("id", F.lit("graph").alias("store"), F.lit("missing").alias("side")))
    if both_ways:
        for t, name in ((v, "vector"), (g, "graph")):
            out = out.unionByName(t.join(r, "id", "left_anti").select("id", F.lit(name).alias("store"), F.lit("surplus").alias("side")))
    return out


def numbered_batches(ids: DataFrame, size: int, order: str = "id") -> DataFrame:
    """``id, batch``: consecutive batches of ``size`` in order, without a window over the whole table in one task.

    Rows are range-partitioned by the order; each partition counts its rows, and the running sum over partitions (one
    row each) says where its numbering begins.
    """
    from lawloom.session import materialize, parallelism

    spread = ids.select(F.col(order).alias("id")).repartitionByRange(parallelism(ids.sparkSession), "id").withColumn("p", F.spark_partition_id())
    local = materialize(spread.withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("id"))), "numbered")
    before = local.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)))
    return local.join(F.broadcast(before), "p").select("id", F.floor((F.coalesce("before", F.lit(0)) + F.col("n") - 1) / size).alias("batch"))


def messages(ids: DataFrame, task: str, size: int) -> DataFrame:
    """``batch_id, task, unit_ids`` with at most ``size`` ids each, in order."""
    return numbered_batches(ids, size).groupBy(F.col("batch").alias("batch_id")).agg(F.array_sort(F.collect_list("id")).alias("unit_ids")).select("batch_id", F.lit(task).alias("task"), "unit_ids")


def store_counts(units: DataFrame, points: DataFrame, vertices: dict[str, DataFrame]) -> DataFrame:
    """``store, n``: rows of the relational and the vector store, vertices of all labels of the graph."""
    out = units.agg(F.count("*").alias("n")).select(F.lit("relational").alias("store"), "n").unionByName(points.agg(F.count("*").alias("n")).select(F.lit("vector").alias("store"), "n"))
    for t in vertices.values():
        out = out.unionByName(t.agg(F.count("*").alias("n")).select(F.lit("graph").alias("store"), "n"))
    return out.groupBy("store").agg(F.sum("n").alias("n"))
