"""Parent-child links to paths, depths, roots, descendants and cycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import discard, materialize

SEPARATOR = "/"


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: id, parent_id, depth, root and, if asked for, ancestors (root first, ending in the node itself).

    ``unreached``: id, parent_id of the nodes that no root reaches, that is, whose chain of parents never ends.
    """

    nodes: DataFrame
    unreached: DataFrame

    def paths(self) -> DataFrame:
        """id, path, depth, root; the path is the ids from the root to the node, joined by ``/``."""
        return self.nodes.select("id", F.array_join("ancestors", SEPARATOR).alias("path"), "depth", "root")

    def descendants(self) -> DataFrame:
        """ancestor_id, descendant_id, distance: one row per node and proper ancestor."""
        a = self.nodes.where(F.size("ancestors") > 1).select(
            F.col("id").alias("descendant_id"), F.posexplode(F.slice("ancestors", 1, F.size("ancestors") - 1)).alias("pos", "ancestor_id"), F.size("ancestors").alias("n")
        )
        return a.select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("int").alias("distance"))

    def cycles(self) -> DataFrame:
        """id, cycle_key, kind for every unreached node: ``on`` the circle or ``below`` it; the key is its smallest id."""
        return _cycles(self.unreached)


def resolve(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", order_col: str | None = None, paths: bool = True, wide_levels: int = 5) -> Hierarchy:
    """Follow parent links level by level from the roots.

    A root is a node whose parent is null or has no row. Each round joins the nodes still unreached with the frontier
    of the last level, which extends ancestors, depth and root. After ``wide_levels`` levels few nodes are left, on long
    thin chains: they are resolved by doubling, each round joining the rest with itself, so a chain of n levels takes
    log2(n) jobs, not n. Doubling runs on ids first, which tells nodes on and below cycles, whose chains never end; only
    the others get segments of ancestors. Every round's result is a table in the shared folder, so no lineage grows.

    Defined cases: rows with a null id are left out; of several rows of one id the one greatest by ``order_col`` holds
    (then the greatest parent); a node that is its own parent is a cycle of one; an empty table gives empty results;
    other columns are ignored.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    best = F.max(F.struct(order.alias("o"), F.col(parent_col).alias("p"))).alias("m")
    nodes = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(best).select("id", F.col("m.p").alias("parent_id"))
    nodes = materialize(nodes, "nodes")
    total = nodes.count()
    linked = nodes.where(F.col("parent_id").isNotNull())
    known = nodes.select(F.col("id").alias("parent_id"))
    orphans = linked.join(known, "parent_id", "left_anti").select("id", "parent_id")
    ancestors = [F.array("id").alias("ancestors")] if paths else []
    top = nodes.where(F.col("parent_id").isNull()).unionByName(orphans)
    top = top.select("id", "parent_id", F.lit(0).alias("depth"), F.col("id").alias("root"), *ancestors)
    frontier = materialize(top, "level")
    size = reached = frontier.count()
    parts = [frontier]
    while size and reached < total and len(parts) < wide_levels:
        path = [F.concat("ancestors", F.array("id")).alias("ancestors")] if paths else []
        frontier = materialize(linked.join(_up(frontier), "parent_id").select("id", "parent_id", (F.col("up_depth") + 1).alias("depth"), "root", *path), "level")
        size = frontier.count()
        reached += size
        parts.append(frontier)
    every = _union(parts)
    if reached == total:
        return Hierarchy(every, linked.limit(0))
    rest = linked.join(every.select("id"), "id", "left_anti")
    rest, endless = _split_endless(materialize(rest, "rest"))
    return Hierarchy(every.unionByName(_deep(rest, every, paths)), endless)


def _split_endless(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose chain leaves ``rest``, with the place where it does and the links up to it, and all others.

    Pointer doubling on ids alone. After n rounds every chain of at most 2^n links has ended; a chain of more passes a
    node that this round has ended, so a round that ends none was the last, and what is left runs in circles.
    """
    state = rest.select("id", "parent_id", F.col("parent_id").alias("jump"), F.lit(1).alias("hops"), F.lit(False).alias("ended"))
    before, past = -1, None
    while True:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("hops").alias("hops2"), F.col("ended").alias("ended2"))
        state = state.join(ahead, "jump", "left").select(
            "id", "parent_id", F.coalesce("jump2", "jump").alias("jump"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), (F.col("jump2").isNull() | F.col("ended2")).alias("ended")
        )
        old, state = past, materialize(state, "ends")
        past = state
        if old is not None:
            discard(old)
        ended = state.where("ended").count()
        if ended == before:
            return state.where("ended").drop("ended"), state.where(~F.col("ended")).select("id", "parent_id")
        before = ended


def _deep(rest: DataFrame, above: DataFrame, paths: bool) -> DataFrame:
    """The nodes of ``rest``, none of which is on or below a circle, with depth, root and ancestors.

    Ancestors are put together by doubling, too: a segment ends below the node that ``jump`` names, and never holds more
    ids than there are between the node and the end of its chain.
    """
    top = _up(above).withColumnRenamed("parent_id", "end")
    found = rest.select("id", "parent_id", F.col("jump").alias("end"), "hops").join(top, "end")
    found = found.select("id", "parent_id", (F.col("up_depth") + F.col("hops")).alias("depth"), "root", *(["ancestors"] if paths else []))
    if not paths:
        return found
    state = rest.select("id", F.col("parent_id").alias("jump"), F.array("id").alias("segment"), "hops")
    longest = rest.agg(F.max("hops")).first()[0] or 0
    reach = 1
    while reach < longest:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("segment").alias("segment2"))
        # a segment as long as its chain is whole: only the others are joined
        open_, whole = state.where(F.col("hops") > reach), state.where(F.col("hops") <= reach)
        grown = open_.join(ahead, "jump").select("id", F.col("jump2").alias("jump"), F.concat("segment2", "segment").alias("segment"), "hops")
        state = materialize(whole.unionByName(grown), "segments")
        reach *= 2
    return found.join(state.select("id", "segment"), "id").select("id", "parent_id", "depth", "root", F.concat("ancestors", "segment").alias("ancestors"))


def _up(level: DataFrame) -> DataFrame:
    return level.select(F.col("id").alias("parent_id"), F.col("depth").alias("up_depth"), *[c for c in ("root", "ancestors") if c in level.columns])


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _cycles(unreached: DataFrame) -> DataFrame:
    """Pointer doubling over nodes that each have their parent among them.

    After n doublings a node points 2^n links up. The set of nodes pointed to shrinks to the circles; once a doubling
    leaves its size unchanged, the jump permutes it, so it is the circles. The smallest id within 2^n links is doubled
    along. When a doubling changes it for no node of a circle, it is equal for all nodes that jumps lead to from one, and
    what they looked at covers the circle; so it is the smallest of the circle.
    """
    state = unreached.select("id", F.col("parent_id").alias("jump"), F.col("id").alias("low"), F.lit(True).alias("changed"))
    before = None
    while True:
        images = state.select(F.col("jump").alias("id")).distinct()
        on = state.join(images, "id", "left_semi")
        size, changed = on.agg(F.count("*"), F.count_if("changed")).first()
        if not size or size == before and not changed:
            circle = on.select("id", "low")
            break
        before = size
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("next_low"))
        state = materialize(state.join(ahead, "jump").select("id", F.col("next").alias("jump"), F.least("low", "next_low").alias("low"), (F.col("next_low") < F.col("low")).alias("changed")), "cycle")
    keyed = circle.select(F.col("id").alias("jump"), F.col("low").alias("cycle_key"))
    flags = circle.select("id", F.lit("on").alias("kind"))
    return state.join(keyed, "jump").join(flags, "id", "left").select("id", "cycle_key", F.coalesce("kind", F.lit("below")).alias("kind"))
