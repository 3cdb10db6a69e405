"""Dividing free-text forms into clusters of spellings of one term, by density peaks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawloom.llm.bktree import distances, encode
from lawloom.llm.canonical import ENDINGS, allowed, stems, tokens
from lawloom.session import materialize, spread

#: Members of a slice of a block; a larger block is compared slice by slice.
HUBS = 32
#: The least letters of an abbreviation.
ABBREVIATED = 3
#: The cost up to which two forms are neighbours.
CUTOFF = 4.0
#: A form is a peak if no denser one is its neighbour, or if the nearest denser one is farther than APART and it has at
#: least the share PEAK of its density: then both are terms of their own.
APART, PEAK = 3.0, 0.5
_PENTRU = "pentru"  # the one longer connecting word; its misspellings count as connecting words too
_DE = frozenset(["dee", "dde", "ede"])  # misspellings of the short one that are too long to fall away as such


def content_words(form: str) -> list[str]:
    """Content words in order of the alphabet; misspelled connecting words are left out where enough others remain."""
    ts = [t for t in tokens(form) if len(t.rstrip(".")) > 2]
    ts = [t.removesuffix(_PENTRU) if len(t) > 9 and t.endswith(_PENTRU) else t.removeprefix(_PENTRU) if len(t) > 9 else t for t in ts]
    if len(ts) > 3:
        weak = [t for t in ts if t in _DE or t[-1] == "." and _PENTRU.startswith(t[:-1]) or len(t) >= 4 and (_near_pentru(t) or any(_near_pentru(s) for s in stems(t) if len(s) >= 5))]
        for t in weak[: len(ts) - 2]:
            ts.remove(t)
    return sorted(ts)


def _near_pentru(word: str) -> bool:
    if abs(len(word) - 6) > 2:
        return False
    a, la = encode([word])
    b, lb = encode([_PENTRU])
    return int(distances(a, la, b, lb)[0]) <= 2


def _shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def block_keys(words: Sequence[str]) -> set[int]:
    """Blocks of a form. Two forms of one term share one if two of their words are alike, up to an edit in one of them:
    a word as it is goes with another as it is, or short of one letter. A form of one word has its shortened forms."""
    bare = [w.rstrip(".") for w in words]
    if len(bare) == 1:
        return {_hash(f"1|{v}") for v in _shortened(bare[0]) | {bare[0]}}
    keys = set()
    for i, u in enumerate(bare):
        for j, v in enumerate(bare):
            if i != j:
                if i < j:
                    keys.add(f"2|{u}|{v}")
                keys.update([f"3|{u}|{x}" for x in _shortened(v)])
                keys.add(f"3|{u}|{v}")
    # two words may be written as one
    if len(bare) == 2:
        keys |= {f"5|{bare[0]}|{bare[1]}", f"5|{bare[1]}|{bare[0]}"}
    elif len(bare) == 3:
        keys.update(f"5|{u}{v}|{w}" for u, v, w in permutations(bare))
    return set(map(_hash, keys))


def asked_keys(words: Sequence[str]) -> set[int]:
    """Blocks in which a form looks for the full words of its abbreviations, each next to another of its words."""
    return {_hash(f"4|{u.rstrip('.')}|{v[:-1]}") for v in words if v[-1] == "." for u in words if u is not v}


def answered_keys(words: Sequence[str]) -> set[int]:
    """Blocks in which a form can be found by an abbreviation of one of its words, itself abbreviated less or not."""
    return {_hash(f"4|{u.rstrip('.')}|{v[:n]}") for v in words for u in words if u is not v for n in range(ABBREVIATED, len(v.rstrip(".")))}


def _roots(word: str, least: int = 4) -> set[str]:
    out = {word, word[:-1] if len(word) > least and word[-1] in "aeiu" else word}
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= least:
            out.add(word[: -len(e)])
    return out


def _word_cost(u: str, v: str, d: int, alone: bool) -> float:
    """Cost of taking one word for the other; infinite if they are different words.

    alone: all other words of the two forms are the same, so this one may differ more.
    """
    a, b = u.rstrip("."), v.rstrip(".")
    if a == b:
        return 0.0
    if u[-1] == "." and b.startswith(a) or v[-1] == "." and a.startswith(b):
        return 0.5
    if d <= min(allowed(a), allowed(b)):
        return float(d)
    if _roots(a) & _roots(b) or alone and _roots(a, 3) & _roots(b, 3):
        return 0.5
    n = max(len(a), len(b))
    if alone and (d <= (1 if n <= 4 else 3 if n <= 9 else 4) or d == 2 and sorted(a) == sorted(b)):
        return float(d)
    return float("inf")


def form_costs(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """For each pair of forms (content words joined by spaces) the cost of reading one as the other."""
    rest: list[tuple[list[str], list[str], int]] = []
    needed: dict[tuple[str, str], int] = {}
    for a, b in pairs:
        x, y = a.split(" "), b.split(" ")
        u, v = [w for w in x if w not in y], [w for w in y if w not in x]
        if len(u) + 1 == len(v) == 2 or len(v) + 1 == len(u) == 2:
            one, two = (u, v) if len(u) == 1 else (v, u)
            u, v = one, [min(("".join(two), "".join(two[::-1])), key=lambda s, t=one[0]: s != t)]
        rest.append((u, v, len(x)))
        if len(u) == len(v):
            for p in u:
                for q in v:
                    needed.setdefault((p, q), 99)
    if needed:
        left, right = zip(*needed, strict=True)
        ca, la = encode([w.rstrip(".") for w in left])
        cb, lb = encode([w.rstrip(".") for w in right])
        step = 1 << 15
        for i in range(0, len(left), step):
            d = distances(ca[i : i + step], la[i : i + step], cb[i : i + step], lb[i : i + step])
            needed.update(zip(zip(left[i : i + step], right[i : i + step], strict=True), d.tolist(), strict=True))
    out = []
    for u, v, n in rest:
        if len(u) != len(v):
            out.append(float("inf"))
        elif not u:
            out.append(0.0)
        else:
            out.append(min(sum(_word_cost(p, q, needed[p, q], len(u) == 1 and n > 2) for p, q in zip(u, way, strict=True)) for way in permutations(v)) if len(u) <= 4 else float("inf"))
    return out


def _spell(batches):
    for b in batches:
        forms = [f for f in b.column(0).to_pylist() if f is not None]
        words = [" ".join(content_words(f)) for f in forms]
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(words, pa.string())], names=["form", "spelling"])


def _keys(batches, f):
    for b in batches:
        rows, keys = [], []
        for i, s in enumerate(b.column("spelling").to_pylist()):
            ks = f(s.split(" "))
            keys += ks
            rows += [i] * len(ks)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("id").take(at), b.column("forms").take(at)], names=["block", "id", "forms"])


def _verify(batches):
    for b in batches:
        cost = np.array(form_costs(list(zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True))), dtype=float)
        kept = pa.array(np.flatnonzero(cost <= CUTOFF))
        yield pa.RecordBatch.from_arrays([b.column("a").take(kept), b.column("b").take(kept), pa.array(cost).take(kept)], names=["a", "b", "cost"])


@dataclass(frozen=True)
class Clusters:
    """``members``: form, cluster (id of its peak), density, is_peak."""

    members: DataFrame

    def pairs(self) -> DataFrame:
        """form_a, form_b: two different forms of one cluster, the smaller first."""
        a = self.members.select(F.col("form").alias("form_a"), "cluster")
        b = self.members.select(F.col("form").alias("form_b"), "cluster")
        return a.join(b, "cluster").where(F.col("form_a") < F.col("form_b")).select("form_a", "form_b")

    def links(self) -> DataFrame:
        """form, representative: each form with the peak's first form of its cluster. Two forms write one term if they have
        the same, so this says what :meth:`pairs` says with a row for each form."""
        first = self.members.where("is_peak").groupBy("cluster").agg(F.min("form").alias("representative"))
        return self.members.select("form", "cluster").join(first, "cluster").select("form", "representative")

    def describe(self, typical: int = 3) -> DataFrame:
        """cluster, size and its most typical forms: the densest, of these lower-case and short ones first."""
        rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("density"), F.col("form") != F.lower("form"), F.length("form"), "form"))
        top = self.members.withColumn("rank", rank).where(F.col("rank") <= typical).groupBy("cluster")
        top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "form"))), lambda x: x["form"]).alias("typical_forms"))
        return self.members.groupBy("cluster").agg(F.count("*").alias("size")).join(top, "cluster")


def _neighbours(reps: DataFrame) -> DataFrame:
    """``a, b, cost`` of neighbouring spellings, each pair once.

    Within a block all are compared with all. A block of more than ``HUBS`` members is cut into slices, and every two of
    them meet under a key of their own, so no task gets a large block whole. An abbreviated form is compared with the
    full forms that answer to it.
    """
    schema = "block long, id long, forms long"
    lookup = reps.select("id", "spelling")
    short = F.col("spelling").contains(".")
    asks = reps.where(short).mapInArrow(lambda bs: _keys(bs, asked_keys), schema).select("block", F.col("id").alias("a"))
    answers = reps.mapInArrow(lambda bs: _keys(bs, answered_keys), schema).select("block", "id")
    extra = asks.join(answers, "block").where(F.col("a") != F.col("id")).select("a", "id")
    keyed = materialize(reps.mapInArrow(lambda bs: _keys(bs, block_keys), schema).select("block", "id"), "keys")
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / HUBS)
    placed = materialize(keyed.join(sizes, "block").select("block", "id", slices.alias("slices"), F.pmod(F.xxhash64("id"), slices).alias("own")), "blocks")
    own, last = F.col("own"), F.col("slices") - 1
    first = placed.select("block", own.alias("i"), F.explode(F.sequence(own, last)).alias("j"), F.col("id").alias("a"))
    second = placed.select("block", F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("i"), own.alias("j"), "id")
    pairs = first.join(second, ["block", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("id"))).select("a", "id").unionByName(extra)
    pairs = pairs.select(F.least("a", "id").alias("x"), F.greatest("a", "id").alias("y")).distinct()
    pairs = pairs.join(lookup.select(F.col("id").alias("x"), F.col("spelling").alias("sa")), "x").join(lookup.select(F.col("id").alias("y"), F.col("spelling").alias("sb")), "y")
    return spread(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "sa", "sb"), "a").mapInArrow(_verify, "a long, b long, cost double")


def cluster_forms(pool: DataFrame, form: str) -> Clusters:
    """Clusters of forms that write the same term.

    Forms are read as their content words, folded; forms with the same words are one spelling. Neighbours of a spelling
    are found by a blocked join (see :func:`block_keys`) and a check of the words one by one. Its density is the number
    of forms it has plus those of its neighbours, nearer ones counting more; its distance is the cost to its nearest
    denser neighbour. Peaks are chosen by both: nothing denser is near, or only what is far and not much denser (see
    ``APART``). All others point to their nearest denser neighbour. Following the pointers, by doubling, leads every form to its peak. All steps are joins on
    blocks and ids; nothing grows on the driver.

    Defined cases: null forms are left out; forms without content words (blank, numbers) are clusters of their own;
    repeated forms count once; ties go to the smaller id.
    """
    distinct = pool.select(F.col(form).alias("form")).where(F.col("form").isNotNull()).distinct()
    forms = spread(distinct, "form").mapInArrow(_spell, "form string, spelling string")
    # without content words a form stands for itself
    own = F.when(F.col("spelling") == "", F.xxhash64(F.lit("form"), "form")).otherwise(F.xxhash64("spelling"))
    forms = materialize(forms.withColumn("id", own), "forms")
    reps = materialize(forms.groupBy("id", "spelling").agg(F.count("*").alias("forms")), "spellings")
    near = materialize(_neighbours(reps.where(F.col("spelling") != "")), "neighbours")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    weight = both.join(reps.select(F.col("id").alias("b"), "forms"), "b").groupBy(F.col("a").alias("id"))
    weight = weight.agg(F.sum(F.col("forms") * F.exp(-F.col("cost"))).alias("more"))
    dense = reps.join(weight, "id", "left").select("id", F.round(F.col("forms") + F.coalesce("more", F.lit(0.0)), 6).alias("density"))
    dense = materialize(dense, "density")
    a = dense.select(F.col("id").alias("a"), F.struct("density", (-F.col("id")).alias("i")).alias("da"))
    b = dense.select(F.col("id").alias("b"), F.struct("density", (-F.col("id")).alias("i")).alias("db"))
    up = both.join(a, "a").join(b, "b").where(F.col("db") > F.col("da"))
    up = up.groupBy(F.col("a").alias("id"), F.col("da.density").alias("own")).agg(F.min(F.struct("cost", (-F.col("db.density")).alias("d"), "b")).alias("m"))
    # by density and distance: what is far from anything denser, and not much less dense, is a peak
    apart = (F.col("m.cost") > APART) & (F.col("own") >= PEAK * -F.col("m.d"))
    up = up.where(~apart).select("id", F.col("m.b").alias("to"))
    state = materialize(dense.join(up, "id", "left").select("id", "density", F.coalesce("to", "id").alias("to")), "pointers")
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"))
        state = materialize(state.join(ahead, "to").select("id", "density", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "pointers")
        if not state.where("moved").count():
            break
    labels = state.select("id", F.col("to").alias("cluster"), "density")
    members = forms.select("form", "id").join(labels, "id").select("form", "cluster", "density", (F.col("id") == F.col("cluster")).alias("is_peak"))
    return Clusters(members)
