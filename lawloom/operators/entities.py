"""Entities: extraction, dominant categories, density clustering, concepts and mentions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.scalar import entity_text, terms
from lawloom.operators.enrich import Embedder, embed

GENERAL = "General"


def gazetteer_entities(units: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """A stand-in for the tagger: phrases of ``gazetteer(phrase, label)`` found as whole words in the content.

    Phrases are met by word runs: each unit is exploded into its runs of as many words as phrases have, and these are
    joined, so the list may be of any size. Punctuation between the words doesn't count; phrases without words are none.
    """
    run = terms(F.col("phrase")).alias("run")
    listed = gazetteer.select(entity_text(F.col("phrase")).alias("surface_form"), F.col("label").alias("category_label"), run)
    listed = listed.where(F.size("run") > 0).distinct()
    words = terms(F.col("content"))
    lengths = listed.select(F.collect_set(F.size("run")).alias("n"))
    listed = listed.withColumn("run", F.array_join("run", " "))
    split = units.select("id", words.alias("w"), lengths.scalar().alias("lengths")).where((F.size("w") > 0) & (F.size("lengths") > 0))
    runs = F.flatten(F.transform("lengths", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.struct(i.alias("ord"), F.array_join(F.slice("w", i, n), " ").alias("s")))))
    found = split.select("id", F.explode(runs).alias("r")).select(F.col("id").alias("source_unit_id"), F.col("r.s").alias("run"), F.col("r.ord").cast("long").alias("ord"))
    return found.join(listed, "run").select("surface_form", "category_label", "source_unit_id", "ord").distinct()


def dominant_categories(raw: DataFrame) -> DataFrame:
    """``surface_form, category_label``: the most frequent label of a form; of equally frequent ones the first seen
    (least ``ord``, then the label). Null labels don't count; a form with no label at all is General."""
    n = raw.groupBy("surface_form", "category_label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    counted = F.col("category_label").isNotNull()
    best = F.min(F.when(counted, F.struct((-F.col("n")).alias("n"), "first", "category_label"))).alias("m")
    return n.where(F.col("surface_form").isNotNull()).groupBy("surface_form").agg(best).select("surface_form", F.coalesce("m.category_label", F.lit(GENERAL)).alias("category_label"))


def single_linkage_labels(vectors: np.ndarray, min_cluster_size: int = 2) -> np.ndarray:
    """HDBSCAN labels with one sample: single linkage under cosine distance, condensed, by excess of mass.

    With one sample a point's core distance is 0, so mutual reachability is the distance itself. Prim's algorithm needs
    one row of distances at a time. The root is never a cluster; noise is -1.
    """
    n = len(vectors)
    if n < 2:
        return np.full(n, -1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    near, source, done, at, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.clip(1 - unit @ unit[at], 0, 2)
        better = (d < near) & ~done
        near[better], source[better] = d[better], at
        at = int(np.where(done, np.inf, near).argmin())
        edges.append((float(near[at]), int(source[at]), at))
    # merge tree: node n + i joins two
    parent, size, left, right, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}, {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (d, a, b) in enumerate(sorted(edges)):
        x, y, node = find(a), find(b), n + i
        parent[x] = parent[y] = node
        left[node], right[node], height[node], size[node] = x, y, d, size[x] + size[y]

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += [left[y], right[y]]
        return out

    top = 2 * n - 2
    births, mass, children, members, todo = {top: 0.0}, {top: 0.0}, {top: []}, {top: []}, [(top, top)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            continue
        strength = 1 / max(height[node], 1e-12)
        big = [x for x in (left[node], right[node]) if size[x] >= min_cluster_size]
        for x in (left[node], right[node]):
            if size[x] < min_cluster_size:
                mass[cluster] += size[x] * (strength - births[cluster])
                members[cluster] += leaves(x)
            elif len(big) == 2:
                mass[cluster] += size[x] * (strength - births[cluster])
                births[x], mass[x], children[x], members[x] = strength, 0.0, [], []
                children[cluster].append(x)
                todo.append((x, x))
            else:
                todo.append((x, cluster))
    chosen, total = {}, {}
    for c in sorted(births):  # children have smaller numbers than their parents
        below = sum(total[x] for x in children[c])
        chosen[c] = c != top and mass[c] >= below
        total[c] = max(mass[c], below) if c != top else below
    labels, k, todo2 = np.full(n, -1), 0, list(children[top])
    while todo2:
        c = todo2.pop(0)
        if chosen[c]:
            labels[leaves(c)] = k
            k += 1
        else:
            todo2 += children[c]
    return labels


def cluster_batches(forms: DataFrame, min_cluster_size: int = 2) -> DataFrame:
    """``batch_id, surface_form, label`` for ``forms(batch_id, surface_form, vector)``: each batch on its own.

    A batch is what one task message holds (some 50 units), which bounds a group; forms without a vector are noise.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("surface_form", kind="stable").reset_index(drop=True)
        has = pdf["vector"].notna().to_numpy()
        labels = np.full(len(pdf), -1)
        if has.any():
            labels[has] = single_linkage_labels(np.stack(pdf.loc[has, "vector"].to_list()).astype(np.float64), min_cluster_size)
        return pd.DataFrame({"batch_id": pdf["batch_id"], "surface_form": pdf["surface_form"], "label": labels})

    return forms.groupBy("batch_id").applyInPandas(run, "batch_id long, surface_form string, label int")


def concepts(labelled: DataFrame) -> DataFrame:
    """``batch_id, label, name, surface_forms``: a cluster's forms and its shortest, of equals the first by alphabet."""
    name = F.min_by("surface_form", F.struct(F.length("surface_form"), "surface_form")).alias("name")
    return labelled.where(F.col("label") != -1).groupBy("batch_id", "label").agg(name, F.array_sort(F.collect_set("surface_form")).alias("surface_forms"))


def anchor() -> Column:
    """The text by which a form is embedded: behind its category."""
    return F.concat_ws(": ", "category_label", "surface_form")


def resolve_entities(raw: DataFrame, embedder: Embedder) -> dict[str, DataFrame]:
    """Concepts, categories, belongs_to and mentions of ``raw(batch_id, surface_form, category_label, source_unit_id,
    ord)``. A form is embedded behind its dominant category; noise forms give nothing."""
    main = dominant_categories(raw)
    forms = raw.select("batch_id", "surface_form").where(F.col("surface_form").isNotNull()).distinct().join(main, "surface_form")
    forms = embed(forms.withColumn("anchor", anchor()), "anchor", "vector", embedder)
    labelled = cluster_batches(forms.select("batch_id", "surface_form", "vector"))
    found = concepts(labelled)
    belongs = found.join(main.withColumnRenamed("surface_form", "name"), "name").select(F.col("name").alias("source_concept_name"), F.col("category_label").alias("target_category_name")).distinct()
    of_form = found.select("batch_id", F.col("name").alias("target_concept_name"), F.explode("surface_forms").alias("surface_form"))
    mentions = raw.join(of_form, ["batch_id", "surface_form"]).select("source_unit_id", "target_concept_name", F.col("surface_form").alias("extracted_text"), "ord")
    return {
        "concepts": found.select("name", F.explode("surface_forms").alias("f")).groupBy("name").agg(F.array_sort(F.collect_set("f")).alias("surface_forms")),
        "categories": belongs.select(F.col("target_category_name").alias("name")).distinct(), "belongs_to": belongs, "mentions": mentions,
    }
