"""Table differences, hierarchies, orphan references."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lawloom.operators import hierarchy, orphans, tablediff

DAY = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_differences(spark):
    a = [("k1", "x", "c", 1), ("k2", None, "c", 1), ("k3", "x", None, 1), ("k4", "x", "c", 1), ("k5", "x", "", 1), ("k5", "old", "", 0), (None, "x", "c", 1), ("k7", "x" * 50_000, "c", 1), ("k4", "x", "c", 1)]
    b = [("k1", "x", "c", 1, 0), ("k2", None, "d", 1, 0), ("k3", "x", "c", 1, 0), ("k6", "x", "c", 1, 0), ("k5", "x", None, 2, 0), ("k5", "y", "", 1, 0), (None, "q", "c", 1, 0), ("k7", "x" * 49_999 + "y", "c", 1, 0)]
    left = spark.createDataFrame(a, "id string, p string, c string, bucket int")
    right = spark.createDataFrame(b, "uid string, p string, c string, at int, key int")
    got = tablediff.diff_tables(left, right, "id", "uid", ["p", "c"], ["bucket"], ["at"], "a", "b", rows_per_bucket=2)
    assert rows(got.select("key", "diff")) == [("k2", "c"), ("k3", "c"), ("k4", "only_a"), ("k5", "c"), ("k6", "only_b"), ("k7", "p")]
    cells = {(r.key, r["diff"]): (r.left_value, r.right_value) for r in got.collect()}
    assert cells["k3", "c"] == (None, "c") and cells["k5", "c"] == ("", None) and cells["k4", "only_a"] == (None, None)
    none = tablediff.diff_tables(left, right.limit(0), "id", "uid", ["p", "c"], ["bucket"], ["at"])
    assert {r["diff"] for r in none.collect()} == {"only_left"} and none.count() == 6
    assert tablediff.diff_tables(left.limit(0), right.limit(0), "id", "uid", ["p"], ["bucket"], ["at"]).count() == 0


def brute_paths(parent):
    paths, cyclic = {}, {}
    for n in parent:
        seen, x = [n], parent[n]
        while x is not None and x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is not None and x in parent:
            circle = seen[seen.index(x) :]
            cyclic[n] = (min(circle), "on" if n in circle else "below")
        else:
            paths[n] = seen[::-1]
    return paths, cyclic


def test_hierarchy_equals_brute_force(spark):
    rng = random.Random(1)
    parent = {f"n{i:03d}": (None if i % 40 == 0 else f"n{rng.randrange(i):03d}") for i in range(300)}
    parent |= {f"chain{i:03d}": (f"chain{i - 1:03d}" if i else "n000") for i in range(70)}
    parent |= {f"orphan{i}": "nowhere" for i in range(3)} | {"self": "self", "selfchild": "self"}
    for size in (2, 3, 7):
        parent |= {f"c{size}_{i}": f"c{size}_{(i + 1) % size}" for i in range(size)}
    parent |= {f"tail{i:02d}": (f"tail{i - 1:02d}" if i else "c7_3") for i in range(20)}
    data = [(k, p, DAY, "x") for k, p in parent.items()] + [("n005", "c2_0", DAY - timedelta(1), "x"), (None, "n001", DAY, "x"), ("n007", parent["n007"], DAY, "x")]
    df = spark.createDataFrame(data, "id string, parent_id string, loaded_at timestamp, root string")
    h = hierarchy.resolve(df, order_col="loaded_at", wide_levels=3)
    paths, cyclic = brute_paths(parent)
    assert {r.id: (r.path, r.depth, r.root) for r in h.paths().collect()} == {n: ("/".join(p), len(p) - 1, p[0]) for n, p in paths.items()}
    assert rows(h.descendants()) == sorted((a, p[-1], len(p) - 1 - i) for p in paths.values() for i, a in enumerate(p[:-1]))
    assert {r.id: (r.cycle_key, r.kind) for r in h.cycles().collect()} == cyclic
    slim = hierarchy.resolve(df, order_col="loaded_at", paths=False)
    assert {r.id: (r.cycle_key, r.kind) for r in slim.cycles().collect()} == cyclic


def test_hierarchy_without_cycles_or_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent_id string")
    h = hierarchy.resolve(df)
    assert rows(h.paths()) == [("a", "a", 0, "a"), ("b", "a/b", 1, "a")] and h.cycles().count() == 0
    empty = hierarchy.resolve(df.limit(0))
    assert empty.paths().count() == empty.descendants().count() == empty.cycles().count() == 0
    only = hierarchy.resolve(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"))
    assert rows(only.cycles()) == [("a", "a", "on"), ("b", "a", "on")] and only.paths().count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = orphans.bloom_filter(keys, "k")
    assert keys.where(~bloom.might_contain(F.col("k"))).count() == 0
    others = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("k"))
    assert others.where(bloom.might_contain(F.col("k"))).count() < 150
    small = orphans.bloom_filter(keys, "k", max_bits=1 << 11)
    assert small.size == 1 << 11 and keys.where(~small.might_contain(F.col("k"))).count() == 0
    assert keys.where(orphans.bloom_filter(keys.limit(0), "k").might_contain(F.col("k"))).count() == 0


def test_orphans(spark):
    t = [DAY + timedelta(days=40 * i) for i in range(4)]
    refs = [("s1", "p1", t[1]), ("s1", "p1", t[0]), ("s2", "p1", t[3]), ("s3", None, t[0]), ("s4", "gone", t[1]), ("s5", "never", t[1]), (None, "never", None), ("s6", "p2", None), ("s7", "P1", t[2]), ("s8", "p3", t[0])]
    r = orphans.references(spark.createDataFrame(refs, "a string, b string, c timestamp"), "refs", "a", "b", "c", "parents")
    parents = spark.createDataFrame([("p1", t[1], 1), ("p1", t[2], 2), ("p2", t[3], 1), ("p3", None, 1), (None, t[0], 1)], "id string, at timestamp, there int")
    removed = spark.createDataFrame([("parents", "gone"), ("parents", "gone"), ("other", "never"), ("parents", "p2")], "target_table string, target_key string")
    got = orphans.find_orphans(r, orphans.records(parents, "parents", "id", "at"), removed)
    want = [("s1", "p1", "late"), ("s4", "gone", "deleted"), ("s5", "never", "missing"), ("s7", "P1", "missing"), (None, "never", "missing")]
    assert {(x.source_key, x.target_key, x.reason) for x in got.collect()} == set(want) and got.count() == len(want)
    report = {(x.period, x.reason): x.n_refs for x in orphans.orphan_report(got).collect()}
    assert report == {("2024-01-01", "late"): 1, ("2024-02-01", "deleted"): 1, ("2024-02-01", "missing"): 1, ("2024-03-01", "missing"): 1, (None, "missing"): 1}
    none = orphans.find_orphans(r, orphans.records(parents.limit(0), "parents", "id", "at"), removed)
    assert none.count() == 9 - 1 and orphans.find_orphans(r.limit(0), orphans.records(parents, "parents", "id", "at"), removed).count() == 0


def test_buckets_follow_both_sides(spark):
    few = spark.range(10).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("x").alias("c"))
    many = spark.range(80_000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("y").alias("c"))
    for a, b in ((few, many), (many, few)):
        assert tablediff.bucket_count(a, b, ["c"], rows=1000) == 81
        got = tablediff.diff_tables(a, b, "id", "id", ["c"], rows_per_bucket=1000)
        assert got.count() == 80_000 and got.where(F.col("diff") == "c").count() == 10
    assert tablediff.bucket_count(many, many, ["c"], size=1000) == 160


def test_a_circle_beside_a_long_chain(spark):
    links = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None) for i in range(3000)] + [(f"c{i}", f"c{(i + 1) % 10}") for i in range(10)] + [("below", "c4")]
    h = hierarchy.resolve(spark.createDataFrame(links, "id string, parent_id string"), wide_levels=2)
    last = h.nodes.where(F.col("id") == "n02999").first()
    assert last.depth == 2999 and last.root == "n00000" and last.ancestors == [f"n{i:05d}" for i in range(3000)]
    assert h.nodes.count() == 3000 and h.nodes.where(F.size("ancestors") != F.col("depth") + 1).count() == 0
    assert rows(h.cycles()) == [("below", "c0", "below"), *((f"c{i}", "c0", "on") for i in range(10))]


def test_orphans_with_filters_in_parts(spark):
    parents = spark.range(500).select(F.lit("p").alias("target_table"), F.concat(F.lit("k"), "id").alias("target_key"), F.lit(DAY).alias("first_at"))
    refs = spark.range(1500).select(F.lit("r").alias("ref_table"), F.lit("p").alias("target_table"), F.col("id").cast("string").alias("source_key"), F.concat(F.lit("k"), F.col("id")).alias("target_key"), F.lit(DAY).alias("at"))
    removed = spark.createDataFrame([("p", "k700")], "target_table string, target_key string")
    whole, parts = (rows(orphans.find_orphans(refs, parents, removed, bits)) for bits in (orphans.MAX_BITS, 1 << 10))
    assert whole == parts and len(parts) == 1000 and ("r", "700", "k700", "deleted", DAY) in parts
