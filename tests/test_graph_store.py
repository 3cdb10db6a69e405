import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom import unit_queries
from lawloom.functions import scalar
from lawloom.operators import enrich, entities, graph, reconcile, retrieval
from lawloom.plans.engine import Engine
from lawloom.sources.store import Store
from tests.test_parse import TEXT


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_uuid5_and_scalars(spark):
    df = spark.createDataFrame([("art_5_content",), ("ș",)], "n string")
    assert [r[0] for r in df.select(scalar.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in ("art_5_content", "ș")]
    one = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], None, [1.0])], "a array<double>, b array<double>, z array<double>, n array<double>, s array<double>")
    got = one.select(scalar.cosine(F.col("a"), F.col("b")), *[scalar.cosine(F.col("a"), F.col(c)) for c in "zns"]).first()
    assert got[0] == pytest.approx(0.96) and list(got[1:]) == [None, None, None]
    q = spark.createDataFrame([('{"questions": ["a", "b", "c", "d"]}',), ("no json",), (None,)], "s string")
    assert [r[0] for r in q.select(scalar.questions_of(F.col("s"))).collect()] == [["a", "b", "c"], [], []]
    t = spark.createDataFrame([("x" * 101,), ("y",), ("  Amendă  ",), ("   ",)], "s string")
    assert [r[0] for r in t.select(scalar.snippet(F.col("s"))).collect()][:2] == ["x" * 100 + "...", "y"]
    assert [r[0] for r in t.select(scalar.entity_text(F.col("s"))).collect()][2:] == ["amendă", None]


def test_upsert_is_idempotent(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.create("t", "k string, v string")
    for batch in ([("x", "old")], [("x", "n1"), ("y", "n1")], [("y", "n2")], [("y", "n2")]):
        assert s.upsert("t", spark.createDataFrame(batch, "k string, v string"), "k") == len(batch)
    assert rows(s.read("t")) == [("x", "n1"), ("y", "n2")]
    assert s.upsert("t", spark.createDataFrame([], "k string, v string"), "k") == 0 and s.version("t") == 4
    with pytest.raises(ValueError):
        s.insert("t", spark.createDataFrame([("x", "z")], "k string, v string"), "k")
    with pytest.raises(ValueError):
        s.wipe("t")
    s.wipe("t", confirm=True)
    assert s.read("t").count() == 0
    with pytest.raises(LookupError):
        s.read("none")


def test_merges(spark):
    c = "name string, surface_forms array<string>"
    got = graph.merge_concepts(spark.createDataFrame([("a", ["x", "y"]), ("e", [])], c), spark.createDataFrame([("a", ["y", "z"]), ("b", ["b"])], c))
    assert rows(got) == [("a", ["x", "y", "z"]), ("b", ["b"]), ("e", [])]
    u = "id string, unit_type string"
    assert rows(graph.merge_units(spark.createDataFrame([("a", "z")], u), spark.createDataFrame([("a", "b")], u))) == [("a", "b")]
    x = "id string, name string, law_type string"
    assert rows(graph.merge_externals(spark.createDataFrame([("a", "z", "z")], x), spark.createDataFrame([("a", "b", None)], x))) == [("a", "b", None)]
    m = spark.createDataFrame([("u", "c", "t2", 1), ("u", "c", "t1", 2), ("u", "c", "t2", 3)], "source_unit_id string, target_concept_name string, extracted_text string, ord long")
    assert rows(graph.merge_mentions(m)) == [("u", "c", ["t2", "t1"])]


def test_k_hop_and_cascade(spark):
    e = spark.createDataFrame([("a", "b", "P"), ("b", "c", "P"), ("c", "a", "P"), ("b", "d", "Q"), (None, "a", "P")], "src string, dst string, type string")
    s = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.k_hop(s, e, 2, ("P",))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.k_hop(s, e, 5)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2)]
    u = spark.createDataFrame([("r", None), ("x", "r"), ("y", "x"), ("z", None)], "id string, parent_id string")
    assert rows(graph.cascade(u, spark.createDataFrame([("x",), ("q",)], "id string"))) == [("x",), ("y",)]


def test_cascade_on_and_below_circles(spark):
    links = [("r", None), ("x", "r"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("s", "s"), ("t", "s"), ("m", "r"), ("m", "d"), *((f"n{i:02d}", f"n{i - 1:02d}" if i else "d") for i in range(21))]
    u = spark.createDataFrame(links, "id string, parent_id string")
    chain = [(f"n{i:02d}",) for i in range(21)]
    for removed, want in (("a", [("a",), ("b",), ("c",), ("d",), ("m",), *chain]), ("d", [("d",), ("m",), *chain]), ("n00", chain), ("s", [("s",), ("t",)]), ("x", [("x",)]), ("q", [])):
        assert rows(graph.cascade(u, spark.createDataFrame([(removed,)], "id string"))) == sorted(want)


def test_dominant_category(spark):
    raw = [("amenda", "S", "u1", 1), ("amenzii", "S", "u2", 2), ("amenda", "O", "u3", 3), ("amenda", "O", "u3", 4), ("viteza", None, "u4", 5), ("tie", "b", "u", 6), ("tie", "a", "u", 7)]
    df = spark.createDataFrame(raw, "surface_form string, category_label string, source_unit_id string, ord long")
    assert rows(entities.dominant_categories(df)) == [("amenda", "O"), ("amenzii", "S"), ("tie", "b"), ("viteza", "General")]


def test_single_linkage():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((4, 16))
    x = np.concatenate([c + rng.standard_normal((6, 16)) * 0.05 for c in centres])
    labels = entities.single_linkage_labels(x)
    # points of one centre never end up in clusters with points of another
    groups = {}
    for i, label in enumerate(labels):
        if label >= 0:
            groups.setdefault(label, set()).add(i // 6)
    assert groups and all(len(g) == 1 for g in groups.values())
    assert entities.single_linkage_labels(np.zeros((0, 3))).tolist() == [] and entities.single_linkage_labels(np.ones((1, 3))).tolist() == [-1]


def test_concepts(spark):
    labelled = spark.createDataFrame([(0, "amenda", 0), (0, "amenzii", 0), (0, "viteza", -1)], "batch_id long, surface_form string, label int")
    assert rows(entities.concepts(labelled)) == [(0, 0, "amenda", ["amenda", "amenzii"])]


def test_fusion(spark):
    d = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3)], "key string, rank int")
    s = spark.createDataFrame([("p3", 1), ("p1", 2)], "key string, rank int")
    assert {k: round(v, 6) for k, v in rows(retrieval.fuse(d, s))} == {"p1": 0.833333, "p3": 0.75, "p2": 0.333333}
    assert {k: round(v, 6) for k, v in rows(retrieval.fuse(d, s, rrf_k=60, first=1))} == {"p1": 0.032522, "p3": 0.032266, "p2": 0.016129}


def test_drift_and_batches(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = reconcile.drift(t("a", "b", "c", None), t("a", "a"), t("a", "b", "z"))
    assert rows(got) == [("b", "vector", "missing"), ("c", "graph", "missing"), ("c", "vector", "missing")]
    assert ("z", "graph", "surplus") in rows(reconcile.drift(t("a"), t("a"), t("z", "a"), True))
    ids = [f"{i:03d}" for i in range(120)]
    m = reconcile.messages(t(*ids), "x", 50).orderBy("batch_id").collect()
    assert [r.unit_ids for r in m] == [ids[:50], ids[50:100], ids[100:]]
    assert reconcile.messages(t(), "x", 50).count() == 0


def test_points_keep_questions_and_vectors_together(spark):
    units = spark.createDataFrame([("cap_2", None, "chapter", "CAPITOLUL 2", {}), ("art_14", "cap_2", "article", "Art. 14 viteza maximă", {})], "id string, parent_id string, unit_type string, content string, meta_info map<string,string>")
    e = {r.id: r for r in enrich.enrich(units, enrich.hash_embedder(768)).collect()}
    assert e["cap_2"].hypothetical_questions == [] and len(e["cap_2"].content_vector) == 768 and e["cap_2"].sparse_vector is None
    assert len(e["art_14"].hypothetical_questions) == len(e["art_14"].question_vectors) == 3 and e["art_14"].sparse_vector.indices
    p = enrich.to_points(enrich.enrich(units, enrich.hash_embedder(16))).collect()
    assert sorted((r.unit_id, r.vector_type) for r in p) == [("art_14", "content")] + [("art_14", "question")] * 3 + [("cap_2", "content")]
    assert {r.point_id for r in p if r.unit_id == "cap_2"} == {str(uuid.uuid5(uuid.NAMESPACE_DNS, "cap_2_content"))}


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text(TEXT)
    gazetteer = spark.createDataFrame([("literă", "Obligație Legală"), ("Legea", "Document Auto")], "phrase string, label string")
    engine = Engine(spark, f"file://{tmp_path}/store", enrich.hash_embedder(32), gazetteer)
    assert engine.ingest(str(tmp_path / "in")) == 13
    assert engine.reconcile().count() == 26
    engine.work(f"{tmp_path}/checkpoint")
    assert engine.reconcile(fix=True).count() == 0
    assert engine.ingest(str(tmp_path / "in"), trigger_tasks=False) == 13
    assert {r.store: r.n for r in engine.stats().collect()}["relational"] == 13
    refs = rows(engine.store.read("e_references"))
    assert refs == [("art_5_alin_1_1", "art_7"), ("art_5_alin_1_lit_b", "art_5_alin_1_1")]
    assert rows(engine.store.read("e_refers_external")) == [("art_5_alin_1", "legea_286_2009")]
    found = engine.search("prima literă", 3).collect()
    assert found[0].unit_id == "art_5_alin_1_lit_a" and len(found) == 3
    assert engine.search("  ").count() == 0
    assert engine.search("x", filters={"category": "y"}).count() == 0 and "no such field" in engine.errors[0]
    engine.wipe(confirm=True)
    assert engine.store.read("law_units").count() == 0


def test_concept_walk_takes_all_concepts(spark, tmp_path):
    tables = {
        "v_concept": ([(i, f"c{i}", [f"f{i}"]) for i in range(1, 4)], "concept_id long, name string, surface_forms array<string>"),
        "raw_entities": ([("f1", "u1", 1), ("f2", "u1", 2), ("f3", "u2", 3), ("x", "u3", 4)], "surface_form string, source_unit_id string, ord long"),
        "law_units": ([("u1", None, "a"), ("u2", "u1", "b"), ("u3", "u1", "c")], "id string, parent_id string, content string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(unit_queries.concept_walk(spark, str(tmp_path))) == [("u1", 2), ("u2", 1)]


ACT = "CAPITOLUL I: A\nArt. 1\n(1) vezi art. 2 alin. (1)\n"
LATER = "CAPITOLUL II: B\nArt. 2\n(1) vezi art. 1 și art. 9\n"


def test_citations_of_later_units_are_not_lost(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", enrich.hash_embedder(16))
    for n, text in enumerate((ACT, LATER)):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}" / "x.txt").write_text(text)
        engine.ingest(str(tmp_path / f"in{n}"))
        engine.work(f"{tmp_path}/checkpoint")
        if n == 0:
            assert engine.store.read("e_references").count() == 0
            assert rows(engine.dangling()) == [("e_references", "art_1_alin_1", "art_2_alin_1", "target")]
    assert rows(engine.store.read("e_references")) == [("art_1_alin_1", "art_2_alin_1"), ("art_2_alin_1", "art_1")]
    assert rows(engine.dangling()) == [("e_references", "art_2_alin_1", "art_9", "target")]
    engine.graph_ids(["art_1_alin_1"])
    assert engine.store.read("e_references").count() == 2
    found = engine.search(target_unit_id="art_1_alin_1", max_hops=1, allowed_edge_types=("REFERENCES",)).collect()
    assert [r.unit_id for r in found] == ["art_1_alin_1", "art_2_alin_1"] and found[0].source_strategy == "graph"
    both = engine.search("vezi", target_unit_id="art_2", allowed_edge_types=("PART_OF",), rerank=lambda q, c: -retrieval.F.length(c)).collect()
    assert both and both[0].cross_encoder_score == max(r.cross_encoder_score for r in both)
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/store", enrich.hash_embedder(8)).vector_ids(["art_1"])
    assert engine.console("vezi", 1).first().unit_id.startswith("art_")


def test_a_batch_is_a_group_of_entities(spark, tmp_path):
    gazetteer = spark.createDataFrame([("literă", "L"), ("viteza", "V")], "phrase string, label string")
    engine = Engine(spark, f"file://{tmp_path}/store", enrich.hash_embedder(16), gazetteer, settings=enrich.SETTINGS.__class__(batch=1, dimension=16))
    units = spark.createDataFrame([(f"u{i}", None, "article", "literă și viteza", {}) for i in range(3)], "id string, parent_id string, unit_type string, content string, meta_info map<string,string>")
    assert engine.put(units) == 3
    seen = []
    engine.ingest_graph = lambda b: seen.extend(r.batch_id for r in b.select("batch_id").collect())
    engine.work(f"{tmp_path}/checkpoint")
    assert sorted(seen) == [0, 1, 2]


def test_a_commit_is_whole_and_one_of_two_writers_tries_again(spark, tmp_path, monkeypatch):
    from lawloom.sources import store as module

    root = f"file://{tmp_path}/s"
    s = Store(spark, root)
    frame = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    s.create("t", "k string, v string", "k")
    s.create("u", "k string, v string", "k")
    # a writer that dies before the log is written leaves the tables as they were
    staged = {"t": s.stage_upsert("t", frame(("a", "1")), "k"), "u": s.stage_upsert("u", frame(("b", "1")), "k")}
    with monkeypatch.context() as m:
        m.setattr(Store, "_write_log", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            s.commit(staged)
    assert s.read("t").count() == s.read("u").count() == 0
    # two writers: the second is told, and an upsert tries again with what the first has written
    other = Store(spark, root)
    other.upsert("t", frame(("c", "2")), "k")
    with pytest.raises(module.Conflict):
        s.commit(staged)
    assert s.upsert("t", frame(("a", "1")), "k") == 1 and rows(other.read("t")) == [("a", "1"), ("c", "2")]
    with pytest.raises(module.Conflict):
        s._write_log(s._numbers()[-1], {"tables": {}, "outbox": []})
    # messages that were committed but not handed over come with the next opening
    folder = s.stage_messages(spark.createDataFrame([(0, "x", ["a"])], "batch_id long, task string, unit_ids array<string>"))
    with monkeypatch.context() as m:
        m.setattr(Store, "recover", lambda self: None)
        s.commit({}, [folder])
        assert not (tmp_path / "s" / "outbox").exists()
    Store(spark, root)
    assert spark.read.parquet(f"{root}/outbox").count() == 1


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    many = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("old").alias("v"))
    s.create("t", "k string, v string", "k", 64)
    s.upsert("t", many, "k")
    before = s._entry("t")["folders"]
    s.upsert("t", many.limit(3).withColumn("v", F.lit("new")), "k")
    after = s._entry("t")["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3 and s.read("t").count() == 1000 and s.read("t").where("v = 'new'").count() == 3
    assert s.get("t", "k", "k7").count() == 1 and s.get("t", "v", "new").count() == 3
    with pytest.raises(ValueError):
        s.upsert("t", many.limit(1).union(many.limit(1)), "k")
    with pytest.raises(ValueError):
        s.upsert("t", spark.createDataFrame([(None, "x")], "k string, v string"), "k")
    for n in range(3):
        s.upsert("t", many.limit(1).withColumn("v", F.lit(str(n))), "k")
    assert s.vacuum(1) >= 3 and s.read("t").count() == 1000 and s.vacuum(1) == 0


def test_models_are_called_in_batches(spark):
    from lawloom.operators import models

    sizes = spark.sparkContext.accumulator(0)

    def load():
        def call(texts):
            sizes.add(1)
            if "bad" in texts:
                raise RuntimeError
            assert len(texts) <= 2
            return [t.upper() for t in texts]

        return call

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", None, " ", "c", "bad", "d"])], "i int, t string").coalesce(1)
    got = [r.o for r in models.apply_model(df, "t", "o", models.batched(load, 2, per_second=1000), "string").collect()]
    assert got == ["A", "B", None, None, None, None, "D"] and sizes.value == 3
    tagger = lambda: lambda texts, labels: [[("  Viteza ", labels[0]), ("x", "other"), (" ", labels[0])] for _ in texts]
    units = spark.createDataFrame([("u1", "x"), ("u2", None)], "id string, content string")
    assert rows(models.tag(units, ["V"], tagger)) == [("viteza", "V", "u1", 1)]
    chat = models.batched(lambda: lambda prompts: ['{"questions": ["q?"]}' if "citește" in p else "no" for p in prompts])
    body = spark.createDataFrame([("a", None, "article", "citește", {}), ("b", None, "article", "altceva", {})], "id string, parent_id string, unit_type string, content string, meta_info map<string,string>")
    asked = {r.id: r.hypothetical_questions for r in enrich.enrich(body, enrich.hash_embedder(8), chat=chat).collect()}
    assert asked == {"a": ["q?"], "b": []}


def test_settings_and_stored_sparse_vectors(spark, monkeypatch):
    from lawloom.schemas import Settings

    monkeypatch.setenv("LAWLOOM_TOP_K", "7")
    monkeypatch.setenv("LAWLOOM_EDGE_TYPES", "PART_OF, REFERENCES")
    spark.conf.set("spark.lawloom.rrf_k", "60")
    s = Settings.load(spark)
    spark.conf.unset("spark.lawloom.rrf_k")
    assert (s.top_k, s.rrf_k, s.edge_types, s.batch) == (7, 60, ("PART_OF", "REFERENCES"), 50)
    units = spark.createDataFrame([(f"u{i}", None, "article", t, {}) for i, t in enumerate(["viteza maximă", "viteza", "altceva", ""])], "id string, parent_id string, unit_type string, content string, meta_info map<string,string>")
    points = enrich.to_points(enrich.enrich(units, enrich.hash_embedder(8), answer=lambda c: F.lit("none")))
    got = retrieval.stored_sparse_top(points, "Viteza, maximă?", 5).collect()
    weights = enrich.term_weights(units, "id", "content")
    want = {r.key: r.score for r in retrieval.sparse_top(weights, "Viteza, maximă?", 5).collect()}
    ids = {r.point_id: r.unit_id for r in points.collect()}
    assert {ids[r.point_id]: pytest.approx(r.score) for r in got} == want and len(want) == 2
    assert retrieval.stored_sparse_top(points, "?!", 5).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 8))
    x[7] = x[3]
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0] * 3), (903, [float("nan")] * 8)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + bad, "key long, v array<float>")
    u = np.float32(x).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u[:20] @ u.T, 12)
    want = {(q, int(i), n) for q in range(20) for n, i in enumerate(np.lexsort((np.arange(500), -s[q]))[:4], 1)}
    got = retrieval.nearest(df, [(q, np.float32(x[q]).tolist()) for q in range(20)], 4, "key", "v")
    assert {(r.query, r.key, r["rank"]) for r in got.collect()} == want
    assert retrieval.nearest(df.limit(0), [(0, [1.0] * 8)], 4, "key", "v").count() == 0 and retrieval.nearest(df, [], 4, "key", "v").count() == 0


def test_a_worker_stops_between_batches(spark, tmp_path):
    from lawloom.streaming import worker

    s = Store(spark, f"file://{tmp_path}/s")
    s.create("law_units", "id string, content string", "id")
    s.upsert("law_units", spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string"), "id")
    s.append("outbox", spark.createDataFrame([(0, "t", ["a", "zz"]), (1, "t", ["b"]), (0, "none", ["a"])], "batch_id long, task string, unit_ids array<string>"))
    done, other = [], []
    q = worker.consume(s, {"t": lambda u: done.extend(rows(u.select("id", "batch_id"))), "idle": lambda u: other.append(1)}, f"{tmp_path}/c", once=False)
    import time

    until = time.time() + 60
    while not done and time.time() < until:
        time.sleep(0.2)
    assert worker.stop(q) and not q.isActive and sorted(done) == [("a", 0), ("b", 1)] and not other
