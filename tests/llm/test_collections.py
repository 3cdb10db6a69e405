"""Clusters, vectors, packing, leaks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import density, leakage, packing, similar
from lawloom.llm import queries as llm_queries

TERMS = [("senzor de pevivastrand jarbend", ["Senzor De Pevivastrand Jarbend", "senzzor de pevivastrand jarbend", "snezor de pvivastrand jarbend", "senzor ed pevivastrand jarbend", "senzor de peviv. jarbend", "27. senzor de pevivastrand jarbend",
          "jarbend, senzor pevivastrand", "senzor_de_pevivastrand_jarbend", "senzorului de pevivastrand jarbend", "senzorpevivastrand jarbend", "sеnzоr de pevivastrand jarbend"]),
         ("senzor de pevivastrand molugor", ["senzor de pevivastrand mo1ugor"]), ("fișă pentru zivotan lumireg", ["fișele pentru zivotan lumireg", "fișă pentrului zivotan lumireg", "fsiă pentru zivotan lumireg"]), ("senzor de pevivastrand jarbend (alt tip)", [])]


def test_spellings_of_a_term_form_a_cluster(spark):
    forms = [(f, i, 1) for i, (t, fs) in enumerate(TERMS) for f in [t, *fs]]
    rows = [*forms, forms[0], (None, 9, 1), ("", 10, 1), ("  ", 11, 1), ("77", 12, 1)]
    df = spark.createDataFrame(rows, "form string, truth int, cluster int")
    c = density.cluster_forms(df.select("form", "cluster"), "form")
    members = {r.form: r.cluster for r in c.members.collect()}
    of = {f: i for f, i, _ in rows if f is not None}
    assert set(members) == set(of)
    assert {(a, b) for a in members for b in members if a < b and members[a] == members[b]} == {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    pairs = {tuple(r) for r in c.pairs().collect()}
    assert pairs == {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    links = {r.form: r.representative for r in c.links().collect()}
    assert set(links) == set(of) and all((links[a] == links[b]) == (of[a] == of[b]) for a in of for b in of)
    described = c.describe().orderBy(F.desc("size")).first()
    assert described["size"] == 12 and TERMS[0][0] in described["typical_forms"] and len(described["typical_forms"]) == 3
    assert density.cluster_forms(df.select("form").limit(0), "form").pairs().count() == 0


def test_abbreviations_meet_each_other(spark):
    forms = ["senzor pevivas. jarb.", "senzor peviv. jarbend", "senz. pevivastra. jarbend"]
    c = density.cluster_forms(spark.createDataFrame([(f,) for f in forms], "form string"), "form")
    assert c.pairs().count() == 3


def test_peaks_by_density_and_distance(spark):
    # two terms one edit too many apart for one, each with spellings of its own, and a lone spelling as far from the first
    near = {"abcdefghijkl mnopqr stuvwx": 5, "abcdefghxyzw mnopqr stuvwx": 4}
    forms = [f"{t}{' ' * (i + 1)}(nr. {i})" for t, n in near.items() for i in range(n)] + ["abcdzzzzijkl mnopqr stuvwx"]
    c = density.cluster_forms(spark.createDataFrame([(f,) for f in forms], "form string"), "form")
    of = {r.form: r.cluster for r in c.members.collect()}
    assert len({of[f] for f in forms[:5]}) == len({of[f] for f in forms[5:9]}) == 1 and of[forms[0]] != of[forms[5]] and of[forms[9]] == of[forms[0]]


def test_a_block_larger_than_its_hubs(spark, monkeypatch):
    rng = random.Random(5)
    term = "aparat notificarelor expirat"
    forms = {term}
    while len(forms) < 120:
        ws = term.split()
        i = rng.randrange(3)
        k = rng.randrange(1, len(ws[i]))
        ws[i] = ws[i][:k] + rng.choice("bcdfghkmpqvwz") + ws[i][k:]
        forms.add(" ".join(ws))
    monkeypatch.setattr(density, "HUBS", 4)
    c = density.cluster_forms(spark.createDataFrame([(f,) for f in forms], "form string"), "form")
    assert c.members.select("cluster").distinct().count() == 1 and c.pairs().count() == 120 * 119 // 2


def test_neighbours_do_not_depend_on_the_size_of_a_slice(spark, monkeypatch):
    rng = random.Random(8)
    spellings = set()
    while len(spellings) < 60:
        ws = ["alt", "tip", *rng.choice([["jarbend", "senzor"], ["molugor", "radar"], ["lumireg", "aparat"]])]
        i = rng.randrange(2, 4)
        k = rng.randrange(1, len(ws[i]))
        ws[i] = ws[i][:k] + rng.choice("bcdfghkmpqvwz") + ws[i][k:]
        spellings.add(" ".join(sorted(ws)))
    named = sorted(spellings)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if density.form_costs([(named[i], named[j])])[0] <= density.CUTOFF}
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(named)], "id long, spelling string, forms long")
    for size in (4, 1000):
        monkeypatch.setattr(density, "HUBS", size)
        got = [(r.a, r.b) for r in density._neighbours(df).collect()]
        assert set(got) == want and len(got) == len(want)


def brute(vectors, k, floor):
    keys = sorted(vectors)
    x = np.stack([vectors[q] for q in keys]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, row in enumerate(np.round(s, 12)):
        for j in np.argsort(-row, kind="stable")[:k]:  # the keys are in order, so equal ones stay so
            if s[i, j] >= floor:
                out.add((keys[i], keys[j]))
    return out


def collection(n=3000, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    out = {f"v{i:05d}": rng.standard_normal(dim) * rng.uniform(0.5, 2) for i in range(n)}
    for i in range(0, n, 9):
        out[f"w{i:05d}"] = out[f"v{i:05d}"] * 1.7 + rng.standard_normal(dim) * 0.2
    return out


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rot = similar.rotation(64)
    assert np.allclose(rot @ rot.T, np.eye(64), atol=1e-5)
    est, err = similar.estimate(*similar.encode(x, rot), x, rot)
    off = ~np.eye(400, dtype=bool)
    assert (np.abs(est - x @ x.T) <= err[:, None])[off].mean() > 0.98
    assert abs((est - x @ x.T)[off].mean()) < 0.005


def test_near_vectors_are_found(spark):
    vectors = collection()
    bad = [("b1", None), ("b2", [0.0] * 64), ("b3", [1.0] * 32), ("b4", [float("nan")] * 64), ("b5", [None] * 64), (None, [1.0] * 64), ("b6", [float("inf")] * 64)]
    rows = [(k, [float(x) for x in v], 1) for k, v in vectors.items()]
    df = spark.createDataFrame(rows + rows[:50] + [(*b, 1) for b in bad], "id string, embedding array<float>, h1 int")
    got = {(r.key, r.neighbour) for r in similar.similar(df, "id", "embedding", 64, 5, 0.9).collect()}
    want = brute({k: np.float32(v) for k, v in vectors.items()}, 5, 0.9)
    assert got <= want and len(got) >= 0.98 * len(want) > 300
    assert similar.similar(df.limit(0), "id", "embedding", 64, 5, 0.9).count() == 0


def test_top_k_at_any_cosine(spark):
    vectors = collection(2000, seed=4)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, embedding array<float>")
    near = similar.similar(df, "id", "embedding", 64, 5, probes=16, per_cell=100, asks=F.col("id").endswith("00"))
    got = {(r.key, r.neighbour) for r in near.collect()}
    want = {p for p in brute({k: np.float32(v) for k, v in vectors.items()}, 5, -1) if p[0].endswith("00")}
    assert len(got & want) >= 0.9 * len(want) and {k for k, _ in got} == {k for k, _ in want}


def test_neighbours_of_few_are_exact_at_any_size(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x[101] = x[200]  # a copy that doesn't ask comes first
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").coalesce(1).sortWithinPartitions(F.col("vec_id") != 101)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.neighbour_id) for r in llm_queries.QUERIES["p4_neighbours"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u[::100] @ u.T, 12)
    s[np.arange(200), np.arange(200) * 100] = -2
    want = {(100 * i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row, kind="stable")[:5]}
    assert got == want


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.standard_normal(64)]
    rows = [(f"c{i:04d}", v) for i in range(900)] + [(f"r{i:04d}", [float(x) for x in rng.standard_normal(64)]) for i in range(1800)]
    near = similar.similar(spark.createDataFrame(rows, "id string, embedding array<float>"), "id", "embedding", 64, 5, 0.9).collect()
    assert len(near) == 900 * 5 and all(r.neighbour in {f"c{i:04d}" for i in range(6)} and r.cosine > 0.999 for r in near)


def test_best_fit_and_tree(spark):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 5000)
    bins, loads = packing.best_fit(sizes, 100)
    assert loads.max() <= 100 and (np.bincount(bins, sizes) == loads).all() and len(loads) <= -(-sizes.sum() // 100) * 1.02 + 1
    rows = [(i, int(s), "x") for i, s in enumerate(sizes)] + [(9000, 250, "x"), (9001, 0, "x"), (9002, None, "x"), (9003, 100, "x"), (0, 7, "x")]
    df = spark.createDataFrame(rows, "key long, n_tokens long, bin string")
    packed = packing.pack(df, 100, per_task=300).toPandas()
    held = packed[packed.container.notna()]
    assert held.groupby("container").n_tokens.sum().max() <= 100 and packed.n_tokens.sum() == sum(r[1] or 0 for r in rows)
    assert sorted(packed[packed.key == 9000].n_tokens) == [50, 100, 100] and packed[packed.key == 9000].first_token.tolist() and len(packed) == len(rows) + 2
    assert set(packed[packed.container.isna()].key) == {9001, 9002}
    # seventeen tasks of 300 large items each: their rests are merged whole, which costs some 2 % against one task
    assert held.container.nunique() <= -(-int(held.n_tokens.sum()) // 100) * 1.03 + 1
    few = packing.pack(df, 100, per_task=300, max_open=40)
    assert few.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 100").count() == 0
    assert few.agg(F.sum("n_tokens")).first()[0] == packed.n_tokens.sum() and few.select("container").distinct().count() <= 1.05 * held.container.nunique()
    half = packing.pack(spark.createDataFrame([(i, 51) for i in range(50)], "key long, n_tokens long"), 100)
    assert half.select("container").distinct().count() == 50
    assert packing.pack(df.limit(0), 100).count() == 0


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "Hotărârea nr. 5"), (2, None), (3, ""), (4, "a" * 3000)], "doc_id long, text string")
    got = {r.key: r.n_tokens for r in packing.count_tokens(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == 0 and got[1] == len(packing._encoding(packing.default_tokenizer()).encode_ordinary("Hotărârea nr. 5")) and got[4] > 100


ITEM = "De vreme ce Minuescu a reparat dispozitivul de urmărire, regula din art. 340 pct. 5 cedează față de Decizia nr. 229/2023 și rămâne valabilă."


def leaks_of(index, text):
    return {i: n for (_, i), n in index.leaks([(0, leakage.words(text))]).items()}


@pytest.mark.parametrize("n,leaks", [(12, True), (11, False)])
def test_a_run_of_words_leaks(n, leaks):
    index = leakage.Index([(1, ITEM), (2, "cel mult " * 20), (3, "scurt"), (4, "")])
    run = " ".join(leakage.words(ITEM)[3 : 3 + n])
    assert (leaks_of(index, f"Altceva {run.upper()} iar apoi") == {1: n}) is leaks
    assert leaks_of(index, "") == {} and leaks_of(index, "x " * 20_000) == {}
    assert leakage.Index([]).leaks([(0, ["a"] * 30)]) == {}


@pytest.mark.parametrize("before,n", [(0, 200), (70, 60), (80, 20), (5, 97)])
def test_a_run_is_counted_whole(before, n):
    index = leakage.Index([(1, " ".join(f"w{i}" for i in range(n))), (2, " ".join(f"x{i}" for i in range(90)))])
    lead = [f"x{i}" for i in range(before)]
    assert leaks_of(index, " ".join([*lead, *(f"w{i}" for i in range(n)), *lead]))[1] == n
    cut = [*lead, *(f"w{i}" for i in range(n) if i != 15)]
    assert leaks_of(index, " ".join(cut))[1] == max(15, n - 16)


def common_run(a, b):
    best, before = 0, {}
    for x in a:
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = before.get(j - 1, 0) + 1
                best = max(best, now[j])
        before = now
    return best


def test_search_equals_brute_force():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(12, 40)))) for i in range(200)]
    index = leakage.Index(items)
    split = {i: leakage.words(t) for i, t in items}
    for _ in range(40):
        ws = [w for _ in range(4) for w in (split[rng.randrange(200)][: rng.randrange(5, 20)] + rng.choices(vocabulary + ["zz"], k=3))]
        assert leaks_of(index, " ".join(ws)) == {i: n for i in split if (n := common_run(ws, split[i])) >= 12}


def test_blocks_below_the_threshold_are_skipped():
    rng = random.Random(9)
    topics = [[f"t{k}w{i}" for i in range(80)] for k in range(20)]
    items = [(100 * k + i, " ".join(rng.choices(topics[k], k=40))) for k in range(20) for i in range(30)]
    index = leakage.Index(items)
    texts = [(i, leakage.words(items[i * 7][1])[5:25] + [w for t in topics for w in rng.choices(t, k=2)]) for i in range(60)]
    found = index.leaks(texts)
    assert found == {(k, i): n for k, ws in texts for i, t in items if (n := common_run(ws, leakage.words(t))) >= 12}
    assert 0 < index.scored < index.asked / 2


def test_leaks_in_documents(spark):
    wrong = ITEM.encode().decode("latin_1")
    docs = [(1, f"Antet.\n{ITEM}", 5), (2, f"Nimic {wrong} gata", 5), (3, None, 5), (4, "", 5), (1, f"Antet.\n{ITEM}", 5), (5, ITEM.replace(" ", "\n  ").replace("ă", "ă"), 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "prea scurt", "x")], "item_id long, text string, doc_id string")
    items = items.union(spark.createDataFrame([(13, ITEM.replace("Minuescu", "Altul"), "x")], items.schema))
    for shard in (leakage.SHARD, 1):
        got = sorted((r.key, r.item_key) for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text", shard=shard).collect())
        assert got == [(d, i) for d in (1, 2, 5) for i in (10, 13)]
    assert {r.key for r in leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text", restored=False).collect()} == {1, 5}
    leaks = leakage.find_leaks(df, "doc_id", "text", items, "item_id", "text")
    answers = spark.createDataFrame([(10, "antet, nimic"), (13, None)], "item_id long, answer string")
    shares = {(r.key, r.item_key): r.answer_share for r in leakage.answer_overlap(leaks, df, "doc_id", "text", answers, "item_id", "answer").collect()}
    assert shares == {(1, 10): 0.5, (2, 10): 0.5, (5, 10): 0.0} | {(d, 13): None for d in (1, 2, 5)}
    assert leakage.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


@pytest.mark.parametrize("floor", [0.9, -1.0])
def test_near_duplicates_give_few_pairs(spark, monkeypatch, floor):
    rng = np.random.default_rng(11)
    base = rng.standard_normal(64)
    vectors = {f"n{i:04d}": base + rng.standard_normal(64) * 1e-3 for i in range(2000)} | {f"r{i:04d}": rng.standard_normal(64) for i in range(500)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, embedding array<float>")
    sizes = {}
    write = similar.materialize

    def counted(table, name, *partitions):
        out = write(table, name, *partitions)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    got = {(r.key, r.neighbour) for r in similar.similar(df, "id", "embedding", 64, 5, floor, probes=3 if floor > -1 else None).collect()}
    want = brute({k: np.float32(v) for k, v in vectors.items()}, 5, floor)
    assert len(got & want) >= (0.97 if floor > -1 else 1) * len(want) and sizes["pairs"] < 4 * 5 * 2500
