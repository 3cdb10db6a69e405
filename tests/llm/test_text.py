"""Look-alikes, encodings, BK-tree, canonical mapping."""

import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawloom.llm import bktree, canonical, lookalikes, mojibake


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


words = st.text("abcă", max_size=7)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=30), st.lists(words, min_size=1, max_size=6), st.integers(0, 3))
def test_tree_finds_every_word_within(reference, asked, within):
    tree = bktree.BKTree(reference)
    got = {(asked[q], tree.words[n], int(d)) for q, n, d in zip(*tree.search(asked, [within] * len(asked)), strict=True)}
    assert got == {(q, w, d) for q in asked for w in set(reference) if (d := edit(q, w)) <= within}


ORDINARY = ["", None, "viteza se reduce", "Pârât: ștersă țintă „așa” – § 3 m²", "în original: полиция", "în original: δρόμος.", "père, où, Noël", "0rdinar1 ed"]
ODD = {
    "ｒｅｍｏｒｃａ": "remorca", "perm​is": "permis", "a\xa0b": "a b", "fiﬁx ﬁșă": "fifix fișă", "fişa": "fișa", "aсtul": "actul", "АNЕХА": "ANEXA", "și": "și", "într‑o": "într-o",
    "се prevede legea": "ce prevede legea", "mіnіm": "minim", "δρόμος": "δρόμος", "дoрога": "дорога", "CΑPITOLUL": "CAPITOLUL", "ănsamblu　de": "ănsamblu de", "х" * 3 + " și " + "a" * 20_000: "xxx și " + "a" * 20_000,
}


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_text_stays(text):
    assert not lookalikes.suspicious(text) and lookalikes.normalize(text) == text


@pytest.mark.parametrize("text", ODD)
def test_lookalikes_are_found_and_normalized(text):
    assert lookalikes.suspicious(text)
    fixed = lookalikes.normalize(text)
    assert fixed == ODD[text] and lookalikes.normalize(fixed) == fixed and not lookalikes.suspicious(fixed)


PUBLISHED = {"Ꭺctul": "Actul", "Ꮲrima": "Prima", "ⲟra": "ora", "ꓮctul": "Actul", "ɴorma": "norma", "Ϲу și legea": "Cy și legea", "Ӏegea": "legea", "ӀNAINTE": "INAINTE", "ꓮꓐ și legea": "AB și legea"}


@pytest.mark.parametrize("text", PUBLISHED)
def test_lookalikes_of_the_published_data(spark, text):
    table = lookalikes.Table(lookalikes.published(spark))
    assert len(table.letters) > 250
    fixed = lookalikes.normalize(text, table)
    assert lookalikes.suspicious(text, table) and fixed == PUBLISHED[text] and not lookalikes.suspicious(fixed, table)
    for ordinary in ORDINARY:
        assert not lookalikes.suspicious(ordinary, table) and lookalikes.normalize(ordinary, table) == ordinary


class OtherLibrary:
    """A JVM whose Unicode library is another one."""

    def __init__(self, jvm, icu):
        self.jvm, self.com = jvm, SimpleNamespace(ibm=SimpleNamespace(icu=icu))

    def __getattr__(self, name):
        return getattr(self.jvm, name)


def lost(_):
    raise OSError("connection lost")


SKELETONS = {"no library": None, "connection lost": lost, "no answer": lambda _: None, "other number": lambda text: text.replace("\n", ""), "no data": lambda text: text}


@pytest.mark.parametrize("failure", SKELETONS)
def test_a_failure_of_the_published_data_is_an_error(spark, monkeypatch, failure):
    df, key = spark.createDataFrame([("1", "ꓮꓐ și legea"), ("2", "legea")], "id string, content string"), F.col("id")
    assert [tuple(r) for r in lookalikes.find_lookalikes(df, key, "content").collect()] == [("1", "AB și legea")]
    checker = SimpleNamespace(getSkeleton=SKELETONS[failure])
    icu = SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=lambda: checker))))
    jvm = spark.sparkContext._jvm
    monkeypatch.setattr(type(spark.sparkContext), "_jvm", OtherLibrary(jvm, icu if SKELETONS[failure] else jvm.com.ibm.nosuch))
    with pytest.raises(RuntimeError, match="published look-alikes"):
        lookalikes.find_lookalikes(df, key, "content")


def test_prefilter_lets_all_odd_texts_through(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*ORDINARY, *ODD, next(iter(ODD))])]
    df = spark.createDataFrame(rows, "id long, content string, row_key string")
    got = lookalikes.find_lookalikes(df, F.col("id").cast("string"), "content").collect()
    assert {int(r.row_key) for r in got} == set(range(len(ORDINARY), len(rows)))
    assert lookalikes.find_lookalikes(df.limit(0), F.col("id").cast("string"), "content").count() == 0


NAMES = [(1, "aparat de notificare expirat"), (2, "radar de vamă mobil"), (3, "trecere de autostradă fix"), (4, None), (5, " ")]
FORMS = {
    "Aparat De Notificare Expirat nr. 24": 1, "apara de notificare": 1, "aparatului de notificări expirat": 1, "expirat, aparat notificare": 1, "apar. de notif. vechi": 1, "аparаt_de_nоtificare": 1,
    "aparat de n0tificare": 1, "radar de vamele": 2, "raadr vamă": 2, "trecere de autostradă ftx": 3, "aparat de vamă fix": -1, "aparat": -1, "lovitur zemetrin": -1, "​": -1, "12": -1, "x" * 5000: -1,
}


def test_forms_map_to_entries(spark):
    df = spark.createDataFrame([(i, f, 7) for i, f in enumerate(FORMS)] + [(0, next(iter(FORMS)), 7), (90, None, 7), (91, "  ", 7), (92, "radar de vamă mobil", 7)], "entity_id long, surface_form string, name int")
    names = spark.createDataFrame([(*n, "x") for n in NAMES], "concept_id long, name string, surface_form string")
    free = canonical.free_values(df, "entity_id", "surface_form", names, "name")
    got = {r.row_key: r.entry_id for r in canonical.map_to_reference(free, "entity_id", "surface_form", names, "concept_id", "name").collect()}
    assert got == dict(enumerate(FORMS.values()))
    whole = sorted(map(tuple, canonical.map_to_reference(free, "entity_id", "surface_form", names, "concept_id", "name").collect()))
    for shard in (1, 3):
        sharded = canonical.map_to_reference(free, "entity_id", "surface_form", names, "concept_id", "name", shard=shard)
        assert sorted(map(tuple, sharded.collect())) == whole
    assert {r.entry_id for r in canonical.map_to_reference(df, "entity_id", "surface_form", names.limit(0), "concept_id", "name").collect()} == {-1}
    assert canonical.map_to_reference(df.limit(0), "entity_id", "surface_form", names, "concept_id", "name").count() == 0


CLEAN = "Pârâtul „Luvartwick” locuiește în Vasaposcița și a reținut bicicleta pliabilă – § 4. L’arrêté nº 12 où l’été. Hotărârea cântărire școlar susține instanța după împotriva."
CHANNELS = [("cp1252", "utf-8"), ("latin_1", "utf-8"), ("cp1250", "utf-8"), ("iso8859_2", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8")]


def garble(text, codec):
    return mojibake._read(text, codec)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    ws = CLEAN.split()
    rows = [(i, " ".join(rng.choices(ws, k=60)) + (" São Valteiro (Þorvaldsnes)" if i % 10 == 0 else "")) for i in range(200)]
    return mojibake.corpus_model(spark.createDataFrame(rows, "doc_id long, text string"), "text")


@pytest.mark.parametrize("codec", [c for c, _ in CHANNELS])
def test_wrong_readings_of_utf8_are_undone(corpus, codec):
    wrong = garble(CLEAN, codec)
    assert wrong != CLEAN and mojibake.restore(wrong, corpus) == (CLEAN, True)
    assert mojibake.restore("Un text curat, nº 3. " + wrong, corpus) == ("Un text curat, nº 3. " + CLEAN, True)


def test_twice_decoded(corpus):
    assert mojibake.restore(garble(garble(CLEAN, "cp1252"), "cp1252"), corpus) == (CLEAN, True)


def test_one_byte_encodings_and_lost_letters(corpus):
    text = "reținut în Vasaposcița și susține după școlar"
    swapped = text.encode("iso8859_16").decode("cp1252")
    assert mojibake.restore(swapped, corpus) == (text, True)
    lost = "".join("�" if ord(c) > 127 else c for c in text)
    assert mojibake.restore(lost, corpus) == (text, True)
    assert mojibake.restore("bicicleta re?inut acolo", corpus) == ("bicicleta reținut acolo", True)


@pytest.mark.parametrize("text", ["El señor acolo", "São Paulo", "Łódź", "полиция", "κείμενο"])
def test_letters_that_the_corpus_does_not_have(corpus, text):
    for codec in ("latin_1", "cp1252"):
        assert mojibake.restore("Un text: " + garble(text, codec), corpus) == ("Un text: " + text, True)


def test_lost_bytes_are_wildcards(corpus):
    text = "bicicleta reținut în Vasaposcița și susține după școlar"
    wrong = garble(text, "cp1252")
    for place in [i for i, c in enumerate(wrong) if not c.isascii()]:
        assert mojibake.restore(wrong[:place] + "\ufffd" + wrong[place + 1 :], corpus) == (text, True)
    by_byte = "".join("\ufffd" * len(c.encode()) if not c.isascii() else c for c in text)
    assert mojibake.restore(by_byte, corpus) == (text, True)


def test_best_way_equals_brute_force(corpus):
    from itertools import product

    for run, way in (("re\ufffdinu\ufffd", mojibake.LOST), ("\ufffdcolar", mojibake.LOST), ("re\ufffd\ufffdinut", mojibake.LOST_BYTES)):
        edges = mojibake._edges(run, way, corpus)
        got, score = mojibake._viterbi(edges, corpus)
        holes = run.replace("\ufffd\ufffd", "\ufffd") if way == mojibake.LOST_BYTES else run
        letters = [u for n, us in corpus.alphabet.items() for u in us if way == mojibake.LOST or n == 2]
        best = (-1e9, "")
        for fill in product(letters, repeat=holes.count("\ufffd")):
            it = iter(fill)
            word = "".join(next(it) if c == "\ufffd" else c for c in holes)
            padded = "^^" + word + "$"
            s = sum(corpus.step(padded[i : i + 2], padded[i + 2]) for i in range(len(padded) - 2)) + sum(corpus.bonus(w) for w in mojibake.re.findall(r"[^\W\d_]+", word) if w in corpus.words)
            best = max(best, (s + (mojibake.SEQUENCE if way == mojibake.LOST_BYTES else 0), word))
        assert got == best[1] and score == pytest.approx(best[0])


@pytest.mark.parametrize("text", [None, "", CLEAN, "(São Valteiro) și (Þorvaldsnes)", "(JOANÃO)", "(¿Quién?) (£ 300)", "Åsmundgård Ærnstrand Ÿvrelle", "requête nº 12", "a" * 50_000])
def test_sound_text_stays(corpus, text):
    assert mojibake.restore(text, corpus) == (text, False)


def test_documents(spark):
    rows = [(1, CLEAN, "x"), (2, garble(CLEAN, "cp1252"), "y"), (3, None, None), (4, "", "z"), (2, garble(CLEAN, "cp1252"), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = mojibake.restore_documents(df, "doc_id", "text").collect()
    assert [(r.key, r.restored) for r in got] == [(2, CLEAN)] * 2
    assert mojibake.restore_documents(df.limit(0), "doc_id", "text").count() == 0
