from pyspark.sql import functions as F

from lawloom.operators import graph, parse
from lawloom.operators.references import external_references, internal_references
from lawloom.sources.corpus import read_corpus, read_ontology

TEXT = """Text introductiv fără marcaj
CAPITOLUL I: DISPOZIŢII GENERALE
SECŢIUNEA 1 Reguli
Art. 5
Text fără număr.
(1) Conform art. 6 alin. (2) și Legea nr. 286/2009:
a) prima literă;
b) vezi alin. (1.1)
1. punctul unu - definiție
(1.1) art. 7 - 9
Secțiunea a 2-a
Art. 6.2. (continuare)
CAPITOLUL II
Art. 7
a) literă fără alineat
"""
EXPECTED = [
    ("cap_I", None, "chapter", "CAPITOLUL I: DISPOZIȚII GENERALE", {"title": "DISPOZIȚII GENERALE"}),
    ("cap_I_sec_1", "cap_I", "section", "SECȚIUNEA 1 Reguli", {"title": "Reguli", "number": "1"}),
    ("art_5", "cap_I_sec_1", "article", "Art. 5 Text fără număr.", {"number": "5"}),
    ("art_5_alin_1", "art_5", "paragraph", "(1) Conform art. 6 alin. (2) și Legea nr. 286/2009:", {"number": "1"}),
    ("art_5_alin_1_lit_a", "art_5_alin_1", "letter_item", "a) prima literă;", {"letter": "a"}),
    ("art_5_alin_1_lit_b", "art_5_alin_1", "letter_item", "b) vezi alin. (1.1)", {"letter": "b"}),
    ("art_5_pct_1", "art_5_alin_1", "num_item", "1. punctul unu - definiție", {"number": "1"}),
    ("art_5_alin_1_1", "art_5", "paragraph", "(1.1) art. 7 - 9", {"number": "1.1"}),
    ("cap_I_sec_a_2-a", "cap_I", "section", "Secțiunea a 2-a", {"title": "Secțiunea a 2-a", "number": "a_2-a"}),
    ("art_6_2", "cap_I_sec_a_2-a", "article", "Art. 6.2. (continuare)", {"number": "6.2"}),
    ("cap_II", None, "chapter", "CAPITOLUL II", {"title": "CAPITOLUL II"}),
    ("art_7", "cap_II", "article", "Art. 7", {"number": "7"}),
    ("art_7_lit_a", "art_7", "letter_item", "a) literă fără alineat", {"letter": "a"}),
]


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.txt").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def units(spark, folder, **files):
    return parse.parse_lines(read_corpus(spark, write(folder, **files)))


def test_hierarchy(spark, tmp_path):
    rows = units(spark, tmp_path, x=TEXT).orderBy("unit_seq").collect()
    assert [(r.id, r.parent_id, r.unit_type, r.content, r.meta_info) for r in rows] == EXPECTED


def test_line_ends_encoding_and_mark(spark, tmp_path):
    rows = units(spark, tmp_path, x=b"\xef\xbb\xbfArt. 1\r\nunu\t \rdoi\n", y=b"Art. 2 \xba\xfe").orderBy("id").collect()
    assert [r.content for r in rows] == ["Art. 1 unu\t doi", "Art. 2 șț"]


def test_odd_markers(spark, tmp_path):
    rows = units(spark, tmp_path, a="Titlul de proprietate", b="a) x", c="1. x", d="(1) x", e="nimic", f="").collect()
    assert sorted((r.id, r.parent_id) for r in rows) == [("None_alin_1", None), ("None_lit_a", None), ("anexa_pct_1", None), ("cap_d", None)]


def test_duplicates_and_last_wins(spark, tmp_path):
    u = units(spark, tmp_path, a="Art. 1 vechi", b="Art. 1 nou\nArt. 2")
    assert [tuple(r) for r in parse.duplicates(u).collect()] == [("art_1", 2)]
    assert sorted(r.content for r in parse.last_wins(u).collect()) == ["Art. 1 nou", "Art. 2"]
    assert parse.rejected(u).count() == 0


def test_references(spark, tmp_path):
    u = units(spark, tmp_path, x=TEXT)
    edges = {tuple(r) for r in internal_references(u).collect()}
    assert edges == {("art_5_alin_1", "art_6_alin_2"), ("art_5_alin_1_lit_b", "art_5_alin_1_1"), ("art_5_alin_1_1", "art_7"), ("art_5_alin_1_1", "art_9")}
    kept = graph.existing(internal_references(u), "source_id", u, "id", "target_id", u, "id")
    assert {tuple(r) for r in kept.collect()} == {("art_5_alin_1_lit_b", "art_5_alin_1_1"), ("art_5_alin_1_1", "art_7")}
    lost = graph.dangling(internal_references(u), "source_id", u, "id", "target_id", u, "id")
    assert {tuple(r) for r in lost.collect()} == {("art_5_alin_1", "art_6_alin_2", "target"), ("art_5_alin_1_1", "art_9", "target")}
    assert graph.part_of(u).count() == 11


def test_external_references(spark):
    u = spark.createDataFrame([("u", "Legea nr. 286/2009, Ordonanța de urgență nr. 195/2002; REGULAMENTUL (UE) nr. 168/2013 și legea nr.1/2000"), ("v", None)], "id string, content string")
    rows = {(r.target_external_id, r.name, r.law_type) for r in external_references(u).collect()}
    assert rows == {
        ("legea_286_2009", "Legea nr. 286/2009", "Legea"), ("ordonanța_195_2002", "Ordonanța De Urgență nr. 195/2002", "Ordonanța De Urgență"),
        ("regulamentul_168_2013", "Regulamentul (Ue) nr. 168/2013", "Regulamentul (Ue)"), ("legea_1_2000", "Legea nr. 1/2000", "Legea"),
    }


def test_scoped_references(spark):
    u = spark.createDataFrame([("a1_art_5_alin_1", "vezi alin. (2), art. 5 și art. 9.1")], "id string, content string")
    edges = {r.target_id for r in internal_references(u, F.regexp_extract("id", r"^(a\d+)_", 1)).collect()}
    assert edges == {"a1_art_5_alin_2", "a1_art_5", "a1_art_9_1"}


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"domain": "d",\n "labels": ["A", "B"]}')
    assert [tuple(r) for r in read_ontology(spark, str(tmp_path / "o.json")).orderBy("n").collect()] == [("A", 0), ("B", 1)]
