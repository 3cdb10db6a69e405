"""Lines of legal text to a typed hierarchy of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawloom.schemas import UNIT_COLUMNS, UNIT_TYPES

# The markers that open a unit, in the order in which they are tried.
MARKERS = {
    "CHAPTER": r"(?iU)^(CAPITOLUL|TITLUL)\s+([IVXLCDM]+)(?::\s*(.*))?",
    "SECTION": r"(?iU)^SEC[TȚ]IUNEA\s+(?:nr\.\s*)?(\d+|a\s+[a-z0-9-]+-a)(?:\s*(.*))?",
    "ARTICLE": r"(?iU)^Art\.\s*(\d+(?:\.\d+)?)\.?\s*(.*)",
    "PARAGRAPH": r"(?U)^\((\d+(?:\.\d+)?)\)\s*(.*)",
    "LETTER": r"(?U)^([a-z])\)\s*(.*)",
    "NUMBERED": r"(?U)^(\d+(?:\.\d+)?)\.\s*(.*?)(?:\s*-\s*(.*))?$",
}
TYPE_OF = {"CHAPTER": "chapter", "SECTION": "section", "ARTICLE": "article", "PARAGRAPH": "paragraph", "LETTER": "letter_item", "NUMBERED": "num_item"}


def token(line: Column) -> Column:
    """The kind of a line: the first marker that it begins with, else TEXT."""
    kind = F.when(line.rlike(MARKERS["CHAPTER"]), "CHAPTER")
    for name, pattern in list(MARKERS.items())[1:]:
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("TEXT")


def _group(kind: Column, line: Column, **groups: int) -> Column:
    """The regex group of a line by its kind; null for other kinds."""
    out = F.lit(None).cast("string")
    for name, g in groups.items():
        out = F.when(kind == name, F.regexp_extract(line, MARKERS[name], g)).otherwise(out)
    return out


def lex(lines: DataFrame) -> DataFrame:
    """``file, line_no, line, token, number, title`` of each line."""
    kind, line = F.col("token"), F.col("line")
    number = _group(kind, line, CHAPTER=2, SECTION=1, ARTICLE=1, PARAGRAPH=1, LETTER=1, NUMBERED=1)
    title = F.coalesce(F.nullif(_group(kind, line, CHAPTER=3, SECTION=2), F.lit("")), line)
    return lines.select("file", "line_no", "line", token(line).alias("token")).select("*", number.alias("number"), F.when(kind.isin("CHAPTER", "SECTION"), title).alias("title"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Units of the lines: ``id, parent_id, unit_type, content, meta_info, source_file, unit_seq``.

    A line with a marker opens a unit, the lines up to the next marker belong to it; lines before the first are left
    out. The open chapter, section, article and paragraph of each line are running last values over the file, closed by
    the markers above them. One exchange by file; windows and the aggregation reuse it. A file is one task's work, so
    its lines need an order, not its size a bound on memory: the window spills.

    Defined cases: an empty table gives no units; a unit without an article hangs under none and has ``None`` or
    ``anexa`` in its id; ids are unique only per file (see :func:`last_wins`).
    """
    kind, number = F.col("token"), F.col("number")
    under = F.replace(number, F.lit("."), F.lit("_"))
    so_far = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)

    def running(value: Column) -> Column:
        return F.nullif(F.last(value, ignorenulls=True).over(so_far), F.lit(""))

    t = lex(lines)
    t = t.withColumn("chapter", running(F.when(kind == "CHAPTER", F.concat(F.lit("cap_"), number))))
    sec = F.concat(F.coalesce(F.concat("chapter", F.lit("_sec_")), F.lit("sec_")), F.replace(number, F.lit(" "), F.lit("_")))
    t = t.withColumn("section", running(F.when(kind == "SECTION", sec).when(kind == "CHAPTER", "")))
    t = t.withColumn("article", running(F.when(kind == "ARTICLE", F.concat(F.lit("art_"), under)).when(kind.isin("CHAPTER", "SECTION"), "")))
    par = F.concat(F.coalesce("article", F.lit("None")), F.lit("_alin_"), under)
    t = t.withColumn("paragraph", running(F.when(kind == "PARAGRAPH", par).when(kind.isin("CHAPTER", "SECTION", "ARTICLE"), "")))
    t = t.withColumn("unit_seq", F.sum((kind != "TEXT").cast("long")).over(so_far)).where("unit_seq > 0")
    item = F.coalesce("paragraph", "article")
    key = (
        F.when(kind == "CHAPTER", F.col("chapter")).when(kind == "SECTION", F.col("section")).when(kind == "ARTICLE", F.col("article")).when(kind == "PARAGRAPH", F.col("paragraph"))
        .when(kind == "LETTER", F.concat(F.coalesce(item, F.lit("None")), F.lit("_lit_"), number)).when(kind == "NUMBERED", F.concat(F.coalesce("article", F.lit("anexa")), F.lit("_pct_"), under))
    )
    parent = F.when(kind == "SECTION", F.col("chapter")).when(kind == "ARTICLE", F.coalesce("section", "chapter")).when(kind == "PARAGRAPH", F.col("article")).when(kind.isin("LETTER", "NUMBERED"), item)
    label = F.when(kind == "SECTION", F.replace(number, F.lit(" "), F.lit("_"))).otherwise(number)
    meta = (
        F.when(kind == "CHAPTER", F.create_map(F.lit("title"), "title")).when(kind == "SECTION", F.create_map(F.lit("title"), F.col("title"), F.lit("number"), label))
        .when(kind == "LETTER", F.create_map(F.lit("letter"), label)).otherwise(F.create_map(F.lit("number"), label))
    )
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_OF.items() for x in pair])
    head = F.when(kind != "TEXT", F.struct(key.alias("id"), parent.alias("parent_id"), kinds[kind].alias("unit_type"), meta.alias("meta_info")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    units = t.select("file", "unit_seq", "line_no", "line", head.alias("head")).groupBy("file", "unit_seq").agg(F.first("head", ignorenulls=True).alias("h"), body.alias("content"))
    return units.select("h.id", "h.parent_id", "h.unit_type", "content", "h.meta_info", F.col("file").alias("source_file"), "unit_seq")


def last_wins(units: DataFrame, *order: str) -> DataFrame:
    """One row per id: the greatest by ``order`` (default: file, then place in it). Combined before the shuffle."""
    order = order or ("source_file", "unit_seq")
    rest = [c for c in units.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return units.groupBy("id").agg(best).select("id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*units.columns)


def duplicates(units: DataFrame) -> DataFrame:
    """``id, n`` of ids that occur more than once."""
    return units.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def as_units(df: DataFrame) -> DataFrame:
    """The columns of stored units, in their order."""
    return df.select(*UNIT_COLUMNS)


def rejected(units: DataFrame) -> DataFrame:
    """Rows that break the declared form: a missing id, type or content, or an unknown type."""
    return units.where(F.col("id").isNull() | F.col("content").isNull() | F.col("unit_type").isNull() | ~F.col("unit_type").isin(*UNIT_TYPES))


def rejected_points(points: DataFrame) -> DataFrame:
    """Points without an id, a unit or a known kind of vector, or without the text that their kind has."""
    text = F.when(F.col("vector_type") == "content", F.col("content")).when(F.col("vector_type") == "question", F.col("question_text"))
    return points.where(F.col("point_id").isNull() | F.col("unit_id").isNull() | text.isNull())


def rejected_entities(raw: DataFrame) -> DataFrame:
    """Entities without a form (null or blank), a label or a unit."""
    blank = F.coalesce(F.trim("surface_form"), F.lit("")) == ""
    return raw.where(blank | F.col("category_label").isNull() | F.col("source_unit_id").isNull())


def rejected_edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges without one of their ends, or from a vertex to itself."""
    return edges.where(F.col(source).isNull() | F.col(target).isNull() | (F.col(source) == F.col(target)))
