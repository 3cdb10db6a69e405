"""Citations in the text of a unit: other units of the same act, and external laws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of citations.
_N = r"\d+(?:\.\d+)?"
RANGE = rf"art\.\s*({_N})\s*-\s*({_N})"
PARAGRAPH = rf"art\.\s*({_N})\s*alin\.\s*\(([a-z0-9.]+)\)"
ARTICLE = rf"art\.\s*({_N})"
RELATIVE = r"alin\.\s*\(([a-z0-9.]+)\)"
EXTERNAL = r"(Legea|Ordonan[tț][aă](?:\s+Guvernului|\s+de\s+urgen[tț][aă])?|Regulamentul\s*\(UE\))\s+nr\.\s*(\d+/\d{4})"
BASE = r"^(art_\d+(?:_\d+)?)"


def _dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("_"))


def internal_references(units: DataFrame, scope: Column | None = None) -> DataFrame:
    """``source_id, target_id`` once per citation of an article or paragraph in the content.

    Forms are tried in order at each place: a range of articles (its two ends), a paragraph of an article, an article,
    a paragraph of the unit's own article. References of a unit to itself are left out. With ``scope`` (a prefix of the
    ids, such as the act) ids are read behind it and targets put behind it.
    """
    def text(pattern: str, g: int) -> Column:
        return F.regexp_extract("m", rf"(?iU)^{pattern}$", g)

    own = F.col("id") if scope is None else F.expr("substring(id, length(scope) + 2)")
    base = F.nullif(F.regexp_extract(own, BASE, 1), F.lit(""))
    every = "|".join((RANGE, PARAGRAPH, ARTICLE, RELATIVE))
    rows = units.select(F.col("id"), *([scope.alias("scope")] if scope is not None else []), F.explode(F.regexp_extract_all("content", F.lit(f"(?iU){every}"), F.lit(0))).alias("m"))

    def article(g: Column) -> Column:
        return F.concat(F.lit("art_"), _dots(g))

    targets = (
        F.when(F.col("m").rlike(rf"(?iU)^{RANGE}$"), F.array(article(text(RANGE, 1)), article(text(RANGE, 2))))
        .when(F.col("m").rlike(rf"(?iU)^{PARAGRAPH}$"), F.array(F.concat(article(text(PARAGRAPH, 1)), F.lit("_alin_"), _dots(text(PARAGRAPH, 2)))))
        .when(F.col("m").rlike(rf"(?iU)^{ARTICLE}$"), F.array(article(text(ARTICLE, 1))))
        .when(base.isNotNull(), F.array(F.concat(base, F.lit("_alin_"), _dots(text(RELATIVE, 1)))))
        .otherwise(F.array().cast("array<string>"))
    )
    edges = rows.select(F.col("id").alias("source_id"), *(["scope"] if scope is not None else []), F.explode(targets).alias("target"))
    target = F.col("target") if scope is None else F.concat_ws("_", "scope", "target")
    return edges.select("source_id", target.alias("target_id")).where(F.col("source_id") != F.col("target_id"))


def external_references(units: DataFrame) -> DataFrame:
    """``source_unit_id, target_external_id, name, law_type`` once per citation of an external law."""
    rows = units.select(F.col("id").alias("source_unit_id"), F.explode(F.regexp_extract_all("content", F.lit(f"(?iU){EXTERNAL}"), F.lit(0))).alias("m"))
    kind = F.regexp_replace(F.initcap(F.trim(F.regexp_extract("m", f"(?iU){EXTERNAL}", 1))), r"(?i)\(ue\)", "(Ue)")
    number = F.regexp_extract("m", f"(?iU){EXTERNAL}", 2)
    key = F.concat(F.lower(F.get(F.split(kind, r"(?U)\s+"), F.lit(0))), F.lit("_"), F.replace(number, F.lit("/"), F.lit("_")))
    return rows.select("source_unit_id", key.alias("target_external_id"), F.concat(kind, F.lit(" nr. "), number).alias("name"), kind.alias("law_type"))
