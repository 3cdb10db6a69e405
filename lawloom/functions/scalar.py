"""Scalar functions composed of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of DNS names, under which ids of points are made.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
WORDS = r"[^\p{L}\p{N}]+"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is null, has no length, or they differ in size."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")


def snippet(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def questions_of(answer: Column, most: int = 3) -> Column:
    """The questions of a model's JSON answer, at most ``most``; none if it can't be read."""
    parsed = F.from_json(answer, "questions array<string>").getField("questions")
    return F.slice(F.coalesce(parsed, F.array().cast("array<string>")), 1, most)


def entity_text(text: Column) -> Column:
    """Trimmed and lower-case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), F.lit(""))

