"""Raw text files to clean lines, and the ontology file."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte values A0-FF of ISO-8859-2 in order, as the charset is not among those Spark decodes by default.
LATIN2 = bytes(range(0xA0, 0x100)).decode("iso8859_2")
LATIN1 = bytes(range(0xA0, 0x100)).decode("latin_1")


def decode(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else ISO-8859-2, which decodes any bytes; a leading byte order mark goes."""
    text = content.cast("string")
    central = F.translate(F.decode(content, "ISO-8859-1"), LATIN1, LATIN2)
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(central), "^\\uFEFF", "")


def clean(line: Column) -> Column:
    """Carriage returns, line feeds and spaces go from both ends (tabs stay); cedilla letters become comma letters."""
    return F.translate(F.btrim(line, F.lit("\r\n ")), "şţŞŢ", "șțȘȚ")


def split_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``file, line_no, line``: the clean, non-empty lines of each text, numbered as in the file from 0."""
    parts = files.select(F.col(path).alias("file"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "line"))
    return parts.select("file", "line_no", clean(F.col("line")).alias("line")).where(F.length("line") > 0)


def read_corpus(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """Lines of the files of a directory (not of its subdirectories) whose name fits; an absent directory is an error.

    Without a file there is a warning and there are no lines. Files have the order of their paths, which is that of the
    ``file`` column; see :func:`in_order`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    if not files.inputFiles():
        warnings.warn(f"no files {pattern} in {directory}", stacklevel=2)
    return split_lines(files.select("path", decode(F.col("content")).alias("text")))


def in_order(rows: DataFrame, file: str = "file", place: str = "line_no") -> DataFrame:
    """Rows in the order of the files' paths and of their places in them."""
    return rows.orderBy(file, place)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """``label, n`` in order; a file without labels gives none."""
    doc = spark.read.schema("domain string, version string, description string, labels array<string>").option("multiLine", True).json(path)
    return doc.select(F.posexplode("labels").alias("n", "label")).select("label", "n")
