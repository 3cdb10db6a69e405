"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import parallelism

#: Rows and bytes of values of both sides that a bucket should hold.
ROWS, BYTES = 100_000, 64 << 20
CELLS = "key string, diff string, left_value string, right_value string"


def latest_per_key(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest by ``order`` (nulls lowest), then by the values themselves.

    The maximum is combined on the map side, so a key that holds a large share of all rows is one row per task before
    anything is shuffled. Rows whose key is null are left out: they can't be aligned.
    """
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(rank).alias("r"))
    return best.select("key", *[F.col(f"r.v.v{i}").cast("string").alias(f"c{i}") for i in range(len(columns))])


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of two columns as numbers, equal where the keys are."""
    coded = pa.concat_arrays([*a.chunks, *b.chunks]).dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(a) + len(b) else np.zeros(0, np.int64)
    return coded[: len(a)], coded[len(a) :]


def _compare(columns: Sequence[str], left_name: str, right_name: str):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ca, cb = _codes(left["key"], right["key"])
        order = np.argsort(cb)
        b, cb = right.take(pa.array(order)), cb[order]
        a = left
        ka, kb = a["key"].combine_chunks(), b["key"].combine_chunks()
        at = np.searchsorted(cb, ca)
        both = np.zeros(len(ca), dtype=bool)
        inside = at < len(cb)
        both[inside] = cb[at[inside]] == ca[inside]
        matched = np.zeros(len(cb), dtype=bool)
        matched[at[both]] = True
        keys, kinds, lefts, rights = [], [], [], []

        def emit(key, kind, x=None, y=None):
            n = len(key)
            if n:
                keys.append(key.cast(pa.string()))
                kinds.append(pa.array([kind] * n, pa.string()))
                lefts.append(pa.nulls(n, pa.string()) if x is None else x)
                rights.append(pa.nulls(n, pa.string()) if y is None else y)

        emit(ka.filter(pa.array(~both)), f"only_{left_name}")
        emit(kb.filter(pa.array(~matched)), f"only_{right_name}")
        ia, ib = pa.array(np.flatnonzero(both)), pa.array(at[both])
        for i, name in enumerate(columns):
            x = a[f"c{i}"].combine_chunks().take(ia).cast(pa.string())
            y = b[f"c{i}"].combine_chunks().take(ib).cast(pa.string())
            nulls = pc.xor(pc.is_null(x), pc.is_null(y))
            differ = pc.or_(nulls, pc.fill_null(pc.not_equal(x, y), False))
            emit(ka.take(ia).filter(differ), name, x.filter(differ), y.filter(differ))
        parts = [keys, kinds, lefts, rights]
        names = ["key", "diff", "left_value", "right_value"]
        return pa.table({n: pa.concat_arrays(p) if p else pa.array([], pa.string()) for n, p in zip(names, parts, strict=True)})

    return compare


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    columns: Sequence[str],
    left_order: Sequence[str] = (),
    right_order: Sequence[str] = (),
    left_name: str = "left",
    right_name: str = "right",
    rows_per_bucket: int = ROWS,
    bytes_per_bucket: int = BYTES,
) -> DataFrame:
    """Rows missing on either side and cells that differ: ``key, diff, left_value, right_value``.

    Each side is first reduced to one row per key (see :func:`latest_per_key`). Keys are dealt into hash buckets; the
    two tables of a bucket come to one task as Arrow tables, are aligned by sorted search, and their columns compared
    through null-aware masks: two nulls are equal, a null and a value differ. ``diff`` is ``only_<left>``,
    ``only_<right>`` or the name of a column. Buckets and shuffle partitions follow the rows and the bytes of both sides
    together, so a bucket stays near ``rows_per_bucket`` rows and ``bytes_per_bucket`` at any size, however unequal the
    sides are; a repeated key adds nothing, as it was reduced before.

    Defined cases: an empty side reports every key of the other; null keys are left out; columns not named are ignored,
    whatever they are called; values are compared as exact strings.
    """
    n = bucket_count(left, right, columns, rows_per_bucket, bytes_per_bucket)
    bucket = F.pmod(F.xxhash64("key"), F.lit(n)).alias("bucket")
    sides = (latest_per_key(left, left_key, columns, left_order), latest_per_key(right, right_key, columns, right_order))
    ga, gb = (s.select(bucket, "*").repartition(n, "bucket").groupBy("bucket") for s in sides)
    return ga.cogroup(gb).applyInArrow(_compare(list(columns), left_name, right_name), CELLS)


def bucket_count(left: DataFrame, right: DataFrame, columns: Sequence[str], rows: int = ROWS, size: int = BYTES) -> int:
    """Buckets for both sides together: by their rows and by the bytes of their values; never fewer than the cores."""
    total, held = 0, 0
    for df in (left, right):
        n, b = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))), F.lit(0))).first()
        total, held = total + n, held + b
    return max(parallelism(left.sparkSession), -(-total // rows), -(-held // size))
