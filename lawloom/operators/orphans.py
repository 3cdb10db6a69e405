"""References to records that are missing, were deleted, or arrive later."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.session import materialize

#: Upper bound of a Bloom filter that is sent to every executor: 2^26 bits are 8 MB. More keys than it holds are cut
#: into parts by a hash, each with a filter of its own, of which one at a time is sent.
MAX_BITS = 1 << 26
HASHES, BITS_PER_KEY = 4, 12


@dataclass(frozen=True)
class Bloom:
    """A one-row table ``bits: array<bigint>`` and its number of bits (a power of two)."""

    bits: DataFrame
    size: int

    def might_contain(self, *key: Column) -> Column:
        """False only if the key was never added. A null key gives null."""
        words = self.bits.scalar()
        found = F.lit(True)
        for p in _positions(key, self.size):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            found = found & (F.getbit(word, (p % 64).cast("int")) == 1)
        return found


def _positions(key: tuple[Column, ...], size: int) -> list[Column]:
    return [F.xxhash64(*key, F.lit(i)).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)]


def bloom_filter(df: DataFrame, *key: str, max_bits: int = MAX_BITS) -> Bloom:
    """A Bloom filter over the keys: bits are set and merged by word with partial aggregation, inside the JVM.

    About 12 bits a key (under 1% false positives) up to ``max_bits``, which bounds what the driver and every executor
    hold. The filter is built as a table; no keys reach the driver.
    """
    spark = df.sparkSession
    n = df.count()
    size = 1 << 10
    while size < BITS_PER_KEY * n and size < max_bits:
        size *= 2
    set_bits = df.select(F.explode(F.array(*_positions(tuple(F.col(k) for k in key), size))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = spark.range(size // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    return Bloom(materialize(one, "bloom"), size)


def references(df: DataFrame, ref_table: str, source: str, target: str, time: str, target_table: str) -> DataFrame:
    """The common form of a table of references."""
    return df.select(
        F.lit(ref_table).alias("ref_table"), F.lit(target_table).alias("target_table"), F.col(source).cast("string").alias("source_key"), F.col(target).cast("string").alias("target_key"), F.col(time).alias("at")
    )


def records(df: DataFrame, name: str, key: str, time: str) -> DataFrame:
    """The common form of a table that references point to: each key once, at its earliest time."""
    k = F.col(key).cast("string")
    return df.where(k.isNotNull()).groupBy(F.lit(name).alias("target_table"), k.alias("target_key")).agg(F.min(time).alias("first_at"))


def find_orphans(refs: DataFrame, parents: DataFrame, removed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``ref_table, source_key, target_key, reason, at`` for each reference pair whose target is not there in time.

    ``refs`` as from :func:`references`, ``parents`` as from :func:`records`, ``removed`` with ``target_table,
    target_key``. A pair counts once, at its earliest time. A Bloom filter of the parents' keys, of bounded size, proves
    most orphans without a join; only pairs it lets through are joined with the parents. With more keys than a filter of
    ``max_bits`` holds, keys and pairs are cut into parts by a hash of the key, and each part is probed with its own. A
    pair is ``late`` if the target's earliest time is after the pair's, ``deleted`` if there is no target but
    ``removed`` lists it, else ``missing``.

    Skew: pairs are combined before the shuffle; a target with a large share of all pairs meets one parent row, and
    adaptive execution splits its partition of the sort-merge join.

    Defined cases: null targets don't count; a null source is a source like any other; a null time on either side is never late; keys
    are compared exactly as stored; repeated removals count once; with no parents every pair is deleted or missing.
    """
    parents = materialize(parents, "parents")
    parts = -(-parents.count() * BITS_PER_KEY // max_bits) or 1
    key = (F.col("target_table"), F.col("target_key"))
    grouped = refs.where(F.col("target_key").isNotNull())
    names = ["ref_table", "target_table", "source_key", "target_key"]
    if parts == 1:
        maybe = bloom_filter(parents, "target_table", "target_key", max_bits=max_bits).might_contain(*key)
        pairs = materialize(grouped.withColumn("maybe", maybe).groupBy(*names, "maybe").agg(F.min("at").alias("at")), "pairs")
    else:
        part = F.pmod(F.xxhash64(*key, F.lit("part")), F.lit(parts)).cast("int")
        cut = materialize(grouped.groupBy(*names).agg(F.min("at").alias("at")).withColumn("part", part), "pairs", "part")
        keys = materialize(parents.select(*key, part.alias("part")), "keys", "part")
        probed = []
        for p in range(parts):
            bloom = bloom_filter(keys.where(F.col("part") == p), "target_table", "target_key", max_bits=max_bits)
            probed.append(cut.where(F.col("part") == p).drop("part").withColumn("maybe", bloom.might_contain(*key)))
        pairs = reduce(DataFrame.unionByName, probed)
    sure = pairs.where(~F.col("maybe")).select(*names, "at")
    checked = pairs.where("maybe").join(parents.withColumn("there", F.lit(True)), ["target_table", "target_key"], "left")
    late = checked.where(F.col("first_at") > F.col("at")).select("ref_table", "source_key", "target_key", F.lit("late").alias("reason"), "at")
    gone = sure.unionByName(checked.where(F.col("there").isNull()).select(*sure.columns))
    log = removed.select("target_table", "target_key").distinct().withColumn("logged", F.lit(True))
    reason = F.when(F.col("logged"), "deleted").otherwise("missing").alias("reason")
    gone = gone.join(log, ["target_table", "target_key"], "left").select("ref_table", "source_key", "target_key", reason, "at")
    return late.unionByName(gone)


def orphan_report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per table, period of the reference and reason; a null time is the null period."""
    return orphans.groupBy("ref_table", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period"), "reason").agg(
        F.count("*").alias("n_refs"), F.countDistinct("target_key").alias("n_targets")
    )
