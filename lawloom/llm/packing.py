"""Filling containers of fixed capacity with items measured in tokens."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.session import balanced, materialize, parallelism

#: Items that one task packs, tasks whose rests are merged into one, and rests that a task passes on at most.
PER_TASK, FAN_IN, MAX_OPEN = 200_000, 8, 20_000
#: Share of the capacity from which a container counts as nearly full and is closed.
FULL = 0.995


def default_tokenizer() -> str:
    """The path of a public byte-level vocabulary, if the package with such files is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """``key, n_tokens`` of each row; null and empty texts have none. The path must be there on every executor."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoding = _encoding(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [len(encoding.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return balanced(rows).mapInArrow(run, "key long, n_tokens long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin of each item, and the bins' loads. Items are of 1 to ``capacity``.

    The bins with a given room are a list; the rooms for which there are any are the bits of one number, in which the
    least room that suffices is the lowest bit from the size on.
    """
    bins = np.zeros(len(sizes), np.int64)
    loads: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            loads[b] += size
        else:
            room, b = capacity, len(loads)
            loads.append(size)
        bins[i] = b
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, np.array(loads, np.int64)


def _open(loads: np.ndarray, capacity: int, last: bool, max_open: int) -> np.ndarray:
    """Which bins go on to be merged: those not nearly full, at most the ``max_open`` emptiest of them."""
    if last:
        return np.zeros(len(loads), bool)
    wait = loads < FULL * capacity
    if wait.sum() > max_open:
        order = np.argsort(loads, kind="stable")
        wait[order[max_open:]] = False
    return wait


def _round(level: int, capacity: int, last: bool, max_open: int):
    def fill(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        bins, loads = best_fit(t["n_tokens"].to_numpy(), capacity)
        ids = (level << 58) + (part << 28) + np.arange(len(loads), dtype=np.int64)
        wait = _open(loads, capacity, last, max_open)
        return pa.table({"part": t["part"], "id": t["id"], "piece": t["piece"], "n_tokens": t["n_tokens"], "bin": ids[bins], "load": loads[bins], "open": wait[bins]})

    return fill


_SCHEMA = "part long, id long, piece int, n_tokens long, bin long, load long, open boolean"


def pack(sizes: DataFrame, capacity: int, per_task: int = PER_TASK, max_open: int = MAX_OPEN) -> DataFrame:
    """``key, piece, first_token, n_tokens, container``: which container holds each item, or each piece of a long one.

    ``sizes`` has ``key, n_tokens``. An item of more than ``capacity`` tokens is cut into full pieces, each a container
    of its own, and a rest, which is an item like any other; no other item is cut. Each task packs its share by best-fit
    decreasing and closes the containers that are nearly full; what is left in the others goes on as items to the next
    round, in which one task takes the rests of ``FAN_IN`` tasks, and so on to a single one. No task gets more than
    ``per_task`` items or ``FAN_IN * max_open`` rests: if more are left, the fullest are closed first.

    Defined cases: items of no tokens get no container (null); repeated keys are items each; ties keep their order in
    the task.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes.select("key", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), "sizes")
    cut = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int"))
    pieces = sizes.select(F.col("key").alias("id"), F.explode(cut).alias("piece"), F.col("n_tokens").alias("all"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece").cast("long") * capacity)).drop("all")
    parts = max(parallelism(spark), -(-sizes.count() // per_task))
    loose = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity)).select(F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).alias("part"), "id", "piece", "n_tokens")
    last = parts == 1
    packed = materialize(loose.groupBy("part").applyInArrow(_round(1, capacity, last, max_open), _SCHEMA), "packed")
    result, level, rest = packed.select("id", "piece", "n_tokens", "bin"), 1, packed
    while not last:
        level, parts = level + 1, -(-parts // FAN_IN)
        last = parts == 1
        waiting = rest.where("open").select(F.floor(F.col("part") / FAN_IN).alias("part"), F.col("bin").alias("id"), F.lit(0).alias("piece"), F.col("load").alias("n_tokens")).distinct()
        rest = materialize(waiting.groupBy("part").applyInArrow(_round(level, capacity, last, max_open), _SCHEMA), "merged")
        moved = rest.select(F.col("id").alias("bin"), F.col("bin").alias("to"))
        result = result.join(moved, "bin", "left").select("id", "piece", "n_tokens", F.coalesce("to", "bin").alias("bin"))
    whole = pieces.where(F.col("n_tokens") == capacity).select("id", "piece", "n_tokens", F.concat(F.lit("whole-"), "id", F.lit("-"), "piece").alias("container"))
    none = pieces.where(F.col("n_tokens") <= 0).select("id", "piece", "n_tokens", F.lit(None).cast("string").alias("container"))
    every = result.select("id", "piece", "n_tokens", F.col("bin").cast("string").alias("container")).unionByName(whole).unionByName(none)
    return every.select(F.col("id").alias("key"), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "n_tokens", "container")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, the least number there could be, tokens, tokens of space left, and the fullest load."""
    loads = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("load"))
    totals = loads.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("n_tokens"), F.max("load").alias("largest_load"))
    return totals.withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity)).withColumn("unused_tokens", F.col("n_containers") * capacity - F.col("n_tokens"))


def invariants(items: DataFrame, packed: DataFrame, capacity: int) -> DataFrame:
    """One row of counts of what a packing must not have, and whether it is near the least number of containers."""
    loads = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("load"))
    totals = loads.agg(F.count("*").alias("n"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.count_if(F.col("load") > capacity).alias("n_overfull"))
    pieces = packed.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.countDistinct("piece").alias("different"))
    gaps = (F.col("tokens") != F.col("end")) | (F.col("n") != F.col("different"))
    cut = (F.col("n") > 1) & (F.col("tokens") <= capacity)
    held = items.join(pieces, "key", "left").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("n").isNull()).alias("n_lost"), F.count_if(cut).alias("n_cut_needlessly"), F.count_if(gaps).alias("n_gaps")
    )
    near = F.col("n") <= F.ceil(F.col("tokens") / capacity) * 1.01 + 8
    return held.crossJoin(totals).select("n_docs", "n_lost", "n_overfull", "n_cut_needlessly", "n_gaps", near.alias("near_least"))  # one row each
