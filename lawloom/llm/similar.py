"""The most similar vectors of every vector: inverted cells and randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lawloom.operators.orphans import bloom_filter
from lawloom.session import materialize, spread

#: Vectors that the cells are fitted on at most; they are a sample by a hash of the vector, the only thing collected.
MAX_SAMPLE = 1 << 18
#: Vectors a cell should hold, and most cells there are.
PER_CELL, MAX_CELLS = 512, 1 << 14
#: Rows of a cell that one task takes as members and as visitors; a larger cell is split both ways.
MAX_MEMBERS, MAX_VISITORS = 4096, 16384
#: Bits of a code, and standard errors of the estimate that the bound allows for.
BITS, ERRORS = 128, 2.6

#: Candidates of one visitor in a slice, as a multiple of ``k``, beyond which its slice is looked at with exact vectors.
CROWD = 6
#: Vectors a task remembers to drop repeats early.
_SEEN = 1 << 20

HOME, VISITOR, COPY = 0, 1, 2
_PAIRS = "a1 long, a2 long, b1 long, b2 long"
# pairs (cell -1), and the visitors and members of crowded slices (side 0 and 1, the vector in a1, a2)
_MET = "cell int, i int, j int, side int, " + _PAIRS


@dataclass(frozen=True)
class Model:
    """Cell centres, the rotation, and into how many slices members and visitors of each cell are split."""

    centres: np.ndarray
    rotation: np.ndarray
    member_slices: np.ndarray
    visitor_slices: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def rotation(dim: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """``dim`` orthonormal rows of ``bits`` values: a random rotation of the vector padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim], dtype=np.float32)


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and each code's inner product with its own vector."""
    y = x @ rot
    return np.packbits(y > 0, axis=1), (np.abs(y).sum(1) / np.sqrt(rot.shape[1])).astype(np.float32)


def estimate(codes: np.ndarray, scalars: np.ndarray, members: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner product of each coded vector with each member, and its error bound.

    The code x' of x satisfies <x', y> = <x', x> <x, y> + noise, so <x', y> / <x', x> has no bias; the noise has a
    standard deviation of sqrt((1 - <x', x>^2) / (bits - 1)) over the rotation.
    """
    bits = rot.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32)
    signs *= 2
    signs -= 1
    scale = scalars[:, None] * np.float32(np.sqrt(bits))
    found = (signs @ (members @ rot).T) / scale
    return found, ERRORS * np.sqrt(np.maximum(0, 1 - scalars**2) / (bits - 1)) / scalars


def _matrix(column: pa.Array, dim: int, dtype: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the positions of the rows they come from: of ``dim`` finite values, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(column), -1), dim).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fits)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(dtype), fits[good]


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _batch(cell, i, j, role, h1, h2, data) -> pa.RecordBatch:
    n = len(cell)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(n, role), pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), data],
        names=["cell", "i", "j", "role", "h1", "h2", "data"],
    )


def _round(x: np.ndarray) -> np.ndarray:
    """Vectors as one signed byte a value, with the largest value."""
    peak = np.abs(x).max(1)
    small = np.round(x / peak[:, None] * 127).astype(np.int8)
    return np.concatenate([small.view(np.uint8), peak.astype(np.float32).view(np.uint8).reshape(-1, 4)], 1)


def _unround(packed: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of their bytes, and how far each can be from its unit vector."""
    peak = np.ascontiguousarray(packed[:, dim:]).view(np.float32)
    return packed[:, :dim].view(np.int8).astype(np.float32) * (peak / 127), peak[:, 0] * np.float32(0.5 / 127 * np.sqrt(dim) * 1.001)


def _deal(batches, model: Model, probes: int, everyone_asks: bool, coded: bool):
    """Rows for the cells: each distinct vector once as a member of its own cell, and as a visitor of the nearest ones."""
    seen: set[tuple[int, int]] = set()
    visited: set[tuple[int, int]] = set()
    for b in batches:
        x, at = _matrix(b.column("v"), model.dim)
        h1, h2 = (b.column(n).to_numpy()[at] for n in ("h1", "h2"))
        asks = np.ones(len(at), bool) if everyone_asks else b.column("asks").to_numpy(zero_copy_only=False)[at].astype(bool)
        if not len(at):
            continue
        if len(seen) + len(visited) > _SEEN:  # repeats are sent again then, and counted where they meet
            seen.clear()
            visited.clear()
        new = np.array([not (k in seen or seen.add(k)) for k in zip(h1.tolist(), h2.tolist(), strict=True)])
        near = x @ model.centres.T
        p = min(probes, near.shape[1])
        top = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < near.shape[1] else np.argsort(-near, axis=1)
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1)
        top = np.take_along_axis(top, order, 1).astype(np.int32)
        home = top[:, 0]
        again = ~new
        if again.any():
            # a vector met before: one row says that it has copies
            u = np.unique(np.stack([h1[again], h2[again]], 1), axis=0, return_index=True)[1]
            c = home[again][u]
            k1, k2 = h1[again][u], h2[again][u]
            yield _batch(c, k1 % model.member_slices[c], k2 % model.visitor_slices[c], COPY, k1, k2, _binary(np.zeros((len(c), 1), np.uint8)))
        if new.any():
            home, k1, k2, packed = home[new], h1[new], h2[new], _round(x[new])
            turns = model.visitor_slices[home]
            r = np.repeat(np.arange(len(home)), turns)
            j = np.arange(len(r)) - np.repeat(np.cumsum(turns) - turns, turns)
            yield _batch(home[r], k1[r] % model.member_slices[home[r]], j, HOME, k1[r], k2[r], _binary(packed[r]))
        # of copies the one that asks need not be the first
        if everyone_asks:
            asks = new
        else:
            asks &= np.array([not a or not (k in visited or visited.add(k)) for a, k in zip(asks.tolist(), zip(h1.tolist(), h2.tolist(), strict=True), strict=True)], bool)
        if not asks.any():
            continue
        x, top, k1, k2 = x[asks], top[asks], h1[asks], h2[asks]
        if coded:
            codes, scalars = encode(x, model.rotation)
            packed = np.concatenate([codes, scalars.view(np.uint8).reshape(-1, 4)], 1)
        else:
            packed = _round(x)
        r = np.repeat(np.arange(len(x)), p)
        c = top.ravel()
        turns = model.member_slices[c]
        s = np.repeat(np.arange(len(c)), turns)
        i = np.arange(len(s)) - np.repeat(np.cumsum(turns) - turns, turns)
        yield _batch(c[s], i, k2[r][s] % model.visitor_slices[c[s]], VISITOR, k1[r][s], k2[r][s], _binary(packed[r][s]))


def _unpack(t: pa.Table, role: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.filter(pc.equal(t["role"], role))
    h = np.stack([t["h1"].to_numpy(), t["h2"].to_numpy()], 1).astype(np.int64)
    data = np.frombuffer(b"".join(t["data"].to_pylist()), np.uint8).reshape(-1, width) if len(t) else np.zeros((0, width), np.uint8)
    if role == COPY:
        return np.unique(h, axis=0), data, h
    unique, first, counts = np.unique(h, axis=0, return_index=True, return_counts=True) if len(h) else (h, np.array([], np.int64), np.array([], np.int64))
    return unique, data[first], unique[counts > 1]


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k + 1`` th largest of the lower bounds (one more, as a visitor meets itself)."""
    n = min(k + 1, low.shape[1])
    return -np.partition(-low, n - 1, axis=1)[:, n - 1]


def _ordered(p: np.ndarray) -> np.ndarray:
    """Pairs with the smaller vector first, each once."""
    swap = (p[:, 0] > p[:, 2]) | (p[:, 0] == p[:, 2]) & (p[:, 1] > p[:, 3])
    p[swap] = p[swap][:, [2, 3, 0, 1]]
    return np.unique(p, axis=0)


def _met(pairs: np.ndarray, slice_: tuple[int, int, int], sides: Sequence[np.ndarray]) -> pa.Table:
    rows = [np.concatenate([np.repeat([[-1, 0, 0, 0]], len(pairs), 0), pairs], 1)]
    for side, h in enumerate(sides):
        rows.append(np.concatenate([np.repeat([[*slice_, side]], len(h), 0), h, np.zeros_like(h)], 1))
    r = np.concatenate(rows).astype(np.int64)
    names = [f.split()[0] for f in _MET.split(", ")]
    return pa.table({n: pa.array(np.ascontiguousarray(r[:, c]), pa.int32() if c < 4 else pa.int64()) for c, n in enumerate(names)})


def _meet(t: pa.Table, model: Model, floor: float, k: int, symmetric: bool) -> pa.Table:
    """Pairs of a slice whose inner product may be at least ``floor`` and among the visitor's ``k`` largest here.

    Where the bounds leave a visitor more than ``CROWD * k`` members (near-duplicates, which bounds can't tell apart),
    no pairs come out for it, but the visitor and those members, each once, to be met by their exact vectors.
    """
    members, packed, copied = _unpack(t, HOME, model.dim + 4)
    visitors, coded, _ = _unpack(t, VISITOR, BITS // 8 + 4 if floor > -1 else model.dim + 4)
    marked, _, _ = _unpack(t, COPY, 1)
    out = [np.concatenate([m, m], 1) for m in (copied, marked) if len(m)]
    crowded, around = np.zeros(len(visitors), bool), np.zeros(len(members), bool)
    if len(members) and len(visitors):
        y, off = _unround(packed, model.dim)
        if floor > -1:
            codes, scalars = coded[:, : BITS // 8], np.ascontiguousarray(coded[:, BITS // 8 :]).view(np.float32)[:, 0]
        else:
            asked, asked_off = _unround(coded, model.dim)
        for a in range(0, len(visitors), 512):
            if floor > -1:
                est, err = estimate(codes[a : a + 512], scalars[a : a + 512], y, model.rotation)
                # the largest of many estimates errs upwards: as a lower bound it needs twice the margin
                err = err[:, None]
                below = 2 * err
            else:
                est = asked[a : a + 512] @ y.T
                err = asked_off[a : a + 512, None] + off * (1 + asked_off[a : a + 512, None]) + np.float32(1e-5)
                below = err
            open_ = est + err >= np.float32(floor)
            many = np.flatnonzero(open_.sum(1) > k + 1)
            if len(many):
                # what may still be larger than the k-th largest lower bound
                low, high = (est - below)[many], (est + err)[many]
                open_[many] &= high >= _kth(low, k)[:, None]
                many = many[open_[many].sum(1) > CROWD * k]
                crowded[a + many] = True
                around |= open_[many].any(0)
                open_[many] = False
            v, m = np.nonzero(open_)
            p = np.concatenate([visitors[a + v], members[m]], 1)
            p = p[(p[:, :2] != p[:, 2:]).any(1)]
            out.append(_ordered(p) if symmetric and len(p) else p)
    p = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    slice_ = tuple(t[n][0].as_py() for n in ("cell", "i", "j"))
    return _met(p, slice_, (visitors[crowded], members[around]))


def _meet_exactly(t: pa.Table, dim: int, floor: float, k: int, symmetric: bool) -> pa.Table:
    """The ``k`` members nearest to each visitor of a crowded slice, by the vectors themselves."""
    (x, at), side = _matrix(t["v"], dim, np.float64), t["side"].to_numpy()
    h = np.stack([t["h1"].to_numpy(), t["h2"].to_numpy()], 1).astype(np.int64)[at]
    side = side[at]
    asks, held = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out = []
    for a in range(0, len(asks), 512):
        if not len(held):
            break
        rows = asks[a : a + 512]
        cos = x[rows] @ x[held].T
        cos[(h[rows][:, None] == h[held][None]).all(2)] = -2
        n = min(k, len(held))
        # equal ones all come out, for the ranks to decide by key
        v, m = np.nonzero(cos >= np.maximum(-np.partition(-cos, n - 1, axis=1)[:, n - 1], floor)[:, None] - 1e-12)
        p = np.concatenate([h[rows[v]], h[held[m]]], 1)
        p = p[cos[v, m] > -2]
        out.append(_ordered(p) if symmetric and len(p) else p)
    p = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pa.table({n: pa.array(np.ascontiguousarray(p[:, c]), pa.int64()) for c, n in enumerate(("a1", "a2", "b1", "b2"))})


def _cosines(batches, dim: int, floor: float):
    for b in batches:
        x, at = _matrix(b.column("va"), dim, np.float64)
        y, _ = _matrix(b.column("vb"), dim, np.float64)
        cos = np.einsum("ij,ij->i", x, y)
        kept = np.flatnonzero(cos >= floor - 1e-7)
        rows = b.take(pa.array(at[kept]))
        yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in ("a1", "a2", "b1", "b2")], pa.array(cos[kept])], names=["a1", "a2", "b1", "b2", "cos"])


def one_cell(vectors: DataFrame, dim: int) -> Model:
    """One cell for all vectors, in slices: every one that asks meets every member."""
    n, asks = vectors.agg(F.count("*"), F.count_if("asks")).first()
    slices = [np.array([max(1, -(-x // most))], np.int32) for x, most in ((n, MAX_MEMBERS), (asks, MAX_VISITORS))]
    return Model(np.eye(1, dim, dtype=np.float32), rotation(dim), *slices)


def fit(vectors: DataFrame, dim: int, probes: int, per_cell: int = PER_CELL, rounds: int = 6) -> Model:
    """Spherical k-means on a sample of at most ``MAX_SAMPLE`` vectors, chosen by hash; every vector is indexed later.

    From the shares of the cells in the sample follows into how many slices a large cell is split.
    """
    n = max(1, vectors.count())
    cells = int(np.clip(n // per_cell, 1, MAX_CELLS))
    wanted = int(min(MAX_SAMPLE, max(4096, 24 * cells)))
    chosen = vectors.where(F.pmod("h1", F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, wanted / n)) + 1))
    x, _ = _matrix(chosen.select("v").limit(2 * MAX_SAMPLE).toArrow()["v"], dim)
    rng = np.random.default_rng(3)
    if len(x) <= cells:
        cells = max(1, len(x) // 2)
    centres = x[rng.choice(len(x), cells, replace=False)] if len(x) else np.eye(1, dim, dtype=np.float32)
    share = np.ones(len(centres))
    for _ in range(rounds if len(x) else 0):
        owner = np.concatenate([np.argmax(x[a : a + 8192] @ centres.T, axis=1) for a in range(0, len(x), 8192)])
        order = np.argsort(owner, kind="stable")
        share = np.bincount(owner, minlength=len(centres))
        full = np.flatnonzero(share)
        sums = np.add.reduceat(x[order], (np.cumsum(share) - share)[full], axis=0)
        norm = np.linalg.norm(sums, axis=1)
        centres = centres.copy()
        centres[full[norm > 0]] = sums[norm > 0] / norm[norm > 0, None]
    held = share / max(1, len(x)) * n
    ask = np.minimum(n, held * probes)
    return Model(centres.astype(np.float32), rotation(dim), np.maximum(1, np.ceil(held / MAX_MEMBERS)).astype(np.int32), np.maximum(1, np.ceil(ask / MAX_VISITORS)).astype(np.int32))


def similar(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, floor: float = -1.0, probes: int | None = 3, per_cell: int = PER_CELL, asks: Column | None = None) -> DataFrame:
    """``key, neighbour, cosine, rank``: for each vector its ``k`` most similar others with a cosine of at least ``floor``.

    Every vector is a member of the cell of its nearest centre, and visits the cells of its ``probes`` nearest centres
    as a one-bit code of its random rotation with a correction scalar. Inside a cell the codes give an unbiased estimate
    of the inner products with the members and a bound of its error; only pairs that the bound can't rule out (by the
    floor, or by the k-th largest lower bound) are checked with the exact vectors. Near-duplicates are too close for the
    bounds: where they crowd a slice, its vectors are sent once each, and only the k nearest of each become pairs. With ``asks`` (a condition on ``df``) only those rows ask, against all.

    Without a floor the codes rule out little, so visitors go as rounded vectors, whose inner products have a bound that
    always holds. With ``probes=None`` nothing is left to cells: every row that asks meets every vector, slice by slice.
    The neighbours without a floor are then exact; the work is the number of those that ask times that of all.

    Copies: a vector that several keys share is indexed once; its keys are found from it at the end, and of many copies
    the smallest keys are the neighbours. A task drops repeats before the shuffle, so a group of copies that holds much
    of the table sends one row a task. A large cell is split into slices of members and of visitors.

    Else the result is approximate: a neighbour can be missed if none of the two visits the other's cell, or, rarely, if the
    error of an estimate exceeds the bound.

    Defined cases: a vector that is null, all zero, not of ``dim`` values, or with a null, NaN or infinite value has no
    neighbours and is none; equal cosines are ranked by key; a repeated key counts once; null keys are left out.
    """
    spark = df.sparkSession
    vec = F.col(vector)
    fits = df.where(F.col(key).isNotNull() & (F.size(vec) == dim))
    rows = fits.select(F.col(key).cast("string").alias("key"), vec.alias("v"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(1), vec).alias("h2"), (asks if asks is not None else F.lit(True)).alias("asks"))
    model = one_cell(rows, dim) if probes is None else fit(rows, dim, probes, per_cell)
    shared = spark.sparkContext.broadcast(model)
    everyone = asks is None
    dealt = rows.select("h1", "h2", "v", "asks").mapInArrow(lambda bs: _deal(bs, shared.value, probes or 1, everyone, floor > -1), "cell int, i int, j int, role int, h1 long, h2 long, data binary")
    met = materialize(dealt.groupBy("cell", "i", "j").applyInArrow(lambda t: _meet(t, shared.value, floor, k, everyone), _MET), "met")
    pairs = met.where("cell < 0").select("a1", "a2", "b1", "b2")
    crowd = met.where("cell >= 0").select("cell", "i", "j", "side", F.col("a1").alias("h1"), F.col("a2").alias("h2"))
    if crowd.limit(1).count():
        full = crowd.join(rows.select("h1", "h2", "v").dropDuplicates(["h1", "h2"]), ["h1", "h2"])
        pairs = pairs.unionByName(full.groupBy("cell", "i", "j").applyInArrow(lambda t: _meet_exactly(t, dim, floor, k, everyone), _PAIRS))
    pairs = materialize(pairs.distinct(), "pairs")
    involved = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct()
    bloom = bloom_filter(involved, "h1", "h2")
    # one more pass over the vectors; what the filter lets through is far less than all
    known = materialize(rows.where(bloom.might_contain(F.col("h1"), F.col("h2"))), "known")
    members = known.select("key", "h1", "h2", "asks").distinct()
    vectors = materialize(known.select("h1", "h2", "v").dropDuplicates(["h1", "h2"]), "vectors")
    a = vectors.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("v").alias("va"))
    b = vectors.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("v").alias("vb"))
    checked = spread(pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]), "a1").mapInArrow(lambda bs: _cosines(bs, dim, floor), _PAIRS + ", cos double")
    checked = materialize(checked, "checked")
    turned = checked.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "cos")
    links = checked.unionByName(turned.where((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))) if everyone else checked
    few = F.row_number().over(W.partitionBy("h1", "h2").orderBy("key"))
    targets = members.select("key", "h1", "h2").distinct().withColumn("n", few).where(F.col("n") <= k + 1).select(F.col("key").alias("neighbour"), F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    sources = members.where("asks").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    found = sources.join(links, ["a1", "a2"]).join(targets, ["b1", "b2"]).where(F.col("key") != F.col("neighbour"))
    found = found.groupBy("key", "neighbour").agg(F.max("cos").alias("cosine"))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("cosine"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
