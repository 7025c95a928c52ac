"""Near-duplicate vectors by collision-counting projections (operator 10).

After Huang et al., "Query-Aware Locality-Sensitive Hashing": vectors are
projected on many random lines; around each vector's own value lies a window
on every line, a pair's collisions are the windows it shares, and pairs with
enough collisions are verified by their cosine in double precision. The count
that is enough is calibrated so that a pair exactly at the threshold is lost
with probability LOSS at most.

One window holds a quarter of all pairs, so no single line is ever joined on:
tables sort the vectors by which side of the middle they lie on several further
lines at once, and collisions are counted for pairs that share a place in some
table. The number of those lines grows with the logarithm of the vectors, so that
a place holds about BUCKET of them, and the number of tables follows from LOSS.

Equal vectors are one class from the start. A place of more than BLOCK classes is
compared in blocks. A comparison returns sums of links and a spanning forest,
never its pairs; a pair is counted in the first table that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut, drop, small_side

LINES = 32
#: Classes to a place of a table, about, and classes to a block, at most.
BUCKET, BLOCK = 2_048, 8_192
LOSS, TABLE_LOSS = 0.002, 0.005
#: A vector's window on a line, in standard deviations of a threshold pair's difference.
WINDOW = 1.6
SCALE = 256 / 11.8  # steps of a byte over +-5.9


def lines(dim: int) -> np.ndarray:
    """The random lines of vectors of this dimension; the same everywhere."""
    return np.random.default_rng([20, dim]).standard_normal((dim, LINES))


@lru_cache(16)
def sides(dim: int, tables: int, count: int) -> np.ndarray:
    """The further lines of the tables."""
    return np.random.default_rng([22, dim]).standard_normal((dim, tables * count))


def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """Tables, and lines to each, for n classes: a pair at the threshold shares no place with probability TABLE_LOSS at most."""
    count = max(0, ceil(log2(max(1, n) / BUCKET)))
    together = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** count
    return (1, 0) if count == 0 else (ceil(log(TABLE_LOSS) / log(1 - together)) if together < 1 else 1, count)


def places(x: np.ndarray, tables: int, count: int) -> np.ndarray:
    """The place of each unit vector in each table."""
    if not count:
        return np.zeros((len(x), tables), np.int64)
    bits = (x @ sides(x.shape[1], tables, count) > 0).reshape(len(x), tables, count)
    return bits @ (1 << np.arange(count, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread(threshold: float) -> float:
    return sqrt(max(0.0, 2 - 2 * threshold))


@lru_cache(None)
def enough(dim: int, threshold: float) -> int:
    """The collisions that pairs exactly at the threshold reach, but for a share LOSS of them."""
    rng = np.random.default_rng([21, dim])
    u = unit(rng.standard_normal((20_000, dim)))
    z = rng.standard_normal(u.shape)
    z -= (z * u).sum(1, keepdims=True) * u
    v = threshold * u + sqrt(max(0.0, 1 - threshold**2)) * (unit(z) if dim > 1 else 0)
    a, b = steps(u @ lines(dim)), steps(v @ lines(dim))
    return int(np.quantile(_collide(a, b, threshold).sum(1), LOSS, method="lower"))


def steps(projected: np.ndarray) -> np.ndarray:
    return np.clip((projected + 5.9) * SCALE, 0, 255).astype(np.uint8)


def _width(threshold: float) -> int:
    return int(WINDOW * _spread(threshold) * SCALE) + 1


def _collide(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    w = _width(threshold)
    return (a - b + np.uint8(w)) <= np.uint8(2 * w)


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes: the least node reachable by the links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(left: dict[str, np.ndarray], right: dict[str, np.ndarray] | None, threshold: float, table: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links of two blocks (or within one) that share no place in an earlier table: class, vectors linked, a class of its group here.

    A block: cid, n (vectors of each class), x (unit vectors), at (places by table).
    """
    own = right is None
    other = left if own else right
    na, nb = len(left["cid"]), len(other["cid"])
    need, w = enough(left["x"].shape[1], threshold), np.uint8(_width(threshold))
    pa_, pb = steps(left["x"] @ lines(left["x"].shape[1])), steps(other["x"] @ lines(left["x"].shape[1]))
    pb_t = np.ascontiguousarray(pb.T)
    found_i, found_j = [], []
    for at in range(0, na, 128):
        tile = pa_[at : at + 128]
        count = np.zeros((len(tile), nb), np.uint8)
        for k in range(LINES):
            count += (pb_t[k][None, :] - (tile[:, k] - w)[:, None]) <= np.uint8(2 * w)
        i, j = np.nonzero(count >= need)
        i += at
        if own:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 20_000):
            ii, jj = i[s : s + 20_000], j[s : s + 20_000]
            for t in range(table):
                new = left["at"][ii, t] != other["at"][jj, t]
                ii, jj = ii[new], jj[new]
            ok = np.einsum("ij,ij->i", left["x"][ii], other["x"][jj]) >= threshold
            found_i.append(ii[ok])
            found_j.append(jj[ok])
    i, j = np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])
    cid = left["cid"] if own else np.concatenate([left["cid"], other["cid"]])
    size = left["n"] if own else np.concatenate([left["n"], other["n"]])
    j = j if own else j + na
    degree = np.bincount(i, weights=size[j], minlength=len(cid)) + np.bincount(j, weights=size[i], minlength=len(cid))
    label = _smallest(len(cid), i, j)
    touched = np.flatnonzero(degree)
    return cid[touched], degree[touched].astype(np.int64), cid[label[touched]]


def _vectors(column: pa.Array) -> np.ndarray:
    """Equal-length lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row a vector (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different length; equal vectors link. Null
    ids get links but never name a component. Repeated rows are vectors each;
    other columns aren't looked at; an empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    fine = F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0), false)")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v")).withColumn("v", F.when(fine, F.col("v")))
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    ids = cut(rows.drop("v"))
    classes = rows.where("v IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    tables, count = table_shape(classes.count(), threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                at = places(unit(_vectors(part.column(2))), tables, count)
                listed = pa.ListArray.from_arrays(np.arange(0, at.size + 1, tables, dtype=np.int32), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, listed], names=[*part.schema.names, "at"])

    placed = classes.select("cid", "n", "v").mapInArrow(place, f"cid long, n long, v {kind}, at array<bigint>")
    placed = cut(placed.withColumn("dim", F.size("v")))
    placed_once = placed.select("cid", "dim", F.posexplode("at").alias("t", "place"))
    crowded = placed_once.groupBy("dim", "t", "place").count().where(F.col("count") > BLOCK)
    crowded = small_side(crowded.select("dim", "t", "place", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    dealt = placed.select("*", F.posexplode("at").alias("t", "place")).join(crowded, ["dim", "t", "place"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(cid), parts) AS int)")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with"))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid").combine_chunks()
        own, lo, hi, t = group["own"].to_numpy(), group["lo"][0].as_py(), group["hi"][0].as_py(), group["t"][0].as_py()

        def block(which: int) -> dict[str, np.ndarray] | None:
            part = group.filter(pa.array(own == which)).combine_chunks()
            if not len(part):
                return None
            at = part["at"].chunk(0).flatten().to_numpy().reshape(len(part), -1)
            return {"cid": part["cid"].to_numpy(), "n": part["n"].to_numpy(), "x": unit(_vectors(part["v"].chunk(0))), "at": at}

        left, right = block(lo), block(hi) if hi != lo else None
        got = compare(left, right, threshold, t) if left and (right or hi == lo) else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(g) for g in got], names=["cid", "links", "other"])

    found = cut(dealt.groupBy("dim", "t", "place", "lo", "hi").applyInArrow(search, "cid long, links long, other long"))
    drop(placed)
    near = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("cid", "other"), "cid", "other").withColumnRenamed("node", "cid")
    info = classes.select("cid", "k1", "k2", "first", "n").join(parts, "cid", "left").join(near, "cid", "left")
    info = cut(info.withColumn("component", F.coalesce("component", "cid")))
    least = cut(info.groupBy("component").agg(F.min("first").alias("component_id")))
    info = small_side(info.join(least, "component").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = ids.where("k1 IS NOT NULL").join(info, ["k1", "k2"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    alone = ids.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
