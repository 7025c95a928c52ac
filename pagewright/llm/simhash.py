"""SimHash near-duplicates by multi-index hashing (operator 7).

A fingerprint is cut into segments. Two fingerprints at distance r or less have
at least one segment pair that is close, so every fingerprint enumerates the
small Hamming ball round each of its segments, fetches what the segment tables
hold there, and checks whole distances (Norouzi, Punjani, Fleet, "Fast Exact
Search in Hamming Space with Multi-Index Hashing"). Equal fingerprints are one
row from the start, and only verified links leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut, small_side

BITS = 64
SLICE = 500_000  # shingles hashed at once


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each set if it is set in over half the XXH64 (seed 42) of the shingles; no word: 0.

    A-Z are lower-cased and ASCII white space parts words; a text of fewer words
    is one shingle. Shingles count as often as they occur.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    place = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in tokens], out=place[1:])
    k = min(words, len(tokens))
    starts, ends = place[: len(tokens) - k + 1], place[k:] - 1
    total, digest = np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for i in range(0, len(starts), SLICE):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + SLICE].tolist(), ends[i : i + SLICE].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment; close in one of them follows from the whole distance."""
    whole, over = divmod(radius, count)
    widths = [BITS // count + (k < BITS % count) for k in range(count)]
    shifts = [sum(widths[:k]) for k in range(count)]
    # radius whole in the first over + 1 segments, whole - 1 in the others (-1: none needed)
    return [(s, w, r) for k, (s, w) in enumerate(zip(shifts, widths, strict=True)) if (r := whole if k <= over else whole - 1) >= 0]


def best_count(n: int, radius: int) -> int:
    """The number of segments with the least work for n fingerprints: rows probed plus pairs compared.

    It changes the work alone: any number finds the same links.
    """

    def work(count: int) -> float:
        return sum(sum(comb(w, d) for d in range(r + 1)) * n * (1 + 0.01 * n / 2**w) for _, w, r in segments(count, radius))

    return min(range(2, radius + 1), key=work) if radius > 1 else 2


def _ball(width: int, radius: int) -> list[int]:
    """Every mask of up to radius of width bits."""
    return [sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(width), d)]


def _tables(fps: DataFrame, radius: int, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Segment tables (b and columns under k, v) and every probe of them (a and columns)."""
    table, probe = [], []
    for k, (shift, width, r) in enumerate(segments(best_count(fps.count(), radius), radius)):
        value = f"shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L" if width < 64 else "fp"
        table.append(f"named_struct('k', {k}, 'v', {value})")
        masks = ", ".join(f"{m}L" for m in _ball(width, r))
        probe.append(f"transform(array({masks}), m -> named_struct('k', {k}, 'v', ({value}) ^ m))")
    held = fps.select(F.col("fp").alias("b"), *columns, F.expr(f"inline(array({', '.join(table)}))"))
    asked = fps.select(F.col("fp").alias("a"), *columns, F.expr(f"inline(concat({', '.join(probe)}))"))
    return held, asked


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints (column fp) -> every pair a < b (as signed longs) at distance radius or less."""
    held, asked = _tables(fps, radius)
    found = asked.join(held, (asked.k == held.k) & (asked.v == held.v) & (asked.a < held.b) & (F.bit_count(asked.a.bitwiseXOR(held.b)) <= radius))
    return found.select("a", "b").distinct()


def star_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links whose components are those of all of links(), a row for each probe at most but for pairs of different stars.

    Each probe is answered by the least fingerprint of its table place first.
    Places whose fingerprints all are one group by then are done; what others
    hold is compared in pairs, where the groups differ.
    """
    held, asked = _tables(fps, radius)
    least = held.groupBy("k", "v").agg(F.min("b").alias("b"))
    near = "bit_count(a ^ b) <= " + str(radius)
    stars = cut(asked.join(least, ["k", "v"]).where(f"a <> b AND {near}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = small_side(connected_components(stars).select(F.col("node").alias("fp"), F.col("component").alias("part")))
    parted = cut(fps.join(label, "fp", "left").select("fp", F.coalesce("part", "fp").alias("part")))
    held, asked = _tables(parted, radius, "part")
    held = held.withColumnRenamed("part", "other")
    rest = asked.join(held, ["k", "v"]).where(f"a < b AND part <> other AND {near}").select("a", "b").distinct()
    return stars.unionByName(cut(rest))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null, empty and blank texts have fingerprint 0 and link like any other; null
    ids get a component but never name one; repeated rows stay rows; other
    columns aren't looked at; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words))
    kinds = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(star_links(kinds.select("fp"), radius))
    of_kind = kinds.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = cut(of_kind.groupBy("component").agg(F.min("first").alias("component_id")))
    of_kind = cut(of_kind.join(least, "component").select("fp", "component_id"))
    return prints.join(of_kind, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """docs without those whose group has a smaller doc_id.

    Rows that share a doc_id are one document: they stay or go together. Rows
    without an id stay.
    """
    gone = near_duplicates(docs, radius, words).groupBy("doc_id").agg(F.min("component_id").alias("first")).where("doc_id <> first")
    return docs.join(small_side(gone.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
