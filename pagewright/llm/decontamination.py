"""Benchmark decontamination by size-partitioned MinHash containment (operator 5).

Short test items are looked for inside documents of any length. An item's
sketch is its k smallest shingle hashes (bottom-k MinHash). Items are
partitioned by size, and k follows from the partition's largest size: an item
contained to the threshold can lack fewer than k of its shingles, so at least
one hash of its sketch is in the document, and no true pair is missed. Pairs
found that way are checked with the exact shingles as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_side
from .textvec import chunks, flatten, lower_word_chars, mix, runs, span_hashes

#: Characters of items that one broadcast index is built from; more items make more passes.
INDEX_CHARS = 16_000_000
#: Characters of documents searched at once: some ten arrays of eight bytes a character live meanwhile, in every worker.
SEARCH_CHARS = 125_000
FOUND = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, starts and ends of all words, and the first word of each text (one more at the end)."""
    cp, off = flatten(texts)
    low = lower_word_chars()[cp]
    start, end = runs(low != 0, off)
    return low, start, end, np.searchsorted(start, off)


def normalised(text: str | None) -> str:
    """Words (letters and digits, lower case), each between single spaces."""
    low, start, end, _ = _words([text])
    raw = [low[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    return f" {' '.join(raw)} " if raw else ""


def shingles(text: str | None, size: int = 5) -> list[str]:
    """Distinct shingles in order; a text of fewer words is one shingle, without words there is none."""
    words = normalised(text).split()
    k = min(size, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))) if words else []


def _gram_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of size words in a row within one text, and the text of each."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, p = np.zeros(n, np.uint64), 1
    for j in range(size):
        total += words[j : j + n] * np.uint64(p)
        p = p * 0xD6E8FEB86659FD93 % (1 << 64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n] == text[size - 1 :]
    return mix(total[inside]), text[:n][inside]


@dataclass
class Index:
    """The sketches of a bounded set of items, by number of words in a shingle."""

    threshold: float
    items: list[tuple[int | None, list[str]]] = field(default_factory=list)
    keys: dict[int, np.ndarray] = field(default_factory=dict)  # sorted
    owners: dict[int, np.ndarray] = field(default_factory=dict)
    filters: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]], size: int, threshold: float) -> Index:
        out = cls(threshold, [(i, s) for i, t in rows if (s := shingles(t, size))])
        entries: dict[int, list[tuple[int, int]]] = {}
        for k, (_, own) in enumerate(out.items):
            width = len(own[0].split(" "))
            low, start, end, first = _words(["\n".join(own)])
            hashes = np.unique(_each(span_hashes(low, start, end), width))
            largest = 2 ** (len(own).bit_length()) - 1  # of the partition by size, [2^i, 2^(i+1))
            sketch = hashes[: min(len(hashes), floor((1 - threshold) * largest + 1e-9) + 1)]
            entries.setdefault(width, []).extend((int(h), k) for h in sketch)
        for width, pairs in entries.items():
            pairs.sort()
            out.keys[width] = np.array([h for h, _ in pairs], np.uint64)
            out.owners[width] = np.array([k for _, k in pairs], np.int64)
            out.filters[width] = np.zeros(1 << 20, bool)
            out.filters[width][(out.keys[width] >> np.uint64(44)).astype(np.int64)] = True
        return out

    def candidates(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text, item) with a sketch hash in common."""
        low, start, end, first = _words(texts)
        words = span_hashes(low, start, end)
        out: set[tuple[int, int]] = set()
        for width, keys in self.keys.items():
            grams, text = _gram_hashes(words, first, width)
            maybe = np.flatnonzero(self.filters[width][(grams >> np.uint64(44)).astype(np.int64)])
            grams, text = grams[maybe], text[maybe]
            lo, hi = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                out.update((int(text[i]), int(k)) for k in self.owners[width][lo[i] : hi[i]])
        return sorted(out)

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int, float]]:
        """(text, item_id, shingles, shared, containment) of every pair at the threshold or above."""
        out, of, norm = [], -1, ""
        for t, k in self.candidates(texts):
            if t != of:
                of, norm = t, normalised(texts[t])
            item_id, own = self.items[k]
            shared = sum(f" {s} " in norm for s in own)
            if shared >= ceil(self.threshold * len(own) - 1e-9):
                out.append((t, item_id, len(own), shared, shared / len(own)))
        return out


def _each(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every width words, side by side."""
    total, p = np.zeros(len(words) // width, np.uint64), 1
    for j in range(width):
        total += words[j::width] * np.uint64(p)
        p = p * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """FOUND: each (document, item) of which the document holds threshold or more of the item's distinct shingles.

    docs has doc_id and text, items item_id and text; other columns aren't looked
    at. Null and empty texts match nothing; an item of fewer than size words
    counts as one shingle; null ids are carried; repeated rows give repeated rows;
    texts of any length are searched whole, in parts.
    """
    spark = docs.sparkSession
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), items.select(F.col("item_id").cast("long"), "text")
    passes = max(1, ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / INDEX_CHARS))
    out = None
    for part in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part).collect()  # about INDEX_CHARS
        index = spark.sparkContext.broadcast(Index.build([(r[0], r[1]) for r in rows], size, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in chunks(texts, SEARCH_CHARS):
                    if found := index.value.search(texts[lo:hi]):
                        t, item, n, shared, share = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([lo + i for i in t], pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int32()), pa.array(shared, pa.int32()), pa.array(share, pa.float64())],
                            names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                        )

        one = docs.mapInArrow(run, FOUND)
        out = one if out is None else out.unionByName(one)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs less those that hold an item; rows that share a doc_id go together, rows without an id stay."""
    bad = contaminated(docs, items, size, threshold).select("doc_id").distinct()
    return docs.join(small_side(bad), "doc_id", "left_anti").select(*docs.columns)
