"""Language identification by rank-order n-gram profiles (operator 1).

Cavnar and Trenkle, "N-Gram-Based Text Categorization": the most frequent
1- to 3-grams of a document, ranked, are compared with each language's ranked
profile by the out-of-place distance. Every whole text is used, in batches of
code points; a text longer than PART is counted part by part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import BATCH_ROWS
from .textvec import lower_letters

#: Ranks in a document's and in a language's profile.
PROFILE = 400
#: Labelled documents of one language that a profile is learned from, at most (by hash of the text).
SAMPLE_PER_LANGUAGE = 4_000
#: Labels beyond this are an error rather than a profile table without bound.
MAX_LANGUAGES = 1_000
PART = 4_000_000


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of lower-case letters (word borders are 0) and their counts, ascending by code."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, carry = lower_letters(), np.zeros(1, np.int64)
    for at in range(0, len(text), PART):
        cp = np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        x = np.concatenate([carry, table[cp].astype(np.int64), np.zeros(int(at + PART >= len(text)), np.int64)])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)  # one border between words
        x = x[keep]
        old = len(carry)
        two = x[:-1] << 21 | x[1:]
        three = two[:-1] << 21 | x[2:]
        # what the previous part has counted already isn't counted again
        part = np.concatenate([x[old:][x[old:] != 0], two[old - 1 :], three[max(0, old - 2) :]])
        part.sort()
        if len(part):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            c, n = part[first], np.diff(np.append(first, len(part)))
            if len(codes):
                both = np.concatenate([codes, c])
                codes, inverse = np.unique(both, return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n])).astype(np.int64)
            else:
                codes, counts = c, n
        carry = x[-2:]
    return codes, counts


def profile(text: str | None) -> np.ndarray:
    """The text's most frequent grams in rank order; ties by code; empty without a letter."""
    codes, counts = _grams(text or "")
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Ranked grams of each language, and the distances of a text to them."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.codes = np.unique(np.array([c for name in self.names for c in ranked[name]], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), PROFILE, np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, ranked[name]), k] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language (ties: first by name) and 1 - distance/largest possible; und without letter or language."""
        top = profile(text)
        if not len(top) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.rank[at]
        places = np.arange(len(top))[:, None]
        apart = np.where(ranks == PROFILE, PROFILE, np.minimum(np.abs(ranks - places), PROFILE)).sum(0)
        k = int(apart.argmin())
        return self.names[k], 1.0 - float(apart[k]) / (PROFILE * len(top))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from labelled (text, lang) rows; at most about per_language texts each, chosen by hash.

    A language of more rows than that counts each of its texts once.
    """
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    # sketches of the distinct texts: copies of one go in or out together, so the share is of texts, not of rows
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")
    sizes = {r["lang"]: (r["n"], r["texts"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), distinct).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    large = [k for k, (n, _) in sizes.items() if n > per_language]
    if large:
        share = F.create_map(*[F.lit(x) for k in large for x in (k, int(2**31 * min(1.0, per_language / max(1, sizes[k][1]))))])
        place = F.pmod(F.xxhash64("text"), F.lit(2**31))
        many = F.col("lang").isin(large)
        labelled = labelled.where(~many).unionByName(labelled.where(many & (place < share[F.col("lang")])).distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = _grams(text)
                if lang in total:
                    both, inverse = np.unique(np.concatenate([total[lang][0], codes]), return_inverse=True)
                    codes, counts = both, np.bincount(inverse, weights=np.concatenate([total[lang][1], counts])).astype(np.int64)
                total[lang] = codes, counts
        for lang, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    counted = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most PROFILE grams of each of MAX_LANGUAGES languages come to the driver
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in sorted(counted.withColumn("place", place).where(F.col("place") <= PROFILE).collect(), key=lambda r: (r["lang"], r["place"])):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Adds lang_pred and score (0 to 1) by the text alone; columns of these names are replaced.

    Null text and text without a letter give und and 0, as does a score of 0
    never otherwise: it means that no profile knows any of the text's grams.
    Texts of any length are read whole, in parts; ties go to the first language by
    name; repeated rows stay rows; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # at most MAX_LANGUAGES * PROFILE ranks
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, BATCH_ROWS) for b in batches for lo in range(0, b.num_rows, BATCH_ROWS)):
            got = [model.value.predict(t) for t in batch.column(place).to_pylist()]
            names, scores = [g[0] for g in got], [g[1] for g in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
