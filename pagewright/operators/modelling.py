"""Data for quality models: damaged variants, splits, and checks of what was made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.corruption import BANDS, corrupt, generator

from .sampling import keep_first, splits

VARIANTS = "file string, page_num int, line_num int, variant int, band string, ops string, text string, source_text string"


def variants(lines: DataFrame, seed: int = 23) -> DataFrame:
    """Of every line one damaged copy a band; the same seed gives the same rows on any cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in VARIANTS.split(", ")]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for k, band in enumerate(BANDS):
                    text, ops = corrupt(r.text or "", generator(seed, r.file, r.page_num * 100_000 + r.line_num, k), band)
                    rows.append((r.file, r.page_num, r.line_num, k, band, ",".join(ops), text, r.text))
            yield pd.DataFrame(rows, columns=names)

    return lines.select("file", "page_num", "line_num", "text").mapInPandas(run, VARIANTS)


def dataset(lines: DataFrame, seed: int = 23) -> DataFrame:
    """Clean lines and their variants, equal texts once, split by document before anything is learned."""
    clean = lines.select("file", "page_num", "line_num", F.lit(-1).alias("variant"), F.lit("clean").alias("band"), F.lit("").alias("ops"), "text", F.col("text").alias("source_text"))
    both = clean.unionByName(variants(lines, seed)).withColumn("key", F.trim(F.regexp_replace("text", r"\s+", " ")))
    once = keep_first(both, ["key"], ["variant", "file", "page_num", "line_num"]).drop("key")
    return splits(once, "file", str(seed))


def balanced(items: DataFrame, score: str, bins: int = 20, cap: int = 1000) -> DataFrame:
    """At most cap training rows of each score bin, by hash; other splits stay whole."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    n = F.row_number().over(Window.partitionBy("split", b).orderBy(F.md5("text"), "file", "page_num", "line_num"))
    return items.withColumn("_n", n).where((F.col("split") != "train") | (F.col("_n") <= cap)).drop("_n")


def monotonicity(rows: DataFrame, score: str, severity: str = "variant") -> DataFrame:
    """Share of pairs of one source line in which the more damaged one doesn't score higher."""
    a = rows.select("file", "page_num", "line_num", F.col(severity).alias("s1"), F.col(score).alias("q1"))
    b = rows.select("file", "page_num", "line_num", F.col(severity).alias("s2"), F.col(score).alias("q2"))
    pairs = a.join(b, ["file", "page_num", "line_num"]).where("s1 < s2")  # few variants a line
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("q1") >= F.col("q2")).alias("ordered"), F.avg((F.col("q1") >= F.col("q2")).cast("double")).alias("share"))


def context(lines: DataFrame, wanted: str = "true", width: int = 2) -> DataFrame:
    """Wanted lines with width lines of their page on either side, themselves marked."""
    around = Window.partitionBy("file", "page_num").orderBy("line_num")
    before = [F.lag("text", k).over(around) for k in range(width, 0, -1)]
    after = [F.lead("text", k).over(around) for k in range(1, width + 1)]
    marked = F.concat(F.lit(">>"), F.coalesce("text", F.lit("")), F.lit("<<"))
    return lines.withColumn("context", F.array_join(F.filter(F.array(*before, marked, *after), lambda x: x.isNotNull()), "\n")).where(wanted)


def score_histogram(lines: DataFrame, score: str = "quality_score", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return lines.groupBy(b.alias("bin"), "categ").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def decade(file: str = "file") -> str:
    """SQL: the decade in an id such as AB196412345, 1900 to 2030; else unknown."""
    year = f"cast(nullif(regexp_extract({file}, '^[A-Za-z]{{2,4}}([0-9]{{4}})', 1), '') AS int)"
    return f"CASE WHEN {year} BETWEEN 1900 AND 2030 THEN concat(cast({year} div 10 * 10 AS string), 's') ELSE 'unknown' END"


def correction_delta(before: DataFrame, after: DataFrame, keys: list[str], score: str = "quality_score") -> DataFrame:
    """How a correction moved scores: mean, median, shares improved and degraded."""
    both = before.select(*keys, F.col(score).alias("q0")).join(after.select(*keys, F.col(score).alias("q1")), keys)
    d = F.col("q1") - F.col("q0")
    return both.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.avg((d > 0).cast("double")).alias("improved"), F.avg((d < 0).cast("double")).alias("degraded"))


FEATURES = ("word_count", "char_count", "garbage_density", "vowel_ratio", "rot_ratio", "word_weird", "valid_word_ratio", "gibberish_ratio", "fused_ratio", "perplex")


def train_regressor(rows: DataFrame, target: str, features: tuple[str, ...] = FEATURES, depth: int = 5, rounds: int = 50, seed: int = 7):
    """A pipeline of gradient-boosted trees that predicts target from signals; missing features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = rows.select(target, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), GBTRegressor(labelCol=target, featuresCol="features", maxDepth=depth, maxIter=rounds, seed=seed)]
    return Pipeline(stages=stages).fit(ready)

