"""Caps, quotas, splits and keep-first, by hash order instead of a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*columns: str, seed: str = "0") -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def per_document_cap(lines: DataFrame, cap: int) -> DataFrame:
    """The first cap lines of each document."""
    return lines.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("page_num", "line_num"))).where(F.col("_n") <= cap).drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def stratified(df: DataFrame, stratum: str, key: str, total: int) -> DataFrame:
    """total rows shared among strata by largest remainders, drawn by hash; weight is rows for each drawn."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    whole = sizes.withColumn("exact", F.lit(total) * F.col("size") / F.sum("size").over(Window.partitionBy())).withColumn("base", F.floor("exact"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("exact") - F.col("base")), stratum))
    quota = whole.withColumn("quota", F.least(F.col("base") + (rank <= left).cast("int"), F.col("size"))).select(stratum, "size", "quota")
    drawn = df.join(F.broadcast(quota), stratum).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(key), key)))
    return drawn.where("_n <= quota").withColumn("weight", F.col("size") / F.col("quota")).drop("_n")


def splits(df: DataFrame, key: str, seed: str = "0", train: int = 80, validation: int = 10) -> DataFrame:
    """train, val or test for all rows of a key."""
    bucket = F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + validation, "val").otherwise("test"))
