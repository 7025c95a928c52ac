"""Folders of documents of any readable kind as line and report DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import Unreadable
from .readers import read

LINES = "file string, path string, kind string, page_num int, page_label string, line_num int, text string, status string, reason string"
IGNORED = r"(?i)(^|/)(\.|~\$|thumbs\.db$|desktop\.ini$)"


def _rows(path: str, content: bytes) -> list[tuple]:
    name = path.rsplit("/", 1)[-1]
    file = name.split(".", 1)[0]
    try:
        kind, pages = read(content, name)
    except Unreadable as e:
        return [(file, path, None, None, None, None, None, "error", str(e))]
    except Exception as e:  # one broken file is that file's error
        return [(file, path, None, None, None, None, None, "error", f"broken: {type(e).__name__}")]
    out = [(file, path, kind, p, label or str(p), n, text, "ok", None) for p, (label, lines) in enumerate(pages, 1) for n, text in enumerate(lines, 1)]
    return out or [(file, path, kind, None, None, None, None, "error", "no_text")]


def read_documents(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> LINES; a file that can't be read is one row with its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LINES.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_rows(path, bytes(content)), columns=names).astype({"page_num": "Int32", "line_num": "Int32"})

    return files.select("path", "content").mapInPandas(run, LINES)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read_documents(files.where(~F.col("path").rlike(IGNORED)))


def ingest_report(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file", "path", "kind", "status", "reason").agg(F.max("page_num").alias("pages"), F.count("text").alias("lines"), F.sum(F.length("text")).alias("chars"))


def page_index(lines: DataFrame) -> DataFrame:
    """Non-blank lines and white-space tokens of each page."""
    filled = F.trim("text") != ""
    return lines.where("page_num IS NOT NULL").groupBy("file", "page_num").agg(F.count_if(filled).alias("textlines"), F.sum(F.when(filled, F.size(F.split(F.trim("text"), r"\s+"))).otherwise(0)).alias("strings"))
