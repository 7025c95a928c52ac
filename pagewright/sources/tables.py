"""Tables of earlier stages as sources: line CSVs, page indexes, listings of page files, and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a line table that aren't strings; every other column is read as one.
NUMBERS = {
    "page_num": "int", "line_num": "int", "quality_score": "double", "lang_score": "double", "orig_lang_score": "double", "perplex": "double", "perplex_raw": "double", "perplex_blend": "double",
    "word_count": "int", "char_count": "int", "garbage_density": "double", "upper": "int", "repeated": "int", "ldl_fuses": "int", "fused_words": "int", "gibberish": "int", "weird_wx": "int",
    "word_weird": "double", "vowel_ratio": "double", "rot_ratio": "double", "valid_word_ratio": "double",
}
PAGE_INDEX = "file string, page int, textlines int, illustrations int, graphics int, strings int, path string"
MOST_ID_BYTES = 200


def read_lines(spark: SparkSession, path: str, file_id: str | None = None, recursive: bool = False) -> DataFrame:
    """Line CSVs, columns by name whatever their order or number; only an empty field is null.

    file comes from file_id, else from the column, else from the name of the CSV.
    """
    options = {"header": "true", "nullValue": "", "emptyValue": "", "multiLine": "true", "escape": '"', "enforceSchema": "false", "recursiveFileLookup": str(recursive).lower(), "pathGlobFilter": "*.csv"}
    if path.endswith(".csv"):
        options.pop("pathGlobFilter")
    df = spark.read.options(**options).csv(path)
    df = df.select(*[F.col(f"`{c}`").cast(NUMBERS[c]).alias(c) if c in NUMBERS else F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_name").alias("_name"))
    own = F.regexp_replace("_name", r"\.csv$", "")
    file = F.lit(file_id) if file_id is not None else F.coalesce("file", own) if "file" in df.columns else own
    return df.withColumn("file", file).drop("_name")


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """A page index with file kept as text ('0007' stays) and only empty fields null."""
    return spark.read.options(header="true", nullValue="", emptyValue="").schema(PAGE_INDEX).csv(path)


def page_files(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """path, name, parent of page files in a folder and in its visible folders, one level down."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(folder).select("path", "modificationTime", "length")
    root = F.lit(folder.rstrip("/").split(":", 1)[-1].lstrip("/"))
    below = F.element_at(F.split("path", root, 2), -1)
    files = files.withColumns({"below": F.regexp_replace(below, "^/+", ""), "name": F.element_at(F.split("path", "/"), -1)})
    depth = F.size(F.split("below", "/"))
    return files.where((depth <= 2) & ~F.col("below").rlike(r"^\.")).withColumn("parent", F.when(depth == 2, F.split("below", "/")[0])).drop("below")


def with_page_text(index: DataFrame, pages: DataFrame) -> DataFrame:
    """index (file, page) with the text of its page file (name, text): file-page.txt, else file_page.txt."""
    found = pages.select("name", "text")
    key = lambda sign: F.concat("file", F.lit(sign), F.col("page").cast("string"), F.lit(".txt"))
    one, two = found.toDF("_n1", "_t1"), found.toDF("_n2", "_t2")
    out = index.join(one, key("-") == F.col("_n1"), "left").join(two, key("_") == F.col("_n2"), "left")
    return out.withColumn("text", F.coalesce("_t1", "_t2")).drop("_n1", "_t1", "_n2", "_t2")


def with_images(index: DataFrame, images: DataFrame) -> DataFrame:
    """index with the number of images of each page, 0 where none is known."""
    return index.join(images.groupBy("file", "page").agg(F.sum("images").alias("images")), ["file", "page"], "left").fillna(0, subset=["images"])


def with_labels(index: DataFrame, labels: DataFrame) -> DataFrame:
    """index with each page's printed label, else its number."""
    known = labels.groupBy("file", "page").agg(F.min("page_label").alias("page_label"))
    return index.join(known, ["file", "page"], "left").withColumn("page_label", F.coalesce("page_label", F.col("page").cast("string")))


def outside_index(outputs: DataFrame, index: DataFrame) -> DataFrame:
    """Outputs whose document the index doesn't hold."""
    return outputs.join(index.select("file").distinct(), "file", "left_anti")


def colliding_ids(files: DataFrame) -> DataFrame:
    """Files (file, path) whose document id an earlier path has too, whatever the case."""
    n = F.row_number().over(Window.partitionBy(F.lower("file")).orderBy("path"))
    return files.withColumn("_n", n).where("_n > 1").drop("_n")


def id_problem(column: str = "file") -> str:
    """SQL: why a document id can't be used, or null."""
    return (
        f"CASE WHEN coalesce({column}, '') IN ('', '.', '..') THEN 'empty document id' WHEN {column} rlike '\\\\p{{Cc}}' THEN 'control characters in the file name'"
        f" WHEN {column} rlike '[/\\\\\\\\]' THEN 'path separator in the document id' WHEN octet_length({column}) > {MOST_ID_BYTES} THEN 'document id longer than {MOST_ID_BYTES} bytes' END"
    )


def distinct_pages(lines: DataFrame) -> DataFrame:
    return lines.select("file", "page_num").distinct()


def grouped_pages(index: DataFrame, page: str = "page") -> DataFrame:
    """file and its pages in order, each once."""
    return index.groupBy("file").agg(F.array_sort(F.collect_set(page)).alias("pages"))


def counts_with_stats(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Pages of a count table with their statistics, where there are any."""
    return counts.join(stats, ["file", "page_num"], "left")
