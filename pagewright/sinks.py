"""Outputs: lines and pages by document, written only where they change, and exports of other shapes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, out: str, as_csv: bool = False) -> None:
    """Lines below out/document=<document>, their file column beside (a partition value such as 007 would be read as 7).

    A document that is written again replaces its own folder and no other.
    """
    session = lines.sparkSession
    kept = session.conf.get("spark.sql.sources.partitionOverwriteMode")
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        by_document = lines.withColumn("document", F.col("file")).repartition("file").sortWithinPartitions("file", "page_num", "line_num").write.mode("overwrite").partitionBy("document")
        by_document.option("header", "true").csv(out) if as_csv else by_document.parquet(out)
    finally:
        session.conf.set("spark.sql.sources.partitionOverwriteMode", kept)


def changed(rows: DataFrame, stored: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows whose content (by SHA-256) the stored table (keys, sha256) doesn't hold yet."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return rows.withColumn("sha256", digest).join(stored.select(*keys, "sha256"), [*keys, "sha256"], "left_anti")


def write_changed(rows: DataFrame, out: str, keys: list[str], content: str) -> int:
    """Append rows that are new or changed to a table of contents and digests; how many they were."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = changed(rows, spark.read.parquet(out), keys, content)
    else:
        new = rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    version = f"{out}/.staged"
    new.write.mode("overwrite").parquet(version)  # read back: the table that decides is the one that is written to
    staged = spark.read.parquet(version)
    n = staged.count()
    staged.write.mode("append").parquet(out)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(version), True)
    return n


def write_lexicon(lexicon: DataFrame, out: str, note: str = "") -> None:
    """Tokens by falling frequency as tab-separated text; a line that begins with # and holds no tab says where they come from."""
    rows = lexicon.select("document_frequency", "token", F.concat_ws("\t", "token", F.col("document_frequency").cast("string")).alias("value"))
    if note:
        rows = rows.unionByName(lexicon.sparkSession.createDataFrame([(None, None, f"# {note}".replace("\t", " "))], rows.schema))
    # the order of a text file is one task's: exports of a lexicon are small, tables of it stay Parquet
    rows.repartition(1).sortWithinPartitions(F.desc_nulls_first("document_frequency"), "token").select("value").write.mode("overwrite").text(out)


def write_page_json(pages: DataFrame, out: str) -> None:
    """Pages (file, ...) as JSON lines below out/file=<document>."""
    columns = [c for c in pages.columns if c != "file"]
    pages.select("file", F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").partitionBy("file").text(out)


def write_records(records: DataFrame, out: str) -> None:
    """Document records as JSON, nulls left out, a line each below out/doc_id=<document>."""
    columns = [c for c in records.columns if c != "doc_id"]
    records.select("doc_id", F.to_json(F.struct("doc_id", *columns)).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(out)


def crates(records: DataFrame) -> DataFrame:
    """doc_id and an RO-Crate description of each record (doc_id, license, pages, files): a root dataset, its files and the run that made them."""

    @F.udf("string", useArrow=True)
    def described(doc_id: str, license_: str, files: list[str]) -> str:
        parts = [{"@id": f} for f in files or []]
        graph = [
            {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "./"}, "conformsTo": {"@id": "https://w3id.org/ro/crate/1.1"}},
            {"@id": "./", "@type": "Dataset", "identifier": doc_id, "hasPart": parts, **({"license": license_} if license_ else {})},
            *({"@id": f, "@type": "File"} for f in files or []),
            {"@id": f"#run-{doc_id}", "@type": "CreateAction", "result": parts},
        ]
        return json.dumps({"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": graph}, ensure_ascii=False, sort_keys=True)

    return records.select("doc_id", described(F.col("doc_id").cast("string"), "license", "files").alias("crate"))


def is_current(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs (file, modified) whose output (file, modified) is missing or older than any of them: what a run has to do."""
    newest = inputs.groupBy("file").agg(F.max("modified").alias("_input"))
    done = outputs.groupBy("file").agg(F.min("modified").alias("_output"))
    due = newest.join(done, "file", "left").where("_output IS NULL OR _output < _input").select("file")
    return inputs.join(due, "file", "left_semi")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """file (the name up to the first dot) and modified of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.split(F.element_at(F.split("path", "/"), -1), r"\.")[0].alias("file"), F.col("modificationTime").alias("modified"), "path")
