"""Nested document records: ownership, merging, licences, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Licences from the least to the most restrictive; an unknown one is more restrictive than all.
LICENSE_RANK = ("CC0-1.0", "MIT", "BSD-3-Clause", "Apache-2.0", "CC-BY-4.0", "LGPL-3.0", "MPL-2.0", "GPL-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
ALIASES = {"mit license": "MIT", "apache 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "gplv3": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by 4.0": "CC-BY-4.0"}


def merge_block(stored: DataFrame, incoming: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """Upsert by key: own fields come from incoming rows where there are any, all other fields survive."""
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_in"))
    out = stored.join(new, keys, "full_outer")
    return out.select(*keys, *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in stored.columns if c not in keys])


def lost_fields(stored: DataFrame, merged: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows whose fields didn't survive a merge."""
    return stored.select(*keys, *fields).exceptAll(merged.select(*keys, *fields))


def fan_in(records: DataFrame, block: str = "block", updated: str = "updated_at", arrival: str = "arrival") -> DataFrame:
    """Of each document's block the newest version; ties go to the first read."""
    best = Window.partitionBy("doc_id", block).orderBy(F.desc(updated), arrival)
    return records.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def normalised_license(column: str = "license") -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in ALIASES.items())
    return f"coalesce(try_element_at(map({pairs}), lower(trim({column}))), trim({column}))"


def effective_license(components: DataFrame) -> DataFrame:
    """doc_id, license rows -> the most restrictive licence of each document (ties by name), and how many there are."""
    ranks = ", ".join(f"'{k}', {i}" for i, k in enumerate(LICENSE_RANK))
    df = components.withColumn("name", F.expr(normalised_license())).withColumn("rank", F.expr(f"coalesce(try_element_at(map({ranks}), name), {len(LICENSE_RANK)})"))
    best = F.min(F.struct((-F.col("rank")).alias("minus"), F.col("name"))).alias("best")
    out = df.groupBy("doc_id").agg(best, F.count_distinct("name").alias("components"))
    return out.select("doc_id", F.col("best.name").alias("effective_license"), (-F.col("best.minus")).alias("rank"), "components")


def originator(column: str = "origin") -> str:
    return f"CASE WHEN lower({column}) LIKE 'ocr:%' THEN 'ocr' WHEN lower({column}) LIKE 'pdf:%' THEN 'pdf' WHEN lower({column}) LIKE 'text:%' THEN 'text' ELSE 'unknown' END"


def unknown_labels(observed: DataFrame, allowed: list[str], column: str = "label") -> DataFrame:
    """Labels that the vocabulary doesn't hold, with their counts; advice, never an error."""
    return observed.where(~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def run_summary(lines: DataFrame) -> DataFrame:
    """One row on a run: documents, pages, lines by status."""
    return lines.groupBy("status").agg(F.count_distinct("file").alias("documents"), F.count("*").alias("rows"))


# Notes and page flags that mean lost text.
LOSSY_NOTES = ("xml_recovered", "decode_replacement", "jsonl_bad_records", "csv_unbalanced_quote", "tsv_bad_rows", "xlsx_bad_shared_string")
LOSSY_FLAGS = ("page_load_failed",)
ORIGIN_OF_KIND = {"alto": "ocr:alto", "page_xml": "ocr:page", "abbyy": "ABBYY-ALTO", "djvu": "ocr:djvu", "tesseract": "ocr:tesseract", "docx": "digital-born-docx", "html": "digital-born-html", "epub": "digital-born-epub"}


def set_source(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first writer of a source field wins: incoming fields fill only unset ones. Also the conflicts (keys, field, kept, refused).

    A sha256 isn't added beside a sha512.
    """
    fields = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    both = stored.join(new, keys, "full")
    value = lambda c: F.coalesce(c, F.when(F.col("sha512").isNull(), F.col(f"_{c}"))) if c == "sha256" and "sha512" in stored.columns else F.coalesce(c, f"_{c}")
    merged = both.select(*keys, *[value(c).alias(c) if c in fields else F.col(c) for c in stored.columns if c not in keys])
    conflicts = both.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("kept"), F.col(f"_{c}").cast("string").alias("refused")) for c in fields if c in stored.columns])))
    return merged, conflicts.where("kept IS NOT NULL AND refused IS NOT NULL AND kept <> refused")


def line_records(lines: DataFrame) -> DataFrame:
    """One row a document: its lines in order as JSON objects without what is missing."""
    shown = [c for c in ("page_num", "line_num", "categ", "quality_score", "lang", "text") if c in lines.columns]
    entry = F.struct("page_num", "line_num", F.to_json(F.struct(*shown)).alias("json"))
    return lines.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["json"]).alias("lines"))


def page_records(lines: DataFrame, places: int = 4) -> DataFrame:
    """Pages with mean score (to so many places) and band from classified lines; a page without Clear, Noisy or Trash lines has neither."""
    n = {c: F.count_if(F.col("categ") == c) for c in ("Clear", "Noisy", "Trash")}
    judged = F.col("categ").isin("Clear", "Noisy", "Trash")
    band = F.when((n["Clear"] >= n["Noisy"]) & (n["Clear"] >= n["Trash"]), "Clear").when(n["Noisy"] >= n["Trash"], "Noisy").otherwise("Trash")
    return lines.groupBy("file", "page_num").agg(F.count("*").alias("num_lines"), F.round(F.avg(F.when(judged, F.col("quality_score"))), places).alias("quality_score"), F.when(F.count_if(judged) > 0, band).alias("quality_band"))


def problems(records: DataFrame, required: dict[str, str]) -> DataFrame:
    """Records (doc_id, ...) against a seed of columns and types: doc_id and the fields that are missing, null or of another type."""
    held = dict(records.dtypes)
    wrong = [F.lit(f"{c}: missing") if c not in held else F.lit(f"{c}: {held[c]}") if held[c] != t else F.when(F.col(c).isNull(), f"{c}: null") for c, t in required.items()]
    return records.select("doc_id", F.array_compact(F.array(*wrong)).alias("problems")).where("size(problems) > 0")


def writable_blocks(blocks: DataFrame, program: str, positional: tuple[str, ...] = ("lines", "pages", "content")) -> DataFrame:
    """Blocks (doc_id, block, origin, handoff) that a program may write: any that isn't positional, else of documents it originated or that were handed to it."""
    own = (F.expr(originator()) == program) | F.coalesce(F.col("handoff"), F.lit(False))
    return blocks.where(~F.col("block").isin(*positional) | own)


def merged_paradata(runs: DataFrame) -> DataFrame:
    """Stage logs (run, stage, started, ended, inputs, processed, skipped, seconds) -> a row a run: inputs of its first stage, what the last processed, sums and span."""
    return runs.groupBy("run").agg(
        F.min_by("inputs", "started").alias("inputs"), F.max_by("processed", "ended").alias("processed"), F.sum("skipped").alias("skipped"), F.sum("seconds").alias("seconds"),
        F.min("started").alias("started"), F.max("ended").alias("ended"), F.count("*").alias("stages"),
    )


def with_limit_note(df: DataFrame, name: str, limit: int, reached: str) -> DataFrame:
    """Adds to notes (an array of name, limit, value) where reached, a SQL number, is over the limit; what shaped a result stays with it."""
    note = F.struct(F.lit(name).alias("name"), F.lit(limit).cast("long").alias("limit"), F.expr(reached).cast("long").alias("value"))
    before = F.col("notes") if "notes" in df.columns else F.array().cast("array<struct<name:string,limit:bigint,value:bigint>>")
    return df.withColumn("notes", F.when(F.expr(reached) > limit, F.array_append(before, note)).otherwise(before))


def lossy_reasons(notes: str = "notes", flags: str = "flags") -> str:
    """SQL: names of notes (name or name=count) and page flags that mean lost text, each once, in order."""
    listed = ", ".join(f"'{n}'" for n in LOSSY_NOTES)
    names = f"filter(transform(coalesce({notes}, array()), n -> element_at(split(n, '='), 1)), n -> array_contains(array({listed}), n))"
    kept = f"filter(coalesce({flags}, array()), f -> array_contains(array({', '.join(repr(f) for f in LOSSY_FLAGS)}), f))"
    return f"array_distinct(concat({names}, {kept}))"


def default_origin(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, kind, origin_hint, text_layer) -> doc_id, origin: the hint; of a PDF its OCR layer if half its text pages have one; else by kind."""
    text = F.col("text_layer").isin("ocr", "digital", "garbled")
    by_kind = F.create_map(*[F.lit(x) for kv in ORIGIN_OF_KIND.items() for x in kv])
    got = pages.groupBy("doc_id").agg(F.max("origin_hint").alias("hint"), F.min("kind").alias("kind"), F.count_if(text).alias("text"), F.count_if(F.col("text_layer") == "ocr").alias("ocr"))
    pdf = F.when((F.col("text") > 0) & (F.col("ocr") * 2 >= F.col("text")), "ocr:pdf-text-layer").otherwise("digital-born-pdf")
    return got.select("doc_id", F.coalesce("hint", F.when(F.col("kind") == "pdf", pdf), by_kind[F.col("kind")], F.lit("ocr:generic")).alias("origin"))


def origins_by_kind(raw: str, known: tuple[str, ...]) -> dict[str, str]:
    """'kind = origin' entries, parted by commas or lines; an unknown, repeated or empty one is an error."""
    out: dict[str, str] = {}
    for entry in filter(None, (p.strip() for line in raw.splitlines() for p in line.split(","))):
        kind, equals, origin = (p.strip() for p in entry.partition("="))
        if not equals or not origin or kind.lower() not in known or kind.lower() in out:
            raise ValueError(f"not one origin for one known kind: {entry!r}")
        out[kind.lower()] = origin
    return out


def resolved_origin(default: str, override: str = "", env: str = "", by_kind: dict[str, str] | None = None, configured: str = "", kind: str = "kind") -> str:
    """SQL: the first origin given of an override, the environment, the kind's, the configured one, and the document's own."""
    quote = lambda x: "'" + x.strip().replace("'", "''") + "'"
    mapped = f"try_element_at(map({', '.join(f'{quote(k)}, {quote(v)}' for k, v in by_kind.items())}), lower({kind}))" if by_kind else "null"
    return f"coalesce(nullif({quote(override)}, ''), nullif({quote(env)}, ''), {mapped}, nullif({quote(configured)}, ''), {default})"


def utc_seconds(column: str) -> F.Column:
    """A timestamp as ISO text in whole seconds of UTC."""
    return F.date_format(F.date_trunc("second", F.col(column)), "yyyy-MM-dd'T'HH:mm:ss'Z'")

