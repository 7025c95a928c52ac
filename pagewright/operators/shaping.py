"""Line shaping: hyphenation, marked splits, newlines, layout boxes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

HYPHENS = "-\u00ad–—"


def dehyphenated(column: str = "text") -> str:
    """SQL: lines of a text that end in a hyphen or dash joined to the next."""
    return rf"concat(trim(regexp_replace({column}, '[{HYPHENS}][ \\t]*\n[ \\t]*', '')), '\n')"


def dehyphenate_lines(lines: DataFrame) -> DataFrame:
    """Per page: runs of lines that end in a hyphen fuse with the line after them, under the first's number."""
    order = Window.partitionBy("file", "page_num").orderBy("line_num")
    open_ = F.coalesce(F.rtrim("text").rlike(f"[{HYPHENS}]$"), F.lit(False))
    df = lines.withColumn("_joins", F.coalesce(F.lag(open_).over(order), F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(order))
    last = F.lead("_run").over(order) != F.col("_run")
    part = F.when(open_ & ~F.coalesce(last, F.lit(True)), F.regexp_replace(F.rtrim("text"), f"[{HYPHENS}]$", "")).otherwise(F.col("text"))
    joined = "array_join(transform(array_sort(collect_list(struct(line_num AS l, part AS p))), x -> x.p), '')"
    return df.withColumn("part", part).groupBy("file", "page_num", "_run").agg(F.min("line_num").alias("line_num"), F.expr(joined).alias("text"), F.count("*").alias("parts")).drop("_run")


def merge_marked_splits(lines: DataFrame) -> DataFrame:
    """`pre- {prefix}` becomes prefix; the next line loses the rest of the word where it begins with it."""
    pattern = r"(\\S+?)[-\u00ad]\\s*\\{([^}]+)\\}"
    whole = f"element_at(regexp_extract_all(text, '{pattern}', 2), -1)"
    begun = f"element_at(regexp_extract_all(text, '{pattern}', 1), -1)"
    has = f"size(regexp_extract_all(text, '{pattern}', 2)) > 0"
    df = lines.withColumn("split_ws", F.expr(f"CASE WHEN {has} THEN {begun} END")).withColumn("_rest", F.expr(f"CASE WHEN {has} AND startswith({whole}, {begun}) THEN substr({whole}, length({begun}) + 1) END"))
    df = df.withColumn("merged", F.expr(f"regexp_replace(text, '{pattern}', '$2')"))
    previous = F.lag("_rest").over(Window.partitionBy("file", "page_num").orderBy("line_num"))
    df = df.withColumn("split_we", previous)
    cut = "startswith(ltrim(merged), split_we) AND split_we <> ''"
    return df.withColumn("merged", F.expr(f"CASE WHEN {cut} THEN trim(substr(ltrim(merged), length(split_we) + 1)) ELSE merged END")).drop("_rest")


def normalised_newlines(column: str) -> str:
    return rf"regexp_replace({column}, '\r\n|[\r\u000b\u001c\u001d\u001e\u0085\u2028\u2029]', '\n')"


def text_to_pages(df: DataFrame) -> DataFrame:
    """file, text -> a row a page: parts between form feeds, trailing empty ones dropped."""
    body = "regexp_replace(text, '[\n\f]+$', '')"
    return df.select("file", F.posexplode(F.split(F.expr(body), "\f")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("page_num"), "text")


def doc_and_page(path: str = "path") -> tuple[str, str]:
    """SQL of a page file's document and page: the last hyphen parts them."""
    stem = f"regexp_replace(element_at(split({path}, '/'), -1), '[.][^/]*$', '')"
    return f"regexp_replace({stem}, '-[^-]*$', '')", f"element_at(split({stem}, '-'), -1)"


def normalised_box(value: str, size: str) -> str:
    """SQL: pixels to 0..1000, halves to even."""
    return f"cast(least(1000, greatest(0, bround({value} * 1000D / {size}))) AS int)"


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """Lines with top and bottom -> starts_paragraph: the gap is over 1.5 median heights, or under -1 (a new column)."""
    page = Window.partitionBy("file", "page_num")
    height = F.col("bottom") - F.col("top")
    middle = F.median(F.when(height > 5, height)).over(page)
    gap = F.col("top") - F.lag("bottom").over(page.orderBy("line_num"))
    return lines.withColumn("starts_paragraph", F.coalesce((gap > 1.5 * middle) | (gap < -middle), F.lit(False)))


def family_key(column: str = "text") -> str:
    """SQL: lower case, single spaces, no symbols at the ends."""
    return rf"regexp_replace(regexp_replace(lower({column}), '\\s+', ' '), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '')"


def mojibake(column: str = "text") -> str:
    """SQL: signs of Central European text read with the Western code page."""
    wrong = r"[ìèïòøùŸœ¾¹Ïž]"
    return f"(regexp_count({column}, '{wrong}') >= 2 AND {column} rlike {T.char_class('áéíóúý')} AND NOT {column} rlike '[äöüßñç]')"


# What normalisation replaces or removes.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
INVISIBLE = "\u200b\u2060\ufeff\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SPACES, HYPHEN_MARKS = "\u00a0\u2007\u202f", "\u00ad\x02\ufffe"
_GLYPHS = str.maketrans({**LIGATURES, **dict.fromkeys(INVISIBLE, ""), **dict.fromkeys(SPACES, " ")})


def normalised_line(line: str) -> str:
    """Composed characters, no ligatures, marks or control characters; a hyphenation mark at the end becomes a hyphen."""
    text = unicodedata.normalize("NFC", line.encode("utf-8", "ignore").decode()).translate(_GLYPHS).rstrip()
    ending = "-" if text[-1:] and text[-1] in HYPHEN_MARKS else ""
    kept = (c for c in text if c not in HYPHEN_MARKS and (c == "\t" or unicodedata.category(c) != "Cc"))
    return ("".join(kept) + ending).strip()


def wrapped(line: str, width: int) -> list[str]:
    """Pieces of at most width characters, broken at the last blank (else tab) that fits, else at width."""
    out = []
    while 0 < width < len(line):
        at = next((p for sign in " \t" if (p := line.rfind(sign, 0, width + 1)) > 0), None)
        head, line = (line[:width], line[width:]) if at is None else (line[:at].rstrip(), line[at + 1 :].lstrip())
        out.append(head)
    return [*out, line] if line or not out else out


def shaped(text: str | None, width: int = 1000, keep_blank: bool = False) -> list[str]:
    """Lines of a text, normalised and wrapped; blank ones go unless they are to be kept."""
    found = (normalised_line(p) for p in re.split(r"\r\n|[\n\r\f\v\x1c-\x1e\x85\u2028\u2029]", text or ""))
    return [piece for x in found for piece in (wrapped(x, width) if x else [""] if keep_blank else [])]


def shape_lines(lines: DataFrame, width: int = 1000, keep_blank: bool = False) -> DataFrame:
    """Lines (file, page_num, line_num, text) shaped, and numbered anew on each page."""

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return pd.Series([shaped(t, width, keep_blank) for t in text])

    parts = lines.select("file", "page_num", "line_num", F.posexplode(pieces("text")).alias("piece", "text"))
    n = F.row_number().over(Window.partitionBy("file", "page_num").orderBy("line_num", "piece"))
    return parts.withColumn("line_num", n).drop("piece")


def page_texts(lines: DataFrame) -> DataFrame:
    """Lines with top and bottom -> one text a page, a blank line where a paragraph starts."""
    marked = paragraph_breaks(lines)
    entry = F.struct("line_num", F.when(F.col("starts_paragraph"), F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("t"))
    return marked.groupBy("file", "page_num").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n")).alias("text"))

