"""From documents to the (file, page, line) fact table, and routing before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as T

LINES_PER_PAGE = 40
LANGUAGES = {"de": "deu_Latn", "en": "eng_Latn", "fr": "fra_Latn", "es": "spa_Latn", "cs": "ces_Latn"}


def explode_lines(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """doc_id, text, lang -> file, page_num, line_num (from 1, anew on each page), text, lang."""
    pos = documents.select(F.col("doc_id").cast("string").alias("file"), "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return pos.select(
        "file", (F.floor(F.col("pos") / lines_per_page) + 1).cast("int").alias("page_num"), (F.col("pos") % lines_per_page + 1).cast("int").alias("line_num"), "text", "lang"
    )


def with_model_columns(lines: DataFrame) -> DataFrame:
    """Language and perplexity are inputs of the engine; these stand-ins are computed from the text's md5.

    original_lang by the document's lang, original_lang_score in [0.3, 1),
    perplex_raw in [10, 5010) with most of its mass low.
    """
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    share = lambda at: F.conv(F.substring(F.md5("text"), at, 6), 16, 10).cast("double") / 16777216
    return lines.withColumns(
        {
            "original_text": F.col("text"),
            "original_lang": F.coalesce(known[F.col("lang")], F.lit("und")),
            "original_lang_score": 0.3 + 0.7 * share(1),
            "perplex_raw": 10 + 5000 * share(7) * share(7) * share(7),
        }
    ).drop("lang")


def remap_language(df: DataFrame, default: str = "ces", known: tuple[str, ...] = C.DEFAULT.expected_langs + C.DEFAULT.trusted_langs) -> DataFrame:
    """Adds lang and lang_score: an unknown language becomes the default one, its score capped by script; slk keeps its score."""
    base = "element_at(split(original_lang, '_'), 1)"
    suffix = f"substr(original_lang, length({base}) + 1)"
    listed = f"array_contains({T.array(sorted(set(known)))}, {base})"
    return df.withColumns(
        {
            "lang": F.expr(f"CASE WHEN {listed} THEN original_lang ELSE concat('{default}', {suffix}) END"),
            "lang_score": F.expr(f"CASE WHEN {listed} OR {base} = 'slk' THEN original_lang_score WHEN {suffix} = '_Latn' THEN 0.75D ELSE 0.5D END"),
        }
    )


def repaired(column: str = "text") -> str:
    """A 1 between letters is an l, a 2 that begins a lower-case word a z; spaced capitals close up."""
    # a look-behind is tried at every place of a line, so what a change needs is looked for first
    one = rf"regexp_replace({column}, '(?<=\\p{{L}})1(?=\\p{{L}})', 'l')"
    two = rf"regexp_replace({one}, '(?<![\\p{{L}}\\p{{N}}.,])2(?=\\p{{Ll}})', 'z')"
    two = f"CASE WHEN instr({column}, '1') > 0 OR instr({column}, '2') > 0 THEN {two} ELSE {column} END"
    caps = r"(?<!\\S)(?:\\p{Lu} ){3,}\\p{Lu}(?!\\S)"
    return f"CASE WHEN {column} rlike '(?:\\\\p{{Lu}} ){{3}}\\\\p{{Lu}}' AND {two} rlike '{caps}' THEN regexp_replace({two}, '{caps}', initcap(replace(regexp_extract({two}, '{caps}', 0), ' ', ''))) ELSE {two} END"


def is_non_text(t: str) -> str:
    """Numbers and punctuation alone, archive codes, reference numbers, mostly digits."""
    return (
        rf"(({t} rlike '^[\\p{{Nd}}\\s–—/:.,()%-]+$' AND NOT {t} rlike '^\\p{{Nd}}{{3}} \\p{{Nd}}{{2}}$') OR {t} rlike '^[A-Za-z]{{1,3}}\\p{{Nd}}{{3,}}(?:/\\p{{Nd}}+)?$'"
        rf" OR ({t} rlike '^[A-Za-z0-9]{{5,}}$' AND {t} rlike '[0-9]') OR {t} rlike '^\\p{{L}}{{1,5}}[\\s.-]+\\p{{Nd}}+$'"
        rf" OR (length({t}) < 15 AND {T.digits(t)} / cast(length({t}) AS double) > 0.5))"
    )


def headline(t: str = "text") -> str:
    """Up to 8 tokens, each a number, abbreviation or clean word; some clean word beside another kind."""
    tokens = T.tokens(t)
    clean = rf"{T.core('x')} rlike '^\\p{{L}}{{3,}}$' AND {T.core('x')} rlike {T.char_class(C.VOWELS)}"
    other = rf"x rlike '^(?:\\p{{Nd}}{{1,4}}[.)]?|[IVXLCDM]+\\.?|\\p{{L}}{{1,5}}\\.)$' OR array_contains({T.array(C.SHORT_VALID)}, lower({T.core('x')}))"
    return f"(size({tokens}) BETWEEN 1 AND 8 AND forall({tokens}, x -> ({clean}) OR ({other})) AND exists({tokens}, x -> {clean} AND NOT ({other})) AND exists({tokens}, x -> {other}))"


def route(df: DataFrame) -> DataFrame:
    """Adds route: Empty, Non-text or Process, and repairs text; the first rule that matches decides."""
    df = df.withColumn("text", F.expr(repaired("text"))).withColumn("_t", F.expr("trim(text)"))
    marker = " OR ".join(f"instr(lower(text), {T.quoted(m.lower())}) > 0" for m in C.METADATA_MARKERS)
    nontext = " OR ".join(f"instr(text, {T.quoted(m)}) > 0" for m in C.NON_TEXT_MARKERS)
    anchors = rf"size(filter({T.tokens('_t')}, w -> w rlike '^\\p{{L}}{{3,}}$' AND {T.count('w', T.char_class(C.VOWELS))} / cast(length(w) AS double) >= 0.1)) >= 2"
    lettered = rf"filter({T.tokens('_t')}, w -> w rlike '\\p{{L}}')"
    single = rf"regexp_replace(w, '[^\\p{{L}}]', '')"
    lone = f"size(filter({lettered}, w -> length({single}) = 1 AND instr({T.quoted(C.SINGLE_ALLOWED)}, {single}) = 0))"
    spread = (
        f"size({T.tokens('_t')}) >= 3 AND size({lettered}) > 0 AND (forall({lettered}, w -> length({single}) = 1) OR {lone} / cast(size({lettered}) AS double) >= 0.4)"
    )
    mixed = rf"size({T.tokens('_t')}) = 1 AND _t rlike '\\p{{L}}' AND _t rlike '\\p{{Nd}}' AND {T.strange('_t')} > 0"
    cases = [
        ("text IS NULL OR _t = ''", C.EMPTY), (marker, "Process"), (headline("_t"), "Process"), (is_non_text("_t"), C.NON_TEXT),
        (r"_t rlike '^[IVXLCDMivxlcdm]+\\.?$'", C.NON_TEXT), (r"_t rlike '^[A-Za-z]*[^\\p{L}\\p{N}]*\\p{Nd}{2,4}\\s*/\\s*\\p{Nd}{2,4}[^\\p{L}\\p{N}]*$'", C.NON_TEXT), (nontext, C.NON_TEXT),
        (anchors, "Process"), (f"{T.digits('_t')} / cast(length(_t) AS double) > 0.4", "Process"),
        ("length(_t) < 4 OR size(array_distinct(filter(split(replace(_t, ' ', ''), ''), c -> c <> ''))) < 3", C.NON_TEXT),
        (f"{T.letters('_t')} / cast(length(_t) AS double) < 0.3", C.NON_TEXT), (mixed, C.NON_TEXT), (spread, C.NON_TEXT),
    ]
    return df.withColumn("route", F.expr("CASE " + " ".join(f"WHEN {test} THEN '{to}'" for test, to in cases) + " ELSE 'Process' END")).drop("_t")
