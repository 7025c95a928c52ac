"""The per-line signals, one place for all plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import config as C

from . import notation as N
from . import text as T
from .witness import clauses_of
from .words import FIELDS, words_of

# {t} is the text column
GARBAGE = T.ratio(r"length(regexp_replace({t}, '[\\p{L}\\p{N} ]', ''))", "length({t})")
VOWEL = T.ratio("length(regexp_replace({t}, " + T.char_class(C.VOWELS, negate=True) + ", ''))", r"length(regexp_replace({t}, '[\\p{N}\\s]', ''))")
ROTATABLE = T.ratio("length(regexp_replace(lower({t}), '[^" + C.ROTATABLE + "]', ''))", r"length(regexp_replace({t}, '[^\\p{L}]', ''))")
SYMBOL = T.ratio(r"length(regexp_replace({t}, '[\\p{L}\\p{N}\\s]', ''))", "length({t})")
DIGIT = T.ratio(r"length(regexp_replace({t}, '[^\\p{Nd}]', ''))", "length({t})")


def ratio_of(template: str, column: str) -> str:
    return template.replace("{t}", column)


def trust(cfg: C.EngineConfig = C.DEFAULT) -> str:
    """The language score, weighted by how far the language is expected."""
    base = "element_at(split(original_lang, '_'), 1)"
    expected, trusted = T.array(cfg.expected_langs), T.array(cfg.trusted_langs)
    return f"original_lang_score * CASE WHEN array_contains({expected}, {base}) THEN 1D WHEN array_contains({trusted}, {base}) THEN {cfg.trusted_tier}D ELSE {cfg.unknown_tier}D END"


def with_signals(df: DataFrame, cfg: C.EngineConfig = C.DEFAULT) -> DataFrame:
    """Lines (text, original_text, original_lang, original_lang_score, perplex_raw) with every signal.

    Density and vowels are those of original_text, the others those of text.
    """
    df = df.withColumn("_words", words_of("text"))
    df = df.withColumns({name: F.col(f"_words.{name}") for name in FIELDS} | {"_t": F.expr(N.squeezed())}).drop("_words")
    df = df.withColumns(
        {
            "char_count": F.coalesce(F.length("text"), F.lit(0)),
            "garbage_density": F.expr(ratio_of(GARBAGE, "original_text")),
            "vowel_ratio": F.expr(ratio_of(VOWEL, "original_text")),
            "has_diacritics": F.expr(f"text rlike {T.char_class(C.CZECH_DIACRITICS)}"),
            "bigram_run": F.expr(r"text rlike '(\\p{L}{2})\\1\\1'"),
            "structured": F.expr(N.structured("_t")),
            "clean_reference": F.expr(N.clean_reference("_t")),
            "notation": F.expr(N.notation("_t")),
            "address": F.expr(N.address("_t")),
        }
    ).drop("_t")
    df = df.withColumns(
        {
            "trust": F.expr(trust(cfg)),
            "perplex": F.expr(f"CASE WHEN word_count <= 2 AND perplex_raw > {cfg.short_perplexity_cap} THEN {cfg.short_perplexity_cap}D ELSE perplex_raw END"),
            "gibberish_ratio": F.expr("(gibberish + weird_wx) / cast(greatest(word_count, 1) AS double)"),
            "fused_ratio": F.expr("fused_words / cast(greatest(word_count, 1) AS double)"),
        }
    )
    if cfg.witness:
        seen = F.size(clauses_of("text", "original_lang")) > 0
        return df.withColumn("witness", ~F.col("has_diacritics") & ~F.col("structured") & ~F.col("notation") & seen)
    return df.withColumn("witness", F.lit(False))
