"""Token document frequencies and the neighbours that OCR confuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.notation import folded


def document_frequency(lines: DataFrame, least_letters: int = 4, collection: str | None = None) -> DataFrame:
    """token, document_frequency: one vote a document for each lower-case word of least_letters letters or more."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{{least_letters},}})"), 1))
    votes = lines.select("file", *([collection] if collection else []), words.alias("token")).distinct()
    return votes.groupBy(*([collection] if collection else []), "token").agg(F.count("*").alias("document_frequency"))


def diagnostics(lexicon: DataFrame, least: int = 3) -> DataFrame:
    n, df = F.count("*"), F.col("document_frequency")
    return lexicon.agg(n.alias("tokens"), F.count_if(df >= least).alias("attested"), (F.count_if(df >= least) / n).alias("attested_share"), F.count_if(df == 1).alias("hapax"), (F.count_if(df == 1) / n).alias("hapax_share"))


def deletions(lexicon: DataFrame) -> DataFrame:
    """token, document_frequency, key: the token itself and it without each one of its characters."""
    keys = F.expr("array_distinct(concat(array(token), transform(sequence(1, length(token)), i -> concat(substr(token, 1, i - 1), substr(token, i + 1)))))")
    return lexicon.select("token", "document_frequency", F.explode(keys).alias("key"))


def neighbours(lexicon: DataFrame, strong: int = 10, limit: int = 3) -> DataFrame:
    """For each token below strong: up to limit strong tokens that share a deletion, by frequency, then token."""
    keys = deletions(lexicon)
    weak = keys.where(F.col("document_frequency") < strong).select("token", "key")
    held = keys.where(F.col("document_frequency") >= strong).select(F.col("token").alias("neighbour"), F.col("document_frequency").alias("neighbour_df"), "key")
    found = weak.join(held, "key").select("token", "neighbour", "neighbour_df").distinct()
    best = Window.partitionBy("token").orderBy(F.desc("neighbour_df"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def recoverability(lines: DataFrame, lexicon: DataFrame, strong: int = 10) -> DataFrame:
    """file, queryable, attested, recoverable and their share of each document's distinct words; no words, no opinion."""
    words = lines.select("file", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1)).alias("token")).distinct()
    status = lexicon.select("token", (F.col("document_frequency") >= strong).alias("attested"))
    near = neighbours(lexicon, strong, 1).select("token", F.lit(True).alias("near"))
    got = words.join(status, "token", "left").join(near, "token", "left")
    return got.groupBy("file").agg(F.count("*").alias("queryable"), F.count_if("attested").alias("attested"), F.count_if("near").alias("recoverable"),
                                   F.avg(F.expr("cast(coalesce(attested, false) OR coalesce(near, false) AS double)")).alias("recoverability"))


# Glyphs and letter pairs that OCR takes for each other, in both directions.
CONFUSIONS = (
    ("i", "j"), ("i", "l"), ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"), ("b", "6"), ("g", "9"), ("b", "8"), ("z", "2"), ("u", "v"), ("c", "e"), ("f", "t"), ("h", "b"), ("m", "n"),
    ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("ri", "n"), ("lt", "h"), ("ss", "ß"),
)


def _variants() -> str:
    """SQL: the token with one confusion undone, at each place where one may have happened, or without a doubled initial."""
    both = [pair for a, b in CONFUSIONS for pair in ((a, b), (b, a))]
    listed = ", ".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in both)
    starts = "filter(sequence(1, length(token)), i -> substr(token, i, length(c.a)) = c.a)"
    changed = f"flatten(transform(array({listed}), c -> transform({starts}, i -> concat(substr(token, 1, i - 1), c.b, substr(token, i + length(c.a))))))"
    return f"array_distinct(concat({changed}, CASE WHEN length(token) > 1 AND substr(token, 1, 1) = substr(token, 2, 1) THEN array(substr(token, 2)) ELSE array() END))"


def confusion_candidates(tokens: DataFrame, lexicon: DataFrame, strong: int = 10) -> DataFrame:
    """Tokens (token) -> token, neighbour, neighbour_df, mechanism: strong tokens that restore diacritics, or that a known confusion turns it into."""
    held = lexicon.where(F.col("document_frequency") >= strong).select(F.col("token").alias("neighbour"), F.col("document_frequency").alias("neighbour_df"))
    asked = tokens.select("token").distinct()
    marked = held.withColumn("token", F.expr(folded("neighbour")))
    marks = asked.join(marked, "token").where("token <> neighbour").withColumn("mechanism", F.lit("diacritics"))
    turned = asked.select("token", F.explode(F.expr(_variants())).alias("neighbour")).join(held, "neighbour").where("token <> neighbour").withColumn("mechanism", F.lit("confusion"))
    columns = ["token", "neighbour", "neighbour_df", "mechanism"]
    both = marks.select(*columns).unionByName(turned.select(*columns))
    return both.groupBy("token", "neighbour", "neighbour_df").agg(F.max("mechanism").alias("mechanism"))  # diacritics before confusion


def nearest_attested(lexicon: DataFrame, strong: int = 10, limit: int = 3) -> DataFrame:
    """For each token below strong: up to limit strong tokens by frequency, then token; a confusion or diacritics name the mechanism before edit1 does."""
    weak = lexicon.where((F.col("document_frequency") < strong) & (F.length("token") >= 4)).select("token")
    edits = neighbours(lexicon, strong, 1 << 30).select("token", "neighbour", "neighbour_df", F.lit("edit1").alias("mechanism")).join(weak, "token", "left_semi")
    both = confusion_candidates(weak, lexicon, strong).unionByName(edits)
    order = F.expr("CASE mechanism WHEN 'diacritics' THEN 0 WHEN 'confusion' THEN 1 ELSE 2 END")
    once = both.groupBy("token", "neighbour", "neighbour_df").agg(F.min_by("mechanism", order).alias("mechanism"))
    best = Window.partitionBy("token").orderBy(F.desc("neighbour_df"), "neighbour")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def stronger_twins(lexicon: DataFrame, strong: int = 10, ratio: float = 4.0) -> DataFrame:
    """Tokens that a form ratio times as frequent could have been read from: the most frequent such form, the first by token of equals."""
    found = confusion_candidates(lexicon, lexicon, strong).join(lexicon, "token").where(F.col("neighbour_df") >= ratio * F.col("document_frequency"))
    best = F.min(F.struct((-F.col("neighbour_df")).alias("m"), "neighbour", "mechanism")).alias("best")
    named = F.when(F.col("best.mechanism") == "diacritics", "diacritics").otherwise("stronger-twin")
    return found.groupBy("token", "document_frequency").agg(best).select("token", "document_frequency", F.col("best.neighbour").alias("twin"), (-F.col("best.m")).alias("twin_df"), named.alias("mechanism"))


def annotated_lines(lines: DataFrame, lexicon: DataFrame, strong: int = 10) -> DataFrame:
    """file, page_num, line_num -> token_status of its words (token:attested, recoverable or unattested), nearest_attested and recoverability."""
    keys = ["file", "page_num", "line_num"]
    words = lines.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{4,})"), 1))).alias("token"))
    near = nearest_attested(lexicon, strong, 1).select("token", "neighbour", "mechanism")
    got = words.join(lexicon, "token", "left").join(near, "token", "left")
    status = F.when(F.coalesce("document_frequency", F.lit(0)) >= strong, "attested").when(F.col("neighbour").isNotNull(), "recoverable").otherwise("unattested")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), " | ")
    return got.withColumn("status", status).groupBy(*keys).agg(
        listed(F.concat_ws(":", "token", "status")).alias("token_status"), listed(F.when(F.col("status") == "recoverable", F.concat("token", F.lit(" -> "), "neighbour", F.lit(" ("), "mechanism", F.lit(")")))).alias("nearest_attested"),
        F.avg((F.col("status") != "unattested").cast("double")).alias("recoverability"),
    )


def recoverability_report(lines: DataFrame, lexicon: DataFrame, strong: int = 10) -> DataFrame:
    """Lines by category and tenth of recoverability; lines without a word of four letters have no opinion."""
    got = lines.join(annotated_lines(lines, lexicon, strong).select("file", "page_num", "line_num", "recoverability"), ["file", "page_num", "line_num"], "left")
    bucket = F.when(F.col("recoverability").isNull(), "no opinion").otherwise(F.format_string("%.1f", F.floor(F.col("recoverability") * 10) / 10))
    return got.groupBy("categ", bucket.alias("bucket")).agg(F.count("*").alias("n"))
