"""Registered queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import signals as S
from pagewright.functions import text as T
from pagewright.operators import aggregate, evaluate, lexicon, modelling, passes, records, sampling, scoring, shaping
from pagewright.operators.lines import explode_lines, remap_language, with_model_columns
from pagewright.sources.readers import html_pages, json_leaves
from pagewright.streaming.ingest import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(docs: DataFrame) -> DataFrame:
    """A file that can't be split would be read, and all that follows done, by one core; larger tables are left as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(remap_language(with_model_columns(lines_of(spark, sf_dir))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with stand-in scores and categories by the md5 of their place, so that SQL can follow the passes."""
    share = lambda at: F.conv(F.substring(F.md5(F.concat_ws("/", "file", F.col("page_num").cast("string"), F.col("line_num").cast("string"))), at, 6), 16, 10).cast("double") / 16777216
    df = lines_of(spark, sf_dir).withColumns(
        {
            "quality_score": F.round(share(1), 4), "lang_score": share(7), "perplex": 2000 * share(13) * share(13), "word_weird": F.greatest(share(19) - 0.5, F.lit(0.0)),
            "rot_ratio": F.expr(S.ratio_of(S.ROTATABLE, "text")), "has_diacritics": F.expr(f"text rlike {T.char_class(C.CZECH_DIACRITICS)}"),
            "original_lang": F.expr("CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE 'spa_Latn' END"),
            "word_count": F.size(F.expr(T.tokens("text"))), "char_count": F.length("text"), "vowel_ratio": F.expr(S.ratio_of(S.VOWEL, "text")), "caps_header": F.expr("text = upper(text)"),
        }
    )
    return df.withColumn("categ", F.expr("CASE WHEN trim(text) = '' THEN 'Empty' WHEN quality_score < 0.55 THEN 'Trash' WHEN quality_score < 0.8 THEN 'Noisy' ELSE 'Clear' END"))


_LINES = """
lines AS (
  SELECT file, CAST(floor((pos - 1) / 40) + 1 AS INTEGER) AS page_num, CAST((pos - 1) % 40 + 1 AS INTEGER) AS line_num, text, lang
  FROM (SELECT CAST(doc_id AS VARCHAR) AS file, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
)"""


def _chars(keep: str, t: str = "text") -> str:
    return f"length(regexp_replace({t}, '{keep}', '', 'g'))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / CAST({b} AS DOUBLE) END"


_VOWEL_SQL = _ratio(_chars(f"[^{C.VOWELS}]"), _chars(r"[\p{N}\s]"))
_ROT_SQL = _ratio(_chars(f"[^{C.ROTATABLE}]", "lower(text)"), _chars(r"[^\p{L}]"))
_GARBAGE_SQL = _ratio(_chars(r"[\p{L}\p{N} ]"), "length(text)")
_SHARE = "(CAST('0x' || substr(md5(file || '/' || page_num || '/' || line_num), {}, 6) AS INTEGER) / 16777216.0)"
_TOKENS = r"list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(13)), '\s+'), lambda t: t <> '')"
_JUDGED = f"""{_LINES},
judged AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 'Empty' WHEN quality_score < 0.55 THEN 'Trash' WHEN quality_score < 0.8 THEN 'Noisy' ELSE 'Clear' END AS categ FROM (
    SELECT *, round({_SHARE.format(1)}, 4) AS quality_score, {_SHARE.format(7)} AS lang_score, 2000 * {_SHARE.format(13)} * {_SHARE.format(13)} AS perplex,
      greatest({_SHARE.format(19)} - 0.5, 0.0) AS word_weird, {_ROT_SQL} AS rot_ratio, regexp_matches(text, '[{C.CZECH_DIACRITICS}]') AS has_diacritics,
      CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' ELSE 'spa_Latn' END AS original_lang,
      CAST(len({_TOKENS}) AS INTEGER) AS word_count, CAST(length(text) AS INTEGER) AS char_count, {_VOWEL_SQL} AS vowel_ratio, text = upper(text) AS caps_header
    FROM lines))"""
_KEY = "file, page_num, line_num"


@query(f"WITH {_LINES} SELECT {_KEY}, text FROM lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("file", "page_num", "line_num", "text")


@query(
    f"WITH {_LINES} SELECT {_KEY}, {_GARBAGE_SQL} AS garbage_density, {_VOWEL_SQL} AS vowel_ratio, {_ROT_SQL} AS rot_ratio,"
    f" {_ratio(_chars(r'[\p{L}\p{N}\s]'), 'length(text)')} AS symbol_ratio, {_ratio(_chars(r'[^\p{Nd}]'), 'length(text)')} AS digit_ratio FROM lines"
)
def line_basic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"garbage_density": S.GARBAGE, "vowel_ratio": S.VOWEL, "rot_ratio": S.ROTATABLE, "symbol_ratio": S.SYMBOL, "digit_ratio": S.DIGIT}
    return lines_of(spark, sf_dir).select("file", "page_num", "line_num", *[F.expr(S.ratio_of(t, "text")).alias(n) for n, t in of.items()])


_CORE = r"trim(t, '.,;:!?()[]\"''/\')"
_PARTS = f"list_transform(list_filter(regexp_split_to_array(t, '[.\\-–]'), lambda p: p <> ''), lambda p: {_CORE.replace('(t,', '(p,')})"
_N = lambda c: f"length(regexp_replace(p, '[^{c}]', '', 'g'))"


@query(
    f"""WITH {_LINES} SELECT {_KEY}, CAST(len(w) AS INTEGER) AS word_count,
  CAST(len(list_filter(w, lambda t: len(list_filter({_PARTS}, lambda p: {_N('wW')} >= 2 OR {_N('xX')} >= 2)) > 0)) AS INTEGER) AS weird_wx,
  CAST(len(list_filter(w, lambda t: len(list_filter({_PARTS}, lambda p: regexp_matches(p, '\\p{{L}}') AND (length(p) > 14 OR regexp_matches(lower(p), '[bcčdfghjklmnpqrřsštvwxzž]{{5,}}') OR regexp_matches(lower(p), '[aeiouyáéíóúýěůäöü]{{3,}}')))) > 0)) AS INTEGER) AS fused_words
  FROM (SELECT *, {_TOKENS} AS w FROM lines)"""
)
def line_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.functions.words import words_of

    w = lines_of(spark, sf_dir).withColumn("w", words_of("text"))
    return w.select("file", "page_num", "line_num", "w.word_count", "w.weird_wx", "w.fused_words")


_LANG_SQL = "CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'es' THEN 'spa_Latn' ELSE 'und' END"
_TSHARE = "(CAST('0x' || substr(md5(text), {}, 6) AS INTEGER) / 16777216.0)"


@query(
    f"""WITH {_LINES}, m AS (SELECT *, {_LANG_SQL} AS original_lang, 0.3 + 0.7 * {_TSHARE.format(1)} AS s FROM lines)
  SELECT {_KEY}, CASE WHEN lang = 'es' THEN 'ces_Latn' ELSE original_lang END AS lang, CASE WHEN lang = 'es' THEN 0.75 ELSE s END AS lang_score,
  s * CASE WHEN lang IN ('de', 'en') THEN 1.0 WHEN lang = 'fr' THEN 0.85 ELSE 0.5 END AS trust FROM m"""
)
def lang_remap_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remap_language(with_model_columns(lines_of(spark, sf_dir)))
    return df.select("file", "page_num", "line_num", "lang", "lang_score", F.expr(S.trust()).alias("trust"))


@query()
def category_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("file", "page_num", "line_num", "categ", "rule", F.round("quality_score", 4).alias("quality_score"))


@query()
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: lines, signals, cascade, document passes, page statistics with bands."""
    return aggregate.with_band(aggregate.page_stats(passes.document_passes(classified(spark, sf_dir))))


@query()
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rule_coverage(classified(spark, sf_dir))


@query()
def perplexity_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.blended_perplexity(classified(spark, sf_dir)).where("perplex_blend IS NOT NULL").select("file", "page_num", "line_num", "perplex_raw", "perplex_blend")


@query(
    f"""WITH {_JUDGED}, v AS (SELECT file, text, categ, count(*) AS n FROM judged GROUP BY ALL),
  m AS (SELECT file, text, categ AS modal FROM v QUALIFY row_number() OVER (PARTITION BY file, text ORDER BY n DESC, categ) = 1)
  SELECT {_KEY}, modal AS categ, modal <> categ AS pp_dedup FROM judged JOIN m USING (file, text)"""
)
def modal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.modal_dedup(judged(spark, sf_dir)).select("file", "page_num", "line_num", "categ", "pp_dedup")


@query(
    f"""WITH {_JUDGED}, n AS (SELECT *, lag(categ) OVER w AS a, lag(categ, 2) OVER w AS b, lead(categ) OVER w AS c, lead(categ, 2) OVER w AS d, count(*) OVER (PARTITION BY file) AS k
    FROM judged WINDOW w AS (PARTITION BY file ORDER BY page_num, line_num)),
  h AS (SELECT *, coalesce(categ = 'Noisy' AND quality_score < 0.70 AND a = 'Trash' AND b = 'Trash' AND c = 'Trash' AND d = 'Trash' AND k >= 5, false) AS hit FROM n)
  SELECT {_KEY}, CASE WHEN hit THEN 'Trash' ELSE categ END AS categ, hit AS pp_surrounded_trash FROM h"""
)
def surrounded_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.surrounded_trash(judged(spark, sf_dir)).select("file", "page_num", "line_num", "categ", "pp_surrounded_trash")


@query(
    f"""WITH {_JUDGED}, s AS (SELECT *, categ <> 'Empty' AS ok, original_lang <> 'spa_Latn' AS known FROM judged),
  p AS (SELECT file, page_num, avg(CAST(categ = 'Clear' AS INTEGER)) AS c, avg(CAST(known AS INTEGER)) AS k, median(quality_score) AS m FROM s WHERE ok GROUP BY ALL)
  SELECT {_KEY}, CASE WHEN NOT ok THEN categ WHEN c <= 0.05 AND k < 0.5 AND m < 0.55 THEN CASE WHEN categ = 'Noisy' AND quality_score < 0.8 THEN 'Trash' ELSE categ END
    WHEN c > 0.6 AND m > 0.8 AND categ = 'Trash' AND known AND quality_score >= 0.45 THEN 'Noisy' ELSE categ END AS categ FROM s LEFT JOIN p USING (file, page_num)"""
)
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.page_context(judged(spark, sf_dir)).select("file", "page_num", "line_num", "categ")


@query(
    f"""WITH {_JUDGED}, s AS (SELECT *, categ <> 'Empty' AS ok, (NOT has_diacritics AND lang_score < 0.45) OR (perplex >= 200 AND word_weird > 0 AND lang_score < 0.9)
      OR (NOT has_diacritics AND rot_ratio >= 0.55 AND perplex >= 200 AND lang_score < 0.9) AS sus FROM judged),
  o AS (SELECT *, avg(CAST(sus AS INTEGER)) OVER (PARTITION BY file, page_num) AS share,
    row_number() OVER (PARTITION BY file, page_num ORDER BY line_num) - row_number() OVER (PARTITION BY file, page_num, sus ORDER BY line_num) AS island FROM s WHERE ok),
  r AS (SELECT *, count(*) OVER (PARTITION BY file, page_num, sus, island) AS run FROM o)
  SELECT {_KEY}, CASE WHEN sus AND (share >= 0.6 OR run >= 4) THEN 'Trash' ELSE categ END AS categ FROM r UNION ALL SELECT {_KEY}, categ FROM s WHERE NOT ok"""
)
def inverted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.inverted_runs(judged(spark, sf_dir)).select("file", "page_num", "line_num", "categ")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE categ = '{c}') AS \"{c}\"" for c in C.CATEGORIES)
_V = "FILTER (WHERE categ IN ('Clear', 'Noisy'))"
_STATS = f"""SELECT file, page_num, count(*) AS num_lines, {_COUNTS}, CAST(coalesce(sum(word_count) {_V}, 0) AS BIGINT) AS total_word_count, CAST(coalesce(sum(char_count) {_V}, 0) AS BIGINT) AS total_char_count,
  avg(quality_score) {_V} AS avg_quality_score, avg(word_weird) {_V} AS avg_word_weird, avg(lang_score) {_V} AS avg_lang_score, avg(perplex) {_V} AS avg_perplex, avg(vowel_ratio) {_V} AS avg_vowel_ratio,
  avg(rot_ratio) {_V} AS avg_rot_ratio, avg(CAST(caps_header AS DOUBLE)) {_V} AS ch_ratio, min(lang) {_V} AS main_lang FROM judged GROUP BY file, page_num"""
_BANDED = f"WITH {_JUDGED}, s AS ({_STATS}) SELECT *, CASE WHEN Clear >= Noisy AND Clear >= Trash THEN 'Clear' WHEN Noisy >= Trash THEN 'Noisy' ELSE 'Trash' END AS quality_band FROM s"
_ROUNDED = ("avg_quality_score", "avg_word_weird", "avg_lang_score", "avg_perplex", "avg_vowel_ratio", "avg_rot_ratio", "ch_ratio")


@query(f"SELECT * REPLACE ({', '.join(f'round({c}, 10) AS {c}' for c in _ROUNDED)}) FROM ({_BANDED})")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = aggregate.with_band(aggregate.page_stats(judged(spark, sf_dir)))
    return stats.withColumns({c: F.round(c, 10) for c in _ROUNDED})


@query(f"WITH {_JUDGED} SELECT file, page_num, {_COUNTS} FROM judged GROUP BY file, page_num")
def page_stats_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.page_stats_pivot(judged(spark, sf_dir))


@query(
    f"""WITH {_JUDGED}, v AS (SELECT text, categ, count(*) AS n, min({{'f': CAST(file AS BIGINT), 'p': page_num, 'l': line_num}}) AS first FROM judged GROUP BY ALL)
  SELECT text, CAST(sum(n) AS BIGINT) AS occurrences, string_agg(categ || ':' || n, '|' ORDER BY n DESC, categ) AS mix, CAST(min(first).f AS VARCHAR) AS example_file, min(first).p AS example_page, min(first).l AS example_line FROM v GROUP BY text"""
)
def distinct_string_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.distinct_strings(judged(spark, sf_dir))


@query(
    f"""WITH {_LINES}, r AS (SELECT text, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, text) AS k FROM lines GROUP BY text)
  SELECT top, CAST(sum(n) AS BIGINT) AS lines_settled FROM r JOIN (SELECT CAST(unnest([1, 20, 100, 500]) AS INTEGER) AS top) ON k <= top GROUP BY top"""
)
def top_k_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.coverage(lines_of(spark, sf_dir).groupBy("text").agg(F.count("*").alias("occurrences")))


_TOKEN_DF = f"""{_LINES}, df AS (SELECT token, count(*) AS document_frequency FROM (SELECT DISTINCT file, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS token FROM lines) GROUP BY token)"""


@query(f"WITH {_TOKEN_DF} SELECT * FROM df")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.document_frequency(lines_of(spark, sf_dir))


@query(
    f"""WITH {_TOKEN_DF} SELECT count(*) AS tokens, count(*) FILTER (WHERE document_frequency >= 3) AS attested, count(*) FILTER (WHERE document_frequency >= 3) / CAST(count(*) AS DOUBLE) AS attested_share,
  count(*) FILTER (WHERE document_frequency = 1) AS hapax, count(*) FILTER (WHERE document_frequency = 1) / CAST(count(*) AS DOUBLE) AS hapax_share FROM df"""
)
def token_df_hapax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.diagnostics(lexicon.document_frequency(lines_of(spark, sf_dir)))


_NEIGHBOURS = f"""{_TOKEN_DF}, k AS (SELECT DISTINCT token, document_frequency, unnest(list_concat([token], list_transform(range(1, length(token) + 1), lambda i: substr(token, 1, i - 1) || substr(token, i + 1)))) AS key FROM df),
  c AS (SELECT DISTINCT w.token, s.token AS neighbour, s.document_frequency AS neighbour_df FROM k w JOIN k s USING (key) WHERE w.document_frequency < 10 AND s.document_frequency >= 10),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY token ORDER BY neighbour_df DESC, neighbour) AS INTEGER) AS rank FROM c QUALIFY rank <= 3)"""


@query(f"WITH {_NEIGHBOURS} SELECT * FROM n")
def ocr_neighbours_delete1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.neighbours(lexicon.document_frequency(lines_of(spark, sf_dir)))


@query(
    f"""WITH {_NEIGHBOURS}, w AS (SELECT DISTINCT file, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS token FROM lines), g AS (
    SELECT file, document_frequency >= 10 AS a, token IN (SELECT token FROM n) AS r FROM w JOIN df USING (token))
  SELECT file, count(*) AS queryable, count(*) FILTER (WHERE a) AS attested, count(*) FILTER (WHERE r) AS recoverable, round(avg(CAST(a OR r AS DOUBLE)), 9) AS recoverability FROM g GROUP BY file"""
)
def recoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return lexicon.recoverability(lines, lexicon.document_frequency(lines)).withColumn("recoverability", F.round("recoverability", 9))


_GOLD = f"""{_JUDGED}, d AS (SELECT CAST(file AS BIGINT) AS doc_id, lang, CASE WHEN avg(quality_score) FILTER (WHERE categ <> 'Empty') < 0.5 THEN 'Trash' ELSE 'Clear' END AS predicted FROM judged GROUP BY ALL),
  g AS (SELECT d.*, CASE WHEN l.quality = 1 THEN 'Clear' WHEN l.quality = 0 THEN 'Trash' END AS gold FROM d LEFT JOIN labels l USING (doc_id))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judged(spark, sf_dir).groupBy(F.col("file").cast("long").alias("doc_id"), "lang").agg(F.avg(F.when(F.col("categ") != "Empty", F.col("quality_score"))).alias("q"))
    docs = docs.select("doc_id", "lang", F.when(F.col("q") < 0.5, "Trash").otherwise("Clear").alias("predicted"))
    return evaluate.attach_gold(docs, table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE quality WHEN 1 THEN 'Clear' WHEN 0 THEN 'Trash' END").alias("gold")), ["doc_id"], "gold")


@query(f"WITH {_GOLD} SELECT doc_id, lang, predicted, gold FROM g")
def gold_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def gold_unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unmatched_gold(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "quality")


_LABELS = "(SELECT unnest(['Clear', 'Empty', 'Noisy', 'Non-text', 'Trash']) AS c)"
_MATRIX = f"""{_GOLD}, m AS (SELECT a.c AS gold, b.c AS predicted, CAST((SELECT count(*) FROM g WHERE g.gold = a.c AND g.predicted = b.c) AS DOUBLE) AS n FROM {_LABELS} a, {_LABELS} b),
  f AS (SELECT label, support, CASE WHEN answers = 0 THEN 0.0 ELSE hits / answers END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS recall,
    CASE WHEN support + answers = 0 THEN 0.0 ELSE 2 * hits / (support + answers) END AS f1
    FROM (SELECT gold AS label, sum(n) AS support, sum(n) FILTER (WHERE gold = predicted) AS hits FROM m GROUP BY gold) JOIN (SELECT predicted AS label, sum(n) AS answers FROM m GROUP BY predicted) USING (label))"""


@query(f"WITH {_MATRIX} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_gold(spark, sf_dir).where("gold IS NOT NULL"), "gold", "predicted")


@query(f"WITH {_MATRIX} SELECT * FROM f")
def f1_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.f1_scores(confusion_matrix(spark, sf_dir))


@query(f"WITH {_MATRIX} SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, count(*) AS labels FROM f WHERE support > 0")
def f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(f1_by_label(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("macro_f1", "weighted_f1")})


@query(
    f"""WITH {_GOLD}, p AS (SELECT c, count(gold) AS n FROM {_LABELS} LEFT JOIN g ON gold = c GROUP BY c), q AS (SELECT c, count(predicted) AS n FROM {_LABELS} LEFT JOIN (SELECT * FROM g WHERE gold IS NOT NULL) ON predicted = c GROUP BY c),
  s AS (SELECT p.n / sum(p.n) OVER () AS a, q.n / sum(q.n) OVER () AS b FROM p JOIN q USING (c)) SELECT round(sum((a + 1e-12) * ln((a + 1e-12) / (b + 1e-12))), 9) AS kl_divergence FROM s"""
)
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kl_divergence(_gold(spark, sf_dir).where("gold IS NOT NULL"), "gold", "predicted").withColumn("kl_divergence", F.round("kl_divergence", 9))


@query(f"WITH {_GOLD} SELECT count(*) FILTER (WHERE gold <> predicted) AS flips, round(avg(CASE WHEN gold = predicted THEN 0.0 WHEN gold = 'Clear' THEN 3.0 ELSE 2.0 END), 9) AS mean_cost FROM g WHERE gold IS NOT NULL")
def costed_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.costed_flips(_gold(spark, sf_dir).where("gold IS NOT NULL"), "gold", "predicted").withColumn("mean_cost", F.round("mean_cost", 9))


@query(
    f"""WITH {_GOLD}, s AS (SELECT lang, CAST(doc_id % 10 AS VARCHAR) AS decade, CAST(gold = predicted AS INTEGER) AS ok FROM g WHERE gold IS NOT NULL)
  SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'decade' END AS stratum, coalesce(lang, decade) AS value, count(*) AS n, CAST(sum(ok) AS BIGINT) AS agree, round(avg(ok), 9) AS share FROM s GROUP BY GROUPING SETS ((lang), (decade))"""
)
def strata_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _gold(spark, sf_dir).where("gold IS NOT NULL").withColumn("decade", F.col("doc_id") % 10)
    return evaluate.strata(df, "gold", "predicted", "lang", "decade").withColumn("share", F.round("share", 9))


@query(f"WITH {_LINES} SELECT {_KEY}, text FROM lines QUALIFY row_number() OVER (PARTITION BY file ORDER BY page_num, line_num) <= 5")
def per_doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_document_cap(lines_of(spark, sf_dir), 5).select("file", "page_num", "line_num", "text")


@query(
    """WITH z AS (SELECT source, count(*) AS size FROM documents GROUP BY source), e AS (SELECT *, 100 * size / CAST(sum(size) OVER () AS DOUBLE) AS exact FROM z),
  q AS (SELECT source, size, least(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, source) <= 100 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END, size) AS quota FROM e)
  SELECT doc_id, source, round(size / quota, 9) AS weight FROM documents JOIN q USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) <= any_value(quota) OVER (PARTITION BY source)"""
)
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.stratified(docs, "source", "doc_id", 100).select("doc_id", "source", F.round("weight", 9).alias("weight"))


@query(r"SELECT doc_id, lang FROM (SELECT *, regexp_replace(trim(text), '\s+', ' ', 'g') AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("k", F.regexp_replace(F.trim("text"), r"\s+", " "))
    return sampling.keep_first(docs, ["k"], ["doc_id"]).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('0|' || doc_id), 1, 8) AS BIGINT) % 100 AS b FROM documents)")
def train_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(r"SELECT CAST(doc_id AS VARCHAR) AS file, trim(regexp_replace(text, '[-­–—][ \t]*\n[ \t]*', '', 'g')) || chr(10) AS text FROM documents")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.expr(shaping.dehyphenated()).alias("text"))


@query(
    f"""WITH {_LINES}, k AS (SELECT file, page_num, line_num, trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '') AS family FROM lines)
  SELECT family, count(*) AS lines, count(DISTINCT file) AS documents FROM k GROUP BY family"""
)
def line_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).groupBy(F.expr(shaping.family_key()).alias("family")).agg(F.count("*").alias("lines"), F.count_distinct("file").alias("documents"))


@query()
def html_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are whole: Arrow would hold 10,000 of them at once on both sides, pickled rows go a hundred at a time
    @F.udf("array<string>", useArrow=False)
    def visible(html: str) -> list[str]:
        return [x for _, lines in html_pages(html or "") for x in lines]

    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.posexplode(visible("html")).alias("pos", "text"))
    return pages.select("page_id", (F.col("pos") + 1).alias("line_num"), "text")


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS leaves FROM conversations WHERE text IS NOT NULL")
def jsonl_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    @F.udf("array<string>", useArrow=True)
    def leaves(record: str) -> list[str]:
        return json_leaves(json.loads(record))

    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    return turns.select("conv_id", "turn", F.size(leaves("record")).alias("leaves"))


@query(
    """SELECT coalesce(c.doc_id, l.doc_id) AS doc_id, c.lang, coalesce(l.quality, 0) AS quality FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) c FULL JOIN labels l USING (doc_id)"""
)
def record_merge_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", "lang", F.lit(0).alias("quality"))
    return records.merge_block(stored, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("SELECT coalesce(c.doc_id, l.doc_id) AS doc_id, c.lang, coalesce(l.quality, 0) AS quality FROM documents c FULL JOIN labels l USING (doc_id)")
def record_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(0).alias("quality"))
    return records.merge_block(stored, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


_LICENCES = ", ".join(f"('{name}', {rank})" for rank, name in enumerate(records.LICENSE_RANK))


@query(
    f"""WITH r AS (SELECT * FROM (VALUES {_LICENCES}) t(name, rank)), c AS (SELECT doc_id % 50 AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'CC-BY-NC-4.0' ELSE source END AS name FROM documents),
  k AS (SELECT doc_id, name, coalesce(rank, {len(records.LICENSE_RANK)}) AS rank FROM c LEFT JOIN r USING (name))
  SELECT doc_id, CAST(max(rank) AS INTEGER) AS rank, arg_min(name, {{'r': -rank, 'n': name}}) AS effective_license, count(DISTINCT name) AS components FROM k GROUP BY doc_id"""
)
def license_max_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'mit license' WHEN 1 THEN 'Apache 2.0' WHEN 2 THEN 'CC BY-NC 4.0' ELSE source END").alias("license")
    return records.effective_license(table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("doc_id"), name))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "SELECT n_name AS nation, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    got = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    got = got.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows whatever the scale
    return got.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    f"""WITH {_LINES}, c AS (SELECT *, concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w, '>>' || text || '<<', lead(text) OVER w, lead(text, 2) OVER w) AS context FROM lines WINDOW w AS (PARTITION BY file, page_num ORDER BY line_num))
  SELECT {_KEY}, context FROM c WHERE line_num = 3"""
)
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.context(lines_of(spark, sf_dir), "line_num = 3").select("file", "page_num", "line_num", "context")


@query(
    f"""WITH {_LINES} SELECT {_KEY}, concat_ws(chr(10), lag(text, 2) OVER w, lag(text) OVER w, '>>' || text || '<<', lead(text) OVER w, lead(text, 2) OVER w) AS context
  FROM lines WINDOW w AS (PARTITION BY file, page_num ORDER BY line_num)"""
)
def line_context_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.context(lines_of(spark, sf_dir)).select("file", "page_num", "line_num", "context")


@query(f"WITH {_JUDGED} SELECT CAST(least(floor(quality_score * 10), 9) AS INTEGER) AS bin, categ, count(*) AS n, round(avg(quality_score), 9) AS mean_score FROM judged GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.score_histogram(judged(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 9))


@query(
    f"""WITH {_JUDGED}, n AS (SELECT file, page_num, categ, quality_score, CAST(least(floor(lang_score * 10), 9) AS INTEGER) AS bin, lang_score FROM judged)
  SELECT bin, count(*) AS n, round(avg(lang_score), 9) AS mean_predicted, round(avg(quality_score), 9) AS mean_true FROM n GROUP BY bin"""
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.calibration(judged(spark, sf_dir), "quality_score", "lang_score")
    return got.where("n > 0").withColumns({c: F.round(c, 9) for c in ("mean_predicted", "mean_true")})


@query(f"WITH {_JUDGED} SELECT count(*) FILTER (WHERE quality_score >= 0.5 AND lang_score < 0.5) AS fixes, count(*) FILTER (WHERE quality_score < 0.5 AND lang_score >= 0.5) AS breaks, count(*) FILTER (WHERE quality_score >= 0.5 AND lang_score >= 0.5) AS both FROM judged".replace(" AS both", ' AS "both"'))
def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judged(spark, sf_dir).select(F.lit(True).alias("g"), (F.col("quality_score") >= 0.5).alias("a"), (F.col("lang_score") >= 0.5).alias("b"))
    return evaluate.paired_counts(df, "g", "a", "b")


@query()
def corrupted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.dataset(lines_of(spark, sf_dir))
