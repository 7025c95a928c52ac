"""Further registered queries: notation, lexicon, metrics, votes, records and listings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import notation as N
from pagewright.functions import witness
from pagewright.operators import lexicon, passes, records, reporting, shaping
from pagewright.sources import tables

from .queries import _GOLD, _JUDGED, _KEY, _LINES, _TOKEN_DF, ORACLES, QUERIES, _gold, judged, lines_of, query, table

__all__ = ["ORACLES", "QUERIES"]


def _duck(pattern: str) -> str:
    return "regexp_matches(t, '" + pattern.replace("'", "''") + "')"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_D = "regexp_matches(t, '[0-9]')"
_N = "len(regexp_extract_all(t, '[0-9]'))"
_CLEAN = f"({_duck(N.REFERENCE)} OR {_duck(N.QUANTITY)})"
_MEASURE = f"(({_duck(N.MEASURED)} AND {_D}) OR (len(regexp_extract_all(replace(t, ' ', '  '), '{N.DESCRIBED}')) >= 2 AND {_D}) OR ({_duck(N.SEPARATED)} AND {_N} >= 2) OR {_duck(N.UNIT)})"
_CATALOGUE = f"({_CLEAN} OR {' OR '.join(_duck(p) for p in (N.SIGLUM, N.PLOT, N.IDENTIFIER, N.TABLE, N.INVENTORY))})"
_DATED = f"(({_duck(N.DATE)} AND {_duck(N.YEAR)}) OR ({_duck(N.DOCUMENT)} AND {_D}))"
_LABEL = f"(lower(rtrim(t, ' :;.-–—')) IN {_listed(N.HEADER_LABELS)})"
_FOLD = "translate(lower({}), '" + N._FOLDED[0] + "', '" + N._FOLDED[1] + "')"
_NOTED = (
    f"(({_duck(N.GRID)} AND {_duck('[A-ZÁČĎÉĚÍŇÓŘŠŤŮÚÝŽ0-9]')}) OR ({_duck(N.LABELLED)} AND {_FOLD.format('trim(string_split(t, chr(58))[1])')} IN (SELECT {_FOLD.format('x')} FROM (SELECT unnest([{', '.join(repr(x) for x in N.NOTATION_LABELS)}]) AS x)))"
    f" OR {' OR '.join(_duck(p) for p in (N.COUNTED, N.ABBREVIATIONS, N.WORD_AND_ABBREVIATIONS, N.ADDRESS))})"
)
_PREDICATES_SQL = {
    "measurement": _MEASURE, "plot_header": _duck(N.PLOT), "catalogue_reference": _CATALOGUE, "dated_reference": _DATED, "structure_label": _LABEL,
    "structured": f"({_CATALOGUE} OR {_MEASURE} OR {_DATED} OR {_duck(N.CONTENTS)} OR {_LABEL})", "notation": _NOTED, "address": _duck(N.ADDRESS), "spaced_metre": _duck(N.SPACED_METRE),
}


@query(
    f"""WITH {_LINES}, s AS (SELECT lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM lines)
  SELECT coalesce(lang, 'none') AS lang, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {test}) AS {name}' for name, test in _PREDICATES_SQL.items())} FROM s GROUP BY ALL"""
)
def structured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each language by kind of structure; no token counts as damaged here."""
    df = lines_of(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("lang"), F.expr(N.squeezed()).alias("t"))
    tests = {name: f("t", "0") if name in ("catalogue_reference", "structured") else f("t") for name, f in N.PREDICATES.items()}
    return df.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(F.expr(test)).alias(name) for name, test in tests.items()])


@query()
def witness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible lines by the clauses that they satisfy; back-references are no SQL of every engine."""
    df = lines_of(spark, sf_dir).withColumn("original_lang", F.lit("ces_Latn"))
    got = witness.line_report(df, eligible_only=True).groupBy(F.array_join("clauses", ",").alias("clauses"))
    return got.agg(F.count("*").alias("lines"), F.count_distinct("text").alias("strings"))


@query(
    f"""WITH {_GOLD}, k AS (SELECT lang, count(*) AS n, avg(CAST(gold = predicted AS DOUBLE)) AS agreement, count(*) FILTER (WHERE gold = 'Clear' AND predicted = 'Trash') AS clear_loss,
    count(*) FILTER (WHERE gold = 'Trash') AS gt, count(*) FILTER (WHERE gold = 'Trash' AND predicted = 'Trash') AS ht, count(*) FILTER (WHERE predicted = 'Trash') AS st,
    count(*) FILTER (WHERE gold = 'Clear') AS gc, count(*) FILTER (WHERE gold = 'Clear' AND predicted = 'Clear') AS hc, count(*) FILTER (WHERE predicted = 'Clear') AS sc,
    avg(CASE WHEN gold = predicted THEN 0.0 WHEN gold = 'Clear' THEN 3.0 ELSE 2.0 END) AS mean_cost FROM g WHERE gold IS NOT NULL GROUP BY lang)
  SELECT lang, n, round(agreement, 9) AS agreement, clear_loss, round(CASE WHEN gt > 0 THEN ht / CAST(gt AS DOUBLE) END, 9) AS trash_recall, round(mean_cost, 9) AS mean_cost,
    round((CASE WHEN gt > 0 THEN 2.0 * ht / (gt + st) ELSE 0 END + CASE WHEN gc > 0 THEN 2.0 * hc / (gc + sc) ELSE 0 END) / ((gt > 0)::INT + (gc > 0)::INT), 9) AS macro_f1 FROM k"""
)
def metrics_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reporting.metrics(_gold(spark, sf_dir), "gold", "predicted", ["lang"])
    return got.withColumns({c: F.round(c, 9) for c in ("agreement", "trash_recall", "mean_cost", "macro_f1")})


@query(f"WITH {_JUDGED} SELECT categ, count(*) AS n FROM judged GROUP BY categ")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.category_counts(judged(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT CASE WHEN quality_score < 0.55 THEN 'Trash' WHEN quality_score < 0.8 THEN 'Noisy' ELSE 'Clear' END AS band, count(*) AS n FROM judged GROUP BY ALL")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(reporting.band_of("quality_score").alias("band")).agg(F.count("*").alias("n"))


_PLACE = "list_position([" + ", ".join(f"'{c}'" for c in C.CATEGORIES) + "], categ)"


@query(
    f"""WITH {_JUDGED}, v AS (SELECT file, text, categ, count(*) AS n FROM judged GROUP BY ALL),
  t AS (SELECT file, text, sum(n) AS lines, count(*) AS kinds, max(n) AS top, arg_min(categ, {{'m': -n, 'p': {_PLACE}}}) AS winner, coalesce(sum(n) FILTER (WHERE categ IN ('Clear', 'Noisy')), 0) AS kept FROM v GROUP BY ALL),
  w AS (SELECT t.*, (SELECT count(*) FROM v WHERE v.file = t.file AND v.text IS NOT DISTINCT FROM t.text AND v.n = t.top) AS tied FROM t)
  SELECT file, text, CAST(lines AS BIGINT) AS lines, CASE WHEN kinds = 1 THEN 'unanimous' WHEN tied > 1 THEN 'tie' WHEN top * 2 > lines THEN 'strict majority' ELSE 'bare plurality' END AS vote, winner,
    CAST(CASE WHEN winner IN ('Clear', 'Noisy') THEN 0 ELSE kept END AS BIGINT) AS destroyed, CAST(CASE WHEN winner IN ('Clear', 'Noisy') THEN lines - kept ELSE 0 END AS BIGINT) AS rescued FROM w"""
)
def text_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.votes(judged(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("destroyed", "rescued")})


@query(
    f"""WITH {_JUDGED} SELECT CAST(least(greatest(word_count, 0), 3) AS INTEGER) AS words, count(*) AS n, count(*) FILTER (WHERE perplex > 850) AS over_cap, count(*) FILTER (WHERE abs(perplex - 850) <= 50) AS near_cap, round(avg(perplex), 7) AS mean_perplex
  FROM judged GROUP BY ALL"""
)
def perplexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.perplexity_report(judged(spark, sf_dir)).withColumn("mean_perplex", F.round("mean_perplex", 7))


_MODAL_SQL = f"""{_JUDGED}, v AS (SELECT file, text, categ, count(*) AS n FROM judged GROUP BY ALL), m AS (SELECT file, text, categ AS modal FROM v QUALIFY row_number() OVER (PARTITION BY file, text ORDER BY n DESC, categ) = 1),
  b AS (SELECT {_KEY}, categ, modal FROM judged JOIN m USING (file, text))"""


@query(f"WITH {_MODAL_SQL} SELECT {_KEY}, categ AS stored, modal AS recomputed FROM b WHERE categ <> modal")
def parity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = judged(spark, sf_dir)
    return reporting.parity_mismatches(lines, passes.modal_dedup(lines), ["file", "page_num", "line_num"])


@query(f"WITH {_MODAL_SQL} SELECT categ AS before, modal AS after, count(*) AS n FROM b GROUP BY ALL")
def category_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = judged(spark, sf_dir)
    return reporting.transitions(lines, passes.modal_dedup(lines), ["file", "page_num", "line_num"])


_FAMILY = r"trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '')"


@query(
    f"""WITH {_JUDGED}, q AS (SELECT text, categ, count(*) AS n, {_FAMILY} AS family FROM judged GROUP BY ALL), s AS (SELECT family, text, sum(n) AS occ FROM q GROUP BY ALL),
  f AS (SELECT family, CAST(sum(occ) AS BIGINT) AS lines_settled, count(*) AS strings, arg_min(text, {{'m': -occ, 't': text}}) AS text FROM s GROUP BY family),
  c AS (SELECT family, categ, sum(n) AS n FROM q GROUP BY ALL), m AS (SELECT family, string_agg(categ || ':' || n, '|' ORDER BY n DESC, categ) AS mix, count(*) AS kinds FROM c GROUP BY family)
  SELECT family, lines_settled, strings, text, mix, CASE WHEN kinds > 1 THEN 'split' WHEN mix LIKE 'Clear%' THEN 'clear' WHEN mix LIKE 'Trash%' THEN 'trash' ELSE 'other' END AS tab, lines_settled >= 20 AS high_leverage FROM f JOIN m USING (family)"""
)
def annotation_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.operators import aggregate

    return reporting.annotation_pack(aggregate.distinct_strings(judged(spark, sf_dir)), 20).drop("variants")


_DECISIONS = f"""{_JUDGED}, v AS (SELECT text, categ, count(*) AS n FROM judged GROUP BY ALL),
  d AS (SELECT text, categ, n, CASE length(text) % 3 WHEN 0 THEN 'Trash' WHEN 1 THEN 'Clear' ELSE '' END AS label, length(text) % 2 = 0 AS fires FROM v)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.operators import aggregate

    queue = aggregate.distinct_strings(judged(spark, sf_dir))
    return queue.withColumns({"label": F.expr("CASE length(text) % 3 WHEN 0 THEN 'Trash' WHEN 1 THEN 'Clear' ELSE '' END"), "fires": F.expr("length(text) % 2 = 0")})


@query(
    f"""WITH {_DECISIONS}, a AS (SELECT 'off' AS arm, label, n, categ AS new FROM d WHERE label <> '' UNION ALL SELECT 'on', label, n, CASE WHEN fires AND categ IN ('Clear', 'Noisy') THEN 'Trash' ELSE categ END FROM d WHERE label <> '')
  SELECT arm, CAST(sum(n) AS DOUBLE) AS lines, CAST(coalesce(sum(n) FILTER (WHERE new <> label), 0) AS DOUBLE) AS errors, CAST(coalesce(sum(n) FILTER (WHERE label = 'Clear' AND new IN ('Trash', 'Non-text')), 0) AS DOUBLE) AS clear_loss,
    CAST(coalesce(sum(n) FILTER (WHERE label = 'Trash' AND new = 'Trash'), 0) AS DOUBLE) AS trash_caught, CAST(coalesce(sum(n) FILTER (WHERE label = 'Trash'), 0) AS DOUBLE) AS gold_trash,
    CAST(coalesce(sum(n) FILTER (WHERE label = 'Noisy' AND new = 'Trash'), 0) AS DOUBLE) AS noisy_to_trash FROM a GROUP BY arm"""
)
def projected_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.project_decisions(_decisions(spark, sf_dir))


@query(
    f"""WITH {_DECISIONS} SELECT count(DISTINCT text) AS rows, CAST(coalesce(sum(n) FILTER (WHERE categ IN ('Clear', 'Noisy')), 0) AS BIGINT) AS kept_lines,
  CAST(coalesce(sum(n) FILTER (WHERE fires AND categ IN ('Clear', 'Noisy')), 0) AS BIGINT) AS witness_convicts FROM d WHERE label = ''"""
)
def blank_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.blank_exposure(_decisions(spark, sf_dir))


@query(
    f"""WITH {_JUDGED}, e AS (SELECT text, min(categ) AS label FROM judged WHERE line_num = 1 GROUP BY text), f AS (SELECT {_FAMILY} AS family, min(label) AS label, count(DISTINCT label) AS k FROM e GROUP BY ALL),
  l AS (SELECT {_KEY}, text, {_FAMILY} AS family, len(regexp_split_to_array(trim(text), '\\s+')) AS words FROM judged)
  SELECT {_KEY}, CASE WHEN e.label IS NOT NULL THEN 'text' WHEN words <= 3 AND f.label IS NOT NULL THEN 'family' END AS matched_by, coalesce(e.label, CASE WHEN words <= 3 THEN f.label END) AS label
  FROM l LEFT JOIN e USING (text) LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (family)"""
)
def labels_onto_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = judged(spark, sf_dir)
    decided = lines.where("line_num = 1").groupBy("text").agg(F.min("categ").alias("label"))
    return reporting.labels_onto_lines(lines, decided).select("file", "page_num", "line_num", "matched_by", "label")


@query("SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rank FROM documents")
def length_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.average_ranks(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ("lang",)).select("doc_id", "lang", "rank")


@query(
    """WITH i AS (SELECT coalesce(lang, 'none') AS backend, coalesce(source, 'none') AS param, count(*) AS importance FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY importance DESC, param) AS r FROM i),
  b AS (SELECT count(DISTINCT backend) AS b FROM i) SELECT param, count(*) FILTER (WHERE r <= 3) AS top_k_appearances, count(*) FILTER (WHERE r <= 3) >= greatest(2, floor(any_value(b) / 2)) AS is_robust,
    round(CASE WHEN count(*) = any_value(b) THEN avg(r) ELSE 999.0 END, 2) AS average_rank FROM r, b GROUP BY param"""
)
def importance_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reporting.consensus(docs.groupBy(F.coalesce("lang", F.lit("none")).alias("backend"), F.coalesce("source", F.lit("none")).alias("param")).agg(F.count("*").alias("importance")), 3)


@query(f"WITH {_LINES}, d AS (SELECT file FROM (SELECT DISTINCT file FROM lines) ORDER BY md5('0|' || file), file LIMIT 20) SELECT {_KEY}, text FROM lines JOIN d USING (file)")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.sample_documents(lines_of(spark, sf_dir), 20).select("file", "page_num", "line_num", "text")


@query(f"WITH {_JUDGED} SELECT categ AS rule, {', '.join(f'count(*) FILTER (WHERE least(greatest(word_count, 1), 5) = {k}) AS {chr(34)}{k}{chr(34)}' for k in range(1, 6))} FROM judged GROUP BY categ")
def categories_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.rules_by_words(judged(spark, sf_dir).withColumn("rule", F.col("categ")))


_PAIRS = ", ".join(f"('{x}', '{y}')" for a, b in lexicon.CONFUSIONS for x, y in ((a, b), (b, a)))
_CONFUSED = f"""{_TOKEN_DF}, strong AS (SELECT token AS neighbour, document_frequency AS neighbour_df, {_FOLD.format('token')} AS folded FROM df WHERE document_frequency >= 10), pairs(a, b) AS (VALUES {_PAIRS}),
  turned AS (SELECT DISTINCT token, substr(token, 1, i - 1) || b || substr(token, i + length(a)) AS neighbour FROM (SELECT token, a, b, unnest(range(1, length(token) + 1)) AS i FROM df JOIN pairs ON contains(token, a)) WHERE substr(token, i, length(a)) = a
    UNION SELECT token, substr(token, 2) FROM df WHERE length(token) > 1 AND substr(token, 1, 1) = substr(token, 2, 1)),
  found AS (SELECT token, neighbour, neighbour_df, 'confusion' AS mechanism FROM turned JOIN strong USING (neighbour) WHERE token <> neighbour
    UNION ALL SELECT token, neighbour, neighbour_df, 'diacritics' FROM df JOIN strong ON folded = token WHERE token <> neighbour),
  candidates AS (SELECT token, neighbour, neighbour_df, max(mechanism) AS mechanism FROM found GROUP BY ALL)"""


@query(f"WITH {_CONFUSED} SELECT * FROM candidates")
def ocr_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lexicon.document_frequency(lines_of(spark, sf_dir))
    return lexicon.confusion_candidates(df, df)


@query(
    f"""WITH {_CONFUSED}, k AS (SELECT DISTINCT token, document_frequency, unnest(list_concat([token], list_transform(range(1, length(token) + 1), lambda i: substr(token, 1, i - 1) || substr(token, i + 1)))) AS key FROM df),
  e AS (SELECT DISTINCT w.token, s.token AS neighbour, s.document_frequency AS neighbour_df, 'edit1' AS mechanism FROM k w JOIN k s USING (key) WHERE w.document_frequency < 10 AND s.document_frequency >= 10),
  u AS (SELECT * FROM e UNION ALL SELECT c.* FROM candidates c JOIN df USING (token) WHERE document_frequency < 10),
  o AS (SELECT token, neighbour, neighbour_df, arg_min(mechanism, CASE mechanism WHEN 'diacritics' THEN 0 WHEN 'confusion' THEN 1 ELSE 2 END) AS mechanism FROM u GROUP BY ALL)
  SELECT *, CAST(row_number() OVER (PARTITION BY token ORDER BY neighbour_df DESC, neighbour) AS INTEGER) AS rank FROM o QUALIFY rank <= 3"""
)
def nearest_attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.nearest_attested(lexicon.document_frequency(lines_of(spark, sf_dir)))


@query(
    f"""WITH {_CONFUSED}, t AS (SELECT c.*, document_frequency FROM candidates c JOIN df USING (token) WHERE neighbour_df >= 4 * document_frequency)
  SELECT token, document_frequency, neighbour AS twin, neighbour_df AS twin_df, CASE mechanism WHEN 'diacritics' THEN 'diacritics' ELSE 'stronger-twin' END AS mechanism FROM t QUALIFY row_number() OVER (PARTITION BY token ORDER BY neighbour_df DESC, neighbour) = 1"""
)
def stronger_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.stronger_twins(lexicon.document_frequency(lines_of(spark, sf_dir)))


@query(
    f"""WITH {_TOKEN_DF}, w AS (SELECT DISTINCT {_KEY}, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS token FROM lines)
  SELECT {_KEY}, CAST(count(*) AS INTEGER) AS unattested FROM w JOIN df USING (token) WHERE document_frequency < 3 GROUP BY ALL"""
)
def unattested_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(spark, sf_dir)
    return witness.unattested(lines, lexicon.document_frequency(lines)).withColumn("unattested", F.size("unattested"))


@query(
    f"""WITH {_JUDGED}, n AS (SELECT file, page_num, count(*) AS num_lines, round(avg(quality_score) FILTER (WHERE categ <> 'Empty'), 9) AS quality_score, count(*) FILTER (WHERE categ = 'Clear') AS c, count(*) FILTER (WHERE categ = 'Noisy') AS o, count(*) FILTER (WHERE categ = 'Trash') AS t FROM judged GROUP BY ALL)
  SELECT file, page_num, num_lines, quality_score, CASE WHEN c + o + t = 0 THEN NULL WHEN c >= o AND c >= t THEN 'Clear' WHEN o >= t THEN 'Noisy' ELSE 'Trash' END AS quality_band FROM n"""
)
def page_records_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page_records(judged(spark, sf_dir), 9)


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN lang END, l.language) AS language FROM documents d FULL JOIN (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS language FROM labels) l USING (doc_id)"""
)
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 3 <> 0 THEN lang END").alias("language"))
    incoming = table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE quality WHEN 1 THEN 'good' ELSE 'bad' END").alias("language"))
    return records.set_source(stored, incoming, ["doc_id"])[0]


@query(
    """SELECT source AS doc_id, CASE WHEN source = 'web' THEN 'vlm:given' WHEN count(*) FILTER (WHERE layer IN ('ocr', 'digital')) > 0 AND count(*) FILTER (WHERE layer = 'ocr') * 2 >= count(*) FILTER (WHERE layer IN ('ocr', 'digital')) THEN 'ocr:pdf-text-layer' ELSE 'digital-born-pdf' END AS origin
  FROM (SELECT coalesce(source, 'none') AS source, CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'digital' ELSE 'none' END AS layer FROM documents) GROUP BY source"""
)
def default_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.coalesce("source", F.lit("none"))
    layer = F.expr("CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'digital' ELSE 'none' END")
    pages = table(spark, sf_dir, "documents").select(source.alias("doc_id"), F.lit("pdf").alias("kind"), F.when(source == "web", "vlm:given").alias("origin_hint"), layer.alias("text_layer"))
    return records.default_origin(pages)


@query("SELECT doc_id, CAST((n_chars > 1000)::INT + (n_chars > 5000)::INT AS INTEGER) AS notes FROM documents")
def limit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records.with_limit_note(table(spark, sf_dir, "documents"), "line", 1000, "n_chars")
    return records.with_limit_note(df, "page", 5000, "n_chars").select("doc_id", F.size("notes").alias("notes"))


_IDS = "CASE doc_id % 5 WHEN 0 THEN '..' WHEN 1 THEN concat('a/', doc_id) WHEN 2 THEN repeat('x', 201) WHEN 3 THEN '' ELSE concat('d', doc_id) END"


@query(f"SELECT doc_id, CASE WHEN f IN ('', '.', '..') THEN 'empty document id' WHEN contains(f, '/') THEN 'path separator in the document id' WHEN length(f) > 200 THEN 'document id longer than 200 bytes' END AS problem FROM (SELECT doc_id, {_IDS} AS f FROM documents)")
def document_id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_IDS).alias("file")).select("doc_id", F.expr(tables.id_problem()).alias("problem"))


@query("SELECT f AS file, p AS path FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS f, printf('%012d', doc_id) AS p FROM documents WHERE source IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lower(f) ORDER BY p) > 1")
def colliding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.expr("CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END").alias("file"), F.format_string("%012d", "doc_id").alias("path"))
    return tables.colliding_ids(files)


@query(f"WITH {_LINES} SELECT file, string_agg(page_num, ',' ORDER BY page_num) AS pages FROM (SELECT DISTINCT file, page_num FROM lines) GROUP BY file")
def pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grouped_pages(lines_of(spark, sf_dir), "page_num").withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(f"WITH {_LINES} SELECT DISTINCT file, page_num FROM lines WHERE file NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def outputs_outside_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"))
    return tables.outside_index(tables.distinct_pages(lines_of(spark, sf_dir)), index)


@query()
def shaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines normalised and wrapped at 200 characters; Unicode composition is no SQL."""
    return shaping.shape_lines(lines_of(spark, sf_dir), 200).select("file", "page_num", "line_num", "text")
