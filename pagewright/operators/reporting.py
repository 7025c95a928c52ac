"""Reports on classified lines: metrics by group, re-scoring, ablation, votes, packs and projections.

Everything is an aggregate or a join; a sweep over settings is a union of plans
over the same signals.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import config as C

from .sampling import hash_order
from .scoring import RULES, decide
from .shaping import family_key

FAST_TRACK = (C.EMPTY, C.NON_TEXT)
#: Weights of the quality score by the name of their setting.
WEIGHTS = ("w_valid", "w_weird", "w_garbage", "w_perplexity", "w_vowel", "w_lang", "w_gibberish", "w_fused", "w_length")


def normalised_category(column: str) -> Column:
    """The usual spelling of a category; other labels are trimmed, a missing one is ''."""
    label = f"trim(coalesce({column}, ''))"
    usual = "map('empty', 'Empty', 'non-text', 'Non-text', 'nontext', 'Non-text', 'trash', 'Trash', 'noisy', 'Noisy', 'clear', 'Clear')"
    return F.expr(f"coalesce(try_element_at({usual}, replace(lower({label}), '_', '-')), {label})")


def band_of(score: str, cfg: C.EngineConfig = C.DEFAULT) -> Column:
    return F.expr(f"CASE WHEN {score} < {cfg.trash_max}D THEN 'Trash' WHEN {score} < {cfg.noisy_max}D THEN 'Noisy' ELSE 'Clear' END")


def annotated(df: DataFrame, gold: str) -> DataFrame:
    """Rows with a gold label; a table without that column is an error, not an unlabelled one."""
    if gold not in df.columns:
        raise ValueError(f"no column {gold!r} among {', '.join(sorted(df.columns))}")
    return df.where(F.trim(F.coalesce(F.col(gold).cast("string"), F.lit(""))) != "")


def category_counts(df: DataFrame, column: str = "categ") -> DataFrame:
    return df.groupBy(F.col(column).alias("categ")).agg(F.count("*").alias("n"))


def _measures(gold: str, predicted: str) -> list[Column]:
    hits = {c: F.count_if((F.col(gold) == c) & (F.col(predicted) == c)) for c in C.CATEGORIES}
    held = {c: F.count_if(F.col(gold) == c) for c in C.CATEGORIES}
    said = {c: F.count_if(F.col(predicted) == c) for c in C.CATEGORIES}
    cost = F.when(F.col(gold) == F.col(predicted), 0.0)
    for (a, b), price in C.FLIP_COSTS.items():
        cost = cost.when((F.col(gold) == a) & (F.col(predicted) == b), price)
    f1 = [F.when(held[c] > 0, 2.0 * hits[c] / (held[c] + said[c])) for c in C.CATEGORIES]
    present = sum(((held[c] > 0).cast("int") for c in C.CATEGORIES), F.lit(0))
    return [
        F.count("*").alias("n"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("agreement"), (sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / present).alias("macro_f1"),
        F.count_if((F.col(gold) == C.CLEAR) & F.col(predicted).isin(C.TRASH, C.NON_TEXT)).alias("clear_loss"),
        F.when(held[C.TRASH] > 0, hits[C.TRASH] / held[C.TRASH]).alias("trash_recall"), F.avg(cost.otherwise(1.0)).alias("mean_cost"),
    ]


def metrics(df: DataFrame, gold: str, predicted: str, by: Iterable[str] = ()) -> DataFrame:
    """n, agreement, macro_f1 (labels that occur), clear_loss, trash_recall and mean_cost, in one aggregate for each group."""
    return annotated(df, gold).groupBy(*by).agg(*_measures(gold, predicted))


def gold_gate(df: DataFrame, gold: str, model: str, incumbent: str, margin: float = 0.01) -> DataFrame:
    """Whether the model's macro F1 is at most margin below the incumbent's."""
    a, b = (metrics(df, gold, c).select(F.col("macro_f1").alias(name), *(["n"] if name == "model_macro_f1" else [])) for c, name in ((model, "model_macro_f1"), (incumbent, "incumbent_macro_f1")))
    return a.crossJoin(b).withColumn("passed", F.col("model_macro_f1") >= F.col("incumbent_macro_f1") - margin)  # one row each


def rescore(stored: DataFrame, cfg: C.EngineConfig = C.DEFAULT) -> DataFrame:
    """Stored lines decided anew under cfg; perplex_raw falls back on perplex, original_text on text. Empty and Non-text lines keep their row.

    stored is a table: on the plan that makes it, its category's whole definition would be pushed into a filter.
    """
    from pagewright.functions.signals import with_signals

    raw = F.col("perplex_raw") if "perplex_raw" in stored.columns else F.lit(None).cast("double")
    original = F.col("original_text") if "original_text" in stored.columns else F.lit(None).cast("string")
    base = stored.withColumns({"perplex_raw": F.coalesce(raw, F.col("perplex")), "original_text": F.coalesce(original, F.col("text"))})
    kept = ["file", "page_num", "line_num", "text", "categ", "quality_score", "rule"]
    decided = decide(with_signals(base.where(~F.col("categ").isin(*FAST_TRACK)).drop("categ", "quality_score", "rule"), cfg), cfg)
    passed = base.where(F.col("categ").isin(*FAST_TRACK)).withColumn("rule", F.concat(F.lit("route_"), F.lower("categ")))
    return decided.select(*kept).unionByName(passed.select(*kept))


def parity_mismatches(stored: DataFrame, again: DataFrame, keys: list[str], column: str = "categ") -> DataFrame:
    """Rows whose category differs, or that only one side has."""
    both = stored.select(*keys, F.col(column).alias("stored")).join(again.select(*keys, F.col(column).alias("recomputed")), keys, "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def ablation(signals: DataFrame, gold: str, cfg: C.EngineConfig = C.DEFAULT, weights: Iterable[str] = WEIGHTS, rules: Iterable[str] = RULES) -> DataFrame:
    """Each weight at 0 and each rule off, one at a time, against cfg: flips, clear_loss, macro_f1, macro_drop and a verdict.

    signals: lines with signals and gold, read by every variant, so best a table.
    """
    variants = [("baseline", cfg), *((w, replace(cfg, **{w: 0.0})) for w in weights), *((r, replace(cfg, disabled_rules=(*cfg.disabled_rules, r))) for r in rules)]
    before = decide(signals, cfg).withColumnRenamed("categ", "before").select(*signals.columns, "before")
    rows = None
    for name, other in variants:
        lines = annotated(decide(before, other), gold).select(gold, "before", "categ")
        one = lines.agg(F.count_if(F.col("before") != F.col("categ")).alias("flips"), *_measures(gold, "categ")).withColumn("factor", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    of_base = lambda c: F.max(F.when(F.col("factor") == "baseline", F.col(c))).over(Window.partitionBy())  # noqa: E731  (a row a variant)
    out = rows.withColumns({"macro_drop": of_base("macro_f1") - F.col("macro_f1"), "_loss": of_base("clear_loss")})
    verdict = F.when(F.col("factor") == "baseline", "BASE").when((F.col("clear_loss") > F.col("_loss")) | (F.col("macro_drop") > 0), "KEEP").when(F.col("flips") == 0, "PRUNE").otherwise("REVIEW")
    return out.withColumn("verdict", verdict).select("factor", "flips", "clear_loss", "macro_f1", "macro_drop", "mean_cost", "n", "verdict")


def backward_elimination(signals: DataFrame, gold: str, rules: Iterable[str], cfg: C.EngineConfig = C.DEFAULT, tolerance: float = 0.0) -> list[tuple[str, float]]:
    """Rules dropped one after another while macro F1 falls by no more than tolerance; each step compares all that are left in one job."""
    left, dropped = list(rules), []
    best = metrics(decide(signals, cfg), gold, "categ").first()["macro_f1"] or 0.0
    while left:
        tries = None
        for r in left:
            one = metrics(decide(signals, replace(cfg, disabled_rules=(*cfg.disabled_rules, *[d for d, _ in dropped], r))), gold, "categ").select(F.lit(r).alias("rule"), "macro_f1")
            tries = one if tries is None else tries.unionByName(one)
        top = tries.orderBy(F.desc("macro_f1"), "rule").first()
        if top["macro_f1"] < best - tolerance:
            break
        best = top["macro_f1"]
        dropped.append((top["rule"], best))
        left.remove(top["rule"])
    return dropped


def votes(lines: DataFrame, by: tuple[str, ...] = ("file", "text")) -> DataFrame:
    """How the lines of a group agree: unanimous, strict majority, bare plurality or tie, the winning category, and what following it changes.

    Of tied categories the first of CATEGORIES wins.
    """
    counts = lines.groupBy(*by, "categ").agg(F.count("*").alias("n"))
    place = F.expr(f"array_position(array({', '.join(repr(c) for c in C.CATEGORIES)}), categ)")
    top = F.min(F.struct((-F.col("n")).alias("m"), place.alias("place"), F.col("categ"))).alias("top")
    all_n = F.collect_list("n").alias("all")  # at most one a category
    out = counts.groupBy(*by).agg(F.sum("n").alias("lines"), F.count("*").alias("kinds"), top, all_n, F.coalesce(F.sum(F.when(F.col("categ").isin(C.CLEAR, C.NOISY), F.col("n"))), F.lit(0)).alias("kept"))
    most = -F.col("top.m")
    tied = F.size(F.filter("all", lambda x: x == -F.col("top.m"))) > 1
    kind = F.when(F.col("kinds") == 1, "unanimous").when(tied, "tie").when(most * 2 > F.col("lines"), "strict majority").otherwise("bare plurality")
    good = F.col("top.categ").isin(C.CLEAR, C.NOISY)
    return out.select(
        *by, "lines", kind.alias("vote"), F.col("top.categ").alias("winner"),
        F.when(good, F.lit(0)).otherwise(F.col("kept")).alias("destroyed"), F.when(good, F.col("lines") - F.col("kept")).otherwise(F.lit(0)).alias("rescued"),
    )


def perplexity_report(lines: DataFrame, cap: float = C.DEFAULT.short_perplexity_cap, margin: float = 50.0, by: tuple[str, ...] = ()) -> DataFrame:
    """By word count (1, 2, 3 and more): lines, those over the cap, those within margin of it, and the mean."""
    words = F.least(F.greatest(F.col("word_count"), F.lit(0)), F.lit(3)).alias("words")
    return lines.groupBy(*by, words).agg(
        F.count("*").alias("n"), F.count_if(F.col("perplex") > cap).alias("over_cap"), F.count_if(F.abs(F.col("perplex") - cap) <= margin).alias("near_cap"), F.avg("perplex").alias("mean_perplex")
    )


def transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    both = before.select(*keys, F.col("categ").alias("before")).join(after.select(*keys, F.col("categ").alias("after")), keys)
    return both.groupBy("before", "after").agg(F.count("*").alias("n"))


def annotation_pack(queue: DataFrame, leverage: int = 100) -> DataFrame:
    """Strings of a queue (text, occurrences, mix) by family: variants, lines settled, the mix in sum, and the tab they go to."""
    strings = queue.withColumn("family", F.expr(family_key()))
    shown = "array_join(slice(array_sort(collect_set(text)), 1, 6), ' | ')"
    families = strings.groupBy("family").agg(F.sum("occurrences").alias("lines_settled"), F.expr(shown).alias("variants"), F.count("*").alias("strings"), F.min_by("text", F.struct(-F.col("occurrences"), F.col("text"))).alias("text"))
    parts = strings.select("family", F.explode(F.split("mix", "[|]")).alias("part")).select("family", F.split("part", ":")[0].alias("categ"), F.split("part", ":")[1].cast("long").alias("n"))
    sums = parts.groupBy("family", "categ").agg(F.sum("n").alias("n"))
    mixed = sums.groupBy("family").agg(F.expr("array_join(transform(array_sort(collect_list(struct(-n AS m, categ AS c))), x -> concat(x.c, ':', cast(-x.m AS string))), '|')").alias("mix"), F.count("*").alias("kinds"))
    tab = F.when(F.col("kinds") > 1, "split").when(F.col("mix").startswith("Clear"), "clear").when(F.col("mix").startswith("Trash"), "trash").otherwise("other")
    return families.join(mixed, "family").withColumns({"tab": tab, "high_leverage": F.col("lines_settled") >= leverage}).drop("kinds")


def project_decisions(decisions: DataFrame, weight: str = "1D") -> DataFrame:
    """Decisions (label, mix, fires) -> the errors of two arms, without and with a witness that sends kept lines to Trash where it fires."""
    part = F.explode(F.split("mix", "[|]")).alias("part")
    rows = decisions.where("coalesce(label, '') <> ''").select("label", "fires", F.expr(weight).alias("w"), part)
    rows = rows.select("label", "fires", "w", F.split("part", ":")[0].alias("current"), F.split("part", ":")[1].cast("long").alias("n"))
    moved = F.when(F.col("fires") & F.col("current").isin(C.CLEAR, C.NOISY), C.TRASH).otherwise(F.col("current"))
    arms = rows.select("label", (F.col("n") * F.col("w")).alias("n"), F.explode(F.array(F.struct(F.lit("off").alias("arm"), F.col("current").alias("new")), F.struct(F.lit("on").alias("arm"), moved.alias("new")))).alias("a")).select("label", "n", "a.*")
    total = lambda test: F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0.0))
    return arms.groupBy("arm").agg(
        F.sum("n").alias("lines"), total("new <> label").alias("errors"), total("label = 'Clear' AND new IN ('Trash', 'Non-text')").alias("clear_loss"), total("label = 'Trash' AND new = 'Trash'").alias("trash_caught"),
        total("label = 'Trash'").alias("gold_trash"), total("label = 'Noisy' AND new = 'Trash'").alias("noisy_to_trash"),
    )


def blank_exposure(decisions: DataFrame) -> DataFrame:
    """Unlabelled decisions: rows, their kept lines, and those that the witness would condemn."""
    blank = decisions.where("coalesce(label, '') = ''")
    kept = F.expr("aggregate(transform(filter(split(mix, '[|]'), p -> p LIKE 'Clear:%' OR p LIKE 'Noisy:%'), p -> cast(element_at(split(p, ':'), 2) AS bigint)), 0L, (s, x) -> s + x)")
    rows = blank.select(kept.alias("kept"), "fires")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_lines"), F.coalesce(F.sum(F.when(F.col("fires"), F.col("kept"))), F.lit(0)).alias("witness_convicts"))


def labels_onto_lines(lines: DataFrame, decisions: DataFrame, most_words: int = 3) -> DataFrame:
    """lines with the label of their exact text, else of their family where all labels of it agree and the line has most_words words or fewer."""
    exact = decisions.groupBy("text").agg(F.min("label").alias("exact_label"))
    families = decisions.groupBy(F.expr(family_key()).alias("family")).agg(F.min("label").alias("family_label"), F.count_distinct("label").alias("k")).where("k = 1").drop("k")
    df = lines.withColumn("family", F.expr(family_key())).join(exact, "text", "left").join(families, "family", "left")
    short = F.size(F.split(F.trim("text"), r"\s+")) <= most_words
    label = F.coalesce("exact_label", F.when(short, F.col("family_label")))
    by = F.when(F.col("exact_label").isNotNull(), "text").when(label.isNotNull(), "family")
    return df.withColumns({"matched_by": by, "label": label}).drop("family", "exact_label", "family_label")


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rank from 0; equal values share the mean of their places."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("rank", place - 1 + (ties - 1) / 2)


def consensus(importances: DataFrame, top: int = 10) -> DataFrame:
    """Importances (backend, param, importance) -> by parameter: how many backends rank it in the top, whether that is robust, its mean rank (999 where a backend lacks it)."""
    ranked = importances.withColumn("r", F.row_number().over(Window.partitionBy("backend").orderBy(F.desc("importance"), "param")))
    backends = F.broadcast(importances.agg(F.count_distinct("backend").alias("backends")))  # one row
    out = ranked.groupBy("param").agg(F.count_if(F.col("r") <= top).alias("top_k_appearances"), F.avg("r").alias("mean"), F.count("*").alias("held")).crossJoin(backends)
    robust = F.col("top_k_appearances") >= F.greatest(F.lit(2), F.floor(F.col("backends") / 2))
    return out.select("param", "top_k_appearances", robust.alias("is_robust"), F.round(F.when(F.col("held") == F.col("backends"), F.col("mean")).otherwise(999.0), 2).alias("average_rank"))


def sample_documents(lines: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """All lines of k documents, drawn by hash."""
    drawn = lines.select("file").distinct().orderBy(hash_order("file", seed=seed), "file").limit(k)
    return lines.join(drawn, "file", "left_semi")


def rules_by_words(lines: DataFrame) -> DataFrame:
    """Rule by word count (1, 2, 3, 4, 5 and more), as a pivot."""
    bucket = F.least(F.greatest(F.col("word_count"), F.lit(1)), F.lit(5))
    return lines.withColumn("_words", bucket.cast("string")).groupBy("rule").pivot("_words", ["1", "2", "3", "4", "5"]).count().fillna(0)


def short_line_telemetry(lines: DataFrame, cfg: C.EngineConfig = C.DEFAULT) -> DataFrame:
    """Diagnostics of lines of one or two words, from their signals, as one struct a line."""
    shown = F.struct("valid_word_ratio", "word_weird", "garbage_density", "perplex", "original_lang_score", "structured", "has_diacritics", (F.col("perplex_raw") > cfg.short_perplexity_cap).alias("capped"))
    return lines.where("word_count BETWEEN 1 AND 2").withColumn("telemetry", shown)
