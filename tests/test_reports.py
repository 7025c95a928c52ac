"""Notation, witness, reports, splitting, tables, sinks and records: against SQL, small fixtures and round trips."""

import json
import os
import shutil
import subprocess
import sys
import types

import pytest
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright import sinks
from pagewright.functions import notation as N
from pagewright.functions import witness
from pagewright.functions.signals import with_signals
from pagewright.functions.words import shape, signs, word
from pagewright.operators import lexicon, modelling, records, reporting, scoring, shaping
from pagewright.operators.lines import route
from pagewright.plans import reports
from pagewright.sources import split, tables
from pagewright.sources.detect import Unreadable, kind_of, unpack
from pagewright.sources.readers import text_layer
from pagewright.streaming.ingest import changed_documents

from test_core import duck, lines, rows_of

NEW = [n for n, f in reports.QUERIES.items() if f.__module__ == "pagewright.plans.reports"]


@pytest.mark.parametrize("name", [n for n in NEW if n in reports.ORACLES])
def test_reports_equal_sql(spark, sf_dir, name):
    assert rows_of(reports.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck(reports.ORACLES[name], sf_dir))


LINES = {
    "výška 12 cm": {"measurement", "catalogue_reference", "structured", "spaced_metre"}, "pr. dna 7": {"measurement", "structured"}, "pr. 4": set(), "v - 112": {"measurement", "structured"}, "0,4m": {"measurement", "structured", "spaced_metre"},
    "2,10 m": {"spaced_metre"}, "3 m": set(), "Plocha: 3; sonda: XIV.": {"plot_header", "catalogue_reference", "structured"}, "AB123/45-C": {"catalogue_reference", "structured"}, "č. j. 12/99": {"catalogue_reference", "dated_reference", "structured"},
    "dne 3. 5. 1964 v Praze": {"dated_reference", "structured"}, "3. 5.": set(), "Obsah:": {"structure_label", "structured"}, "1. Úvod 12": {"structured"}, "II/C": {"notation"}, "o-e": set(), "Lokalisace: MM-III": {"notation"}, "Bokalisace: B-XII": set(),
    "2 ks": {"notation"}, "Reg.Bez.Aussig.": {"notation"}, "see www.example.com now": {"notation", "address"}, "jane@example.org": {"notation", "address"}, "plain words here": set(), "A.B.": {"catalogue_reference", "structured", "notation"},
}


def test_notation(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "text string").withColumn("t", F.expr(N.squeezed()))
    tests = {name: f("t", "0") if name in ("catalogue_reference", "structured") else f("t") for name, f in N.PREDICATES.items()}
    got = {r["text"]: {n for n in tests if r[n]} for r in df.select("text", *[F.expr(x).alias(n) for n, x in tests.items()]).collect()}
    assert got == LINES


def test_shapes_of_words():
    assert shape("PraHA.9=~") == "CcvCVp9ez" and word("dům").verdict == 2
    assert signs("PraHA")["mixed case"] and not signs("PhDr")["mixed case"] and signs("krk")["no vowel"] and signs("aaab")["repeated"]
    assert word("3cm").fusion is False and word("3x").fusion and word("a7").fusion and word("7,5").fusion is False
    assert word("č.").verdict == 0 and word("K.").verdict == 3 and word("napr.").verdict == 0 and word("J.K.").verdict == 0
    assert word("strčprstskrzkrk").fused and word("oueussd").fused and not word("praha").fused


def test_witness_clauses():
    want = {"oueussd": ["vowel_run"], "sektlll": ["triple"], "Tthts": ["initial_geminate"], "vansasaasasa": ["low_variety"], "Schifffahrt": [], "VIII/3": [], "Rosaceae": [], "malakofauna": [], "IDIDIDIDIDIDUOID": ["vowel_run", "low_variety"]}
    assert {t: witness.clauses(t, "ces_Latn") for t in want} == want
    assert witness.clauses("Dauerleihe", "deu_Latn") == [] and witness.clauses("Dauerleihe", "ces_Latn") == ["vowel_run"] and witness.clauses("oueussd", spared=["oueussd"]) == []


def test_witness_and_address_rules_need_their_settings(spark):
    base = lines(spark, ["oueussd", "write to jane@example.org today please"]).withColumns({"original_lang_score": F.lit(0.6), "perplex_raw": F.lit(150.0), "original_lang": F.lit("ces_Latn")})
    off = {r["text"]: r["rule"] for r in scoring.classify(base).collect()}
    cfg = C.EngineConfig(witness=True, notation_category="Noisy")
    on = {r["text"]: (r["rule"], r["categ"]) for r in scoring.classify(base, cfg).collect()}
    assert off["write to jane@example.org today please"] != "rule_domain_notation_categ" and on["write to jane@example.org today please"] == ("rule_domain_notation_categ", "Noisy")
    assert on["oueussd"] == ("rule_short_garbage", "Trash")
    assert len(scoring.RULES) == 24 == len(set(scoring.RULES)) and {r[0] for r in scoring.cascade()} - {"empty", "threshold_trash"} <= set(scoring.RULES)


CASCADE = {  # signals that differ from those of a clear line -> the rule that decides
    "rule_hard_sweep": {"original_lang_score": 0.3, "perplex": 2000.0}, "rule_extreme_ppl": {"original_lang_score": 0.8, "perplex": 3500.0}, "rule_absolute_ppl": {"perplex": 40000.0},
    "rule_inverted": {"ghost_dominated": True}, "rule_allcaps": {"vowel_ratio": 0.05, "caps_line": True}, "rule_garbage_density": {"garbage_density": 0.4}, "rule_zero_alpha": {"text": "12 34 56"},
    "rule_short_garbage": {"word_count": 3, "gibberish": 1, "trust": 0.5, "quality_raw": 0.7}, "rule_short_line": {"word_count": 2}, "rule_lowppl_clear": {"perplex": 20.0},
    "rule_wqx_rot": {"rot_ratio": 0.6, "original_lang_score": 0.7, "quality_raw": 0.7, "gibberish": 1}, "rule_vowelless": {"word_count": 3, "vowel_ratio": 0.2, "caps_line": True, "quality_raw": 0.7},
    "rule_ledger_fragmentation": {"fragment_ratio": 0.7, "original_lang_score": 0.7, "quality_raw": 0.7, "gibberish": 1}, "rule_bigram_run": {"bigram_run": True, "original_lang_score": 0.7, "quality_raw": 0.7, "gibberish": 1},
    "rule_fragment_tokens": {"mean_token_length": 1.5, "original_lang_score": 0.7, "quality_raw": 0.7, "gibberish": 1}, "threshold_trash": {"quality_raw": 0.3}, "rule_mostly_readable_noisy": {"valid_word_ratio": 0.5},
    "rule_damaged_token": {"damaged_tokens": 1}, "threshold_clear": {}, "empty": {"word_count": 0},
}


def test_every_rule_fires_and_can_be_switched_off(spark):
    base = {
        "text": "a plain line of words", "original_text": "a plain line of words", "word_count": 5, "char_count": 21, "garbage_density": 0.0, "vowel_ratio": 0.4, "rot_ratio": 0.3, "gibberish": 0, "weird_wx": 0, "word_weird": 0.0, "valid_word_ratio": 1.0,
        "structured": False, "clean_reference": False, "notation": False, "address": False, "witness": False, "has_diacritics": False, "bigram_run": False, "damaged_tokens": 0, "upper": 0, "fused_words": 0, "ghost_hits": 0, "wqx_ratio": 0.0,
        "fragment_ratio": 0.0, "mean_token_length": 4.0, "caps_line": False, "upright": False, "ghost_dominated": False, "trust": 0.9, "original_lang_score": 0.9, "perplex": 100.0, "perplex_raw": 100.0, "gibberish_ratio": 0.0, "fused_ratio": 0.0, "quality_raw": 0.95,
    }
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame([{**base, **change, "want": rule} for rule, change in CASCADE.items()]))

    def rules(cfg):
        tests = scoring.cascade(cfg)
        filled = df.withColumns({"evidence": F.expr(scoring.strong_evidence()), "forgiven": F.lit(False), "fill_rescued": F.lit(False)})
        return {r["want"]: r["rule"] for r in filled.withColumn("rule", F.expr("CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t, _ in tests) + " ELSE 'threshold_clear' END")).collect()}

    assert rules(C.DEFAULT) == {r: r for r in CASCADE}
    off = rules(C.EngineConfig(disabled_rules=scoring.RULES))
    assert all(off[r] != r for r in CASCADE if r in scoring.RULES)


def test_rescore_and_ablation(spark, tmp_path):
    text = ["Der Hund lief schnell nach Hause", "", "123 456", "xq wq xxq zzz wwx", "Die Katze schläft"]
    scoring.classify(lines(spark, text)).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    again = reporting.rescore(stored)
    assert reporting.parity_mismatches(stored, again, ["file", "page_num", "line_num"]).count() == 0 and again.count() == len(text)
    signals = with_signals(route(lines(spark, text)).where("route = 'Process'")).withColumn("gold", F.lit("Clear"))
    signals.write.parquet(str(tmp_path / "signals"))
    signals = spark.read.parquet(str(tmp_path / "signals"))
    got = {r["factor"]: r for r in reporting.ablation(signals, "gold", weights=(), rules=("rule_hard_sweep",)).collect()}
    assert got["baseline"]["flips"] == 0 and set(got) == {"baseline", "rule_hard_sweep"} and got["rule_hard_sweep"]["verdict"] in ("KEEP", "PRUNE", "REVIEW")
    assert len(reporting.backward_elimination(signals, "gold", ("rule_allcaps",))) == 1
    gate = reporting.gold_gate(spark.createDataFrame([("Clear", "Clear", "Trash"), ("Trash", "Trash", "Trash")], "g string, m string, i string"), "g", "m", "i").first()
    assert gate["passed"] and gate["model_macro_f1"] == 1.0
    with pytest.raises(ValueError, match="no column"):
        reporting.annotated(stored, "gold")
    labels = spark.createDataFrame([(" NON_TEXT",), ("clear ",), (None,), ("odd",)], "c string").select(reporting.normalised_category("c"))
    assert [r[0] for r in labels.collect()] == ["Non-text", "Clear", "", "odd"]
    assert reporting.short_line_telemetry(signals).count() == 0


def alto(pages):
    body = "".join(f'<Page ID="P{n}" PHYSICAL_IMG_NR="{n}"><PrintSpace><TextBlock ID="b{n}"/></PrintSpace></Page>' for n in pages)
    return f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Description><d/></Description><Layout>{body}</Layout></alto>'.encode()


def test_splitting(spark, tmp_path):
    assert [n for n, _ in split.alto_pages(alto([3, 7]))] == ["3", "7"] and all(d.count(b"<Page ") == 1 and b"Description" in d for _, d in split.alto_pages(alto([3, 7])))
    with pytest.raises(Unreadable, match="doctype"):
        split.alto_pages(b"<!DOCTYPE x><alto/>")
    a = {"analyze": {"Pages": [{"pageNumber": 4, "t": "x"}, {"t": "y"}]}, "v": 1}
    assert split.json_page_documents(a) == [("4", {"analyze": {"Pages": {"pageNumber": 4, "t": "x"}}, "v": 1}), ("2", {"analyze": {"Pages": {"t": "y"}}, "v": 1})]
    b = {"lines": [{"page": 2, "t": "a"}, {"page": 1, "t": "b"}, {"page": 2, "t": "c"}, {"t": "d"}]}
    assert [(n, len(d["lines"])) for n, d in split.json_page_documents(b)] == [("2", 2), ("1", 1)]
    assert split.json_page_documents({"lines": [{"t": 1}]}) == [("1", {"lines": [{"t": 1}]})] and split.page_scope(a["analyze"]) == a["analyze"]["Pages"]
    (tmp_path / "doc.alto.xml").write_bytes(alto([1, 2]))
    (tmp_path / "doc2.json").write_text(json.dumps(a))
    (tmp_path / "bad.json").write_text("{")
    got = split.split_pages(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = {(r["file"], r["page"]) for r in got.where("error IS NULL").collect()}
    assert rows == {("doc", "1"), ("doc", "2"), ("doc2", "4"), ("doc2", "2")} and got.where("error IS NOT NULL").count() == 1
    old = spark.createDataFrame([("doc", "1"), ("doc", "9"), ("other", "5")], "file string, page string")
    assert [tuple(r) for r in split.stale_pages(old, got.select("file", "page")).collect()] == [("doc", "9")]


def test_reading_order(spark):
    blocks = '<TextBlock ID="a" IDNEXT="c"/><TextBlock ID="b"/><TextBlock ID="c" IDNEXT="b"/>'
    assert split.reading_order(f"<alto>{blocks}</alto>".encode()) == ["a", "c", "b"]
    order = '<ReadingOrder><OrderedGroup><ElementRef REF="b"/><ElementRef REF="a"/></OrderedGroup></ReadingOrder>'
    assert split.reading_order(f"<alto>{order}{blocks}</alto>".encode()) == ["b", "a"]
    assert split.reading_order(b'<alto><TextBlock ID="x"/><TextBlock ID="w"/></alto>') == ["x", "w"]
    df = spark.createDataFrame([("f", 1, "a", "c", 0), ("f", 1, "b", None, 1), ("f", 1, "c", "b", 2), ("f", 2, "x", None, 0), ("f", 2, "w", None, 1)], "file string, page int, id string, next string, pos int")
    assert [r["id"] for r in split.in_chain_order(df).orderBy("page", "place").collect()] == ["a", "c", "b", "x", "w"]


def test_line_shaping(spark):
    assert shaping.normalised_line("ﬁne text​ zkou­") == "fine text zkou-" and shaping.normalised_line("é\x07") == "é"
    assert shaping.wrapped("aaa bbb ccc", 7) == ["aaa bbb", "ccc"] and shaping.wrapped("abcdefgh", 3) == ["abc", "def", "gh"] and shaping.wrapped("", 5) == [""] and shaping.wrapped("a\tb c", 2) == ["a", "b", "c"]
    assert shaping.shaped("one\r\n\ntwo\fthree", 1000) == ["one", "two", "three"] and shaping.shaped("a\n\nb", keep_blank=True) == ["a", "", "b"] and shaping.shaped(None) == []
    df = spark.createDataFrame([("f", 1, 1, "x\ny"), ("f", 1, 2, None), ("f", 1, 3, "z")], "file string, page_num int, line_num int, text string")
    assert [(r["line_num"], r["text"]) for r in shaping.shape_lines(df).orderBy("line_num").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    boxes = spark.createDataFrame([("f", 1, 1, "a", 0, 10), ("f", 1, 2, "b", 12, 22), ("f", 1, 3, "c", 60, 70)], "file string, page_num int, line_num int, text string, top int, bottom int")
    assert shaping.page_texts(boxes).first()["text"] == "a\nb\n\nc"


def test_tables(spark, tmp_path):
    (tmp_path / "D1.csv").write_text('categ,file,page_num,line_num,text,extra\nClear,,1,1,"NA, null",0007\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "D2.csv").write_text("file,page_num,text\n0042,3,x\n")
    one = tables.read_lines(spark, str(tmp_path / "D1.csv")).first()
    assert (one["file"], one["page_num"], one["text"], one["extra"]) == ("D1", 1, "NA, null", "0007")
    assert tables.read_lines(spark, str(tmp_path / "D1.csv"), "other").first()["file"] == "other"
    assert tables.read_lines(spark, str(tmp_path / "sub")).first()["file"] == "0042"
    (tmp_path / "index.csv").write_text("file,page,textlines,illustrations,graphics,strings,path\n007,1,2,,,4,p\n")
    index = tables.read_page_index(spark, str(tmp_path / "index.csv"))
    assert index.first()["file"] == "007" and index.first()["graphics"] is None
    pages = spark.createDataFrame([("007_1.txt", "under"), ("008-1.txt", "hyphen")], "name string, text string")
    assert tables.with_page_text(index, pages).first()["text"] == "under"
    images = spark.createDataFrame([("007", 2, 5)], "file string, page int, images int")
    assert tables.with_images(index, images).first()["images"] == 0 and tables.with_labels(index, spark.createDataFrame([("007", 1, "iv")], "file string, page int, page_label string")).first()["page_label"] == "iv"
    for name in ("r/a.txt", "r/d/b.txt", "r/.h/c.txt", "r/d/e/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {(r["name"], r["parent"]) for r in tables.page_files(spark, str(tmp_path / "r")).collect()} == {("a.txt", None), ("b.txt", "d")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y")], "file string, page_num int, line_num int, text string")
    out = str(tmp_path / "lines")
    sinks.write_lines(rows, out)
    sinks.write_lines(rows.where("file = 'a'").withColumn("text", F.lit("new")), out)
    assert {(r["file"], r["text"]) for r in spark.read.parquet(out).collect()} == {("a", "new"), ("b", "y")}
    table = str(tmp_path / "pages")
    assert sinks.write_changed(rows, table, ["file"], "text") == 2 and sinks.write_changed(rows, table, ["file"], "text") == 0
    assert sinks.write_changed(rows.where("file = 'b'").withColumn("text", F.lit("z")), table, ["file"], "text") == 1
    sinks.write_lexicon(spark.createDataFrame([("aa", 2), ("bb", 9)], "token string, document_frequency long"), str(tmp_path / "lex"), "made\there")
    assert [r[0] for r in spark.read.text(str(tmp_path / "lex")).collect()] == ["# made here", "bb\t9", "aa\t2"]
    sinks.write_page_json(rows, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).where("file = 'b'").first()[0])["text"] == "y"
    sinks.write_records(spark.createDataFrame([(1, None, "x")], "doc_id long, a string, b string"), str(tmp_path / "rec"))
    assert json.loads(spark.read.text(str(tmp_path / "rec")).first()[0]) == {"doc_id": 1, "b": "x"}
    crate = json.loads(sinks.crates(spark.createDataFrame([("d", "MIT", ["p1.txt"])], "doc_id string, license string, files array<string>")).first()["crate"])
    assert [e["@id"] for e in crate["@graph"]] == ["ro-crate-metadata.json", "./", "p1.txt", "#run-d"] and crate["@graph"][1]["license"] == "MIT"
    have = spark.createDataFrame([("a", 10), ("b", 1)], "file string, modified int")
    due = sinks.is_current(have, spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "file string, modified int"))
    assert {r["file"] for r in due.collect()} == {"b", "c"}
    assert sinks.listing(spark, str(tmp_path / "json")).where("modified IS NOT NULL AND file LIKE 'part-%'").count() == 2


def test_records(spark):
    stored = spark.createDataFrame([("d", None, "s5", "x")], "doc_id string, sha256 string, sha512 string, name string")
    merged, conflicts = records.set_source(stored, spark.createDataFrame([("d", "s2", "y")], "doc_id string, sha256 string, name string"), ["doc_id"])
    assert merged.first().asDict() == {"doc_id": "d", "sha256": None, "sha512": "s5", "name": "x"} and [tuple(r) for r in conflicts.collect()] == [("d", "name", "x", "y")]
    found = records.problems(stored, {"name": "string", "sha256": "string", "pages": "int"}).first()["problems"]
    assert sorted(found) == ["pages: missing", "sha256: null"]
    blocks = spark.createDataFrame([("d", "lines", "ocr:x", None), ("e", "lines", "pdf:x", True), ("f", "lines", "pdf:x", None), ("f", "summary", "pdf:x", None)], "doc_id string, block string, origin string, handoff boolean")
    assert {(r["doc_id"], r["block"]) for r in records.writable_blocks(blocks, "ocr").collect()} == {("d", "lines"), ("e", "lines"), ("f", "summary")}
    runs = spark.createDataFrame([("r", "one", 1, 2, 10, 9, 1, 1.0), ("r", "two", 3, 6, 9, 7, 2, 3.0)], "run string, stage string, started int, ended int, inputs int, processed int, skipped int, seconds double")
    assert records.merged_paradata(runs).first().asDict() == {"run": "r", "inputs": 10, "processed": 7, "skipped": 3, "seconds": 4.0, "started": 1, "ended": 6, "stages": 2}
    notes = spark.createDataFrame([(["xml_recovered", "jsonl_bad_records=3", "fine"], ["page_load_failed"]), (None, None)], "notes array<string>, flags array<string>").select(F.expr(records.lossy_reasons()))
    assert [r[0] for r in notes.collect()] == [["xml_recovered", "jsonl_bad_records", "page_load_failed"], []]
    assert records.origins_by_kind("alto = ocr:x\npdf=digital-born-pdf", ("alto", "pdf")) == {"alto": "ocr:x", "pdf": "digital-born-pdf"}
    with pytest.raises(ValueError, match="nope"):
        records.origins_by_kind("nope=x", ("alto",))
    df = spark.createDataFrame([("alto", "own"), ("pdf", "own")], "kind string, origin string")
    sql = records.resolved_origin("origin", by_kind={"alto": "ocr:mine"})
    assert [r[0] for r in df.select(F.expr(sql)).collect()] == ["ocr:mine", "own"] and df.select(F.expr(records.resolved_origin("origin", "top"))).first()[0] == "top"
    ts = spark.sql("SELECT timestamp'2024-03-01 10:20:30.9' AS t").select(records.utc_seconds("t")).first()[0]
    assert ts == "2024-03-01T10:20:30Z"
    lines_ = spark.createDataFrame([("f", 1, 2, "Clear", None), ("f", 1, 1, "Trash", "t")], "file string, page_num int, line_num int, categ string, text string")
    assert [json.loads(x) for x in records.line_records(lines_).first()["lines"]] == [{"page_num": 1, "line_num": 1, "categ": "Trash", "text": "t"}, {"page_num": 1, "line_num": 2, "categ": "Clear"}]


def test_lexicon_annotation(spark):
    lex = spark.createDataFrame([("základní", 50), ("okraje", 40), ("zakladni", 1), ("okraie", 2), ("mmoře", 1), ("moře", 30), ("xyzzy", 1)], "token string, document_frequency long")
    near = {r["token"]: (r["neighbour"], r["mechanism"]) for r in lexicon.nearest_attested(lex).where("rank = 1").collect()}
    assert near == {"zakladni": ("základní", "diacritics"), "okraie": ("okraje", "confusion"), "mmoře": ("moře", "confusion")}
    twins = {r["token"]: r["mechanism"] for r in lexicon.stronger_twins(lex).collect()}
    assert twins["okraie"] == "stronger-twin" and twins["zakladni"] == "diacritics" and "xyzzy" not in twins
    df = spark.createDataFrame([("f", 1, 1, "Okraie xyzzy okraje", "Clear"), ("f", 1, 2, "a b", "Noisy")], "file string, page_num int, line_num int, text string, categ string")
    got = lexicon.annotated_lines(df, lex).first()
    assert got["token_status"] == "okraie:recoverable | okraje:attested | xyzzy:unattested" and got["nearest_attested"] == "okraie -> okraje (confusion)"
    assert {(r["categ"], r["bucket"]) for r in lexicon.recoverability_report(df, lex).collect()} == {("Clear", "0.6"), ("Noisy", "no opinion")}


def test_pdf_by_an_optional_library(monkeypatch):
    with pytest.raises(Unreadable, match="dependency_missing"):
        kind_of(b"%PDF-1.7", "x.pdf")

    class Reader:
        is_encrypted = False
        pages = [types.SimpleNamespace(extract_text=lambda: "one\ntwo"), types.SimpleNamespace(extract_text=lambda: "���")]

        def __init__(self, stream):
            assert stream.read(4) == b"%PDF"

    from pagewright.sources import detect, readers

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    monkeypatch.setattr(detect.importlib.util, "find_spec", lambda name: object())
    assert readers.read(b"%PDF-1.7", "x.pdf") == ("pdf", [("1", ["one", "two"]), ("2", [])])
    assert text_layer("", 0, 0)[0] == "none" and text_layer("abc", 4, 2)[0] == "ocr" and text_layer("abc", 4, 1)[0] == "digital"


def test_bombs_are_not_unpacked_whole():
    import gzip

    assert unpack(gzip.compress(b"abc")) == b"abc"
    with pytest.raises(Unreadable, match="compression_bomb"):
        unpack(gzip.compress(b"\0" * (1 << 20)))


def test_changed_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    seen = docs.withColumn("sha256", F.sha2("text", 256)).drop("text")
    assert [r["doc_id"] for r in changed_documents(docs.withColumn("text", F.when(F.col("doc_id") == 2, "c").otherwise(F.col("text"))), seen).collect()] == [2]


def test_regressor_learns(spark):
    rows = spark.range(200).select((F.col("id") / 200).alias("q"), *[(F.col("id") % 7 if k else F.col("id")).cast("double").alias(c) for k, c in enumerate(modelling.FEATURES)])
    model = modelling.train_regressor(rows, "q", rounds=3)
    got = model.transform(rows.select("q", *modelling.FEATURES)).select(F.avg(F.abs(F.col("q") - F.col("prediction")))).first()[0]
    assert got < 0.05


def test_core_stands_without_the_training_data_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for gone in ("pagewright/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "repo" / gone, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_stats' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "").replace(root, "")})


def test_tests_before_the_patterns_change_nothing(spark):
    from pagewright.functions import notation as N
    from pagewright.operators.lines import repaired

    lines = ["ve1ký 2emě A B C D", "P R A H A a B R N O", "a1 2b 12", "www.a.cz", "WwW.x.eu/2", "wwx.a.cz", "e-mail : x", "a@b.cz", "https://x", "obr. bez", "rozm. bez", "rozm. 1", "č. j. 5", "A-1/2", "1. Úvod 5", "12.3.1950", "12 cm", None]
    df = spark.createDataFrame([(x,) for x in lines], "t string").withColumn("damaged_tokens", F.lit(0))
    for pattern, name in ((N.ADDRESS, N.address), (N.REFERENCE + "|" + N.QUANTITY, N.clean_reference)):
        assert df.where(f"NOT ({N.has('t', pattern)} <=> {name('t')})").count() == 0
    # a line without a digit is spared the patterns that need one
    tested = N.measurement("t")
    assert tested.startswith("(" + N.digit("t") + " AND ") and df.where(f"{tested} AND NOT t rlike '[0-9]'").count() == 0
    got = {r["t"]: r["x"] for r in df.select("t", F.expr(repaired("t")).alias("x")).collect()}
    assert got["ve1ký 2emě A B C D"] == "velký země Abcd" and got["P R A H A a B R N O"] == "Praha a Praha" and got["a1 2b 12"] == "a1 zb 12" and got[None] is None


def test_eligible_lines_alone(spark):
    texts = ["oueussd", "a b c", "a b c d", " a b c", "  a  b  c  ", "a\tb c d", "a\u00a0b c", "a - - -", "a ' b", "a b c d e", "x  y  z  ooo e", "bbrno 1", "", None, "a\nb\nc", "- a b c d"]
    df = spark.createDataFrame([(t, "ces_Latn") for t in texts], "text string, original_lang string")
    read = lambda got: sorted(map(str, got.select("text", "word_count", "witness", "clauses").collect()))
    found = read(witness.line_report(df, eligible_only=True))
    assert found == read(witness.line_report(df).where("eligible")) and len(found) > 5


def test_pages_are_not_gathered_by_thousands(spark, sf_dir):
    plan = reports.QUERIES["html_text_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
