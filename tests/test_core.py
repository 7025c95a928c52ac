import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions.words import line_signals, word
from pagewright.operators import aggregate, evaluate, passes, scoring, shaping
from pagewright.operators.lines import explode_lines, remap_language, route, with_model_columns
from pagewright.plans.queries import ORACLES, QUERIES
from pagewright.sources.detect import Unreadable, decode, kind_of
from pagewright.sources.files import ingest_report, page_index, scan_folder
from pagewright.sources.readers import read
from pagewright.streaming.ingest import classify_stream


def signals(text):
    return dict(zip(__import__("pagewright.functions.words", fromlist=["FIELDS"]).FIELDS, line_signals(text), strict=True))


def test_word_signals():
    assert word("Praha").verdict == 2 and word("12.").verdict == 0
    assert word("xlll7").fusion and word("3cm").fusion is False
    assert word("PraHA").upper and not word("PhDr.").upper
    assert signals("")["valid_word_ratio"] == 0 and signals("12 34")["valid_word_ratio"] == 1
    assert signals("po dlouhé cestě")["upright"]
    assert 0 < signals("zzzz qqqq")["word_weird"] <= 1


def lines(spark, rows):
    return remap_language(with_model_columns(spark.createDataFrame([("d", 1, i + 1, t, "de") for i, t in enumerate(rows)], "file string, page_num int, line_num int, text string, lang string")))


def test_routing(spark):
    rows = ["", None, "123 456", "XIV.", "a", "Der Hund lief schnell nach Hause", "12/34", "- - -"]
    got = [r["route"] for r in route(lines(spark, rows)).orderBy("line_num").collect()]
    assert got == ["Empty", "Empty", "Non-text", "Non-text", "Non-text", "Process", "Non-text", "Non-text"]


def test_cascade_rules_are_ordered_and_can_be_disabled(spark):
    base = lines(spark, ["Der Hund lief schnell nach Hause"]).withColumns({"original_lang_score": F.lit(0.3), "perplex_raw": F.lit(2000.0)})
    assert scoring.classify(base).first()["rule"] == "rule_hard_sweep"
    other = scoring.classify(base, C.EngineConfig(disabled_rules=("rule_hard_sweep",))).first()
    assert other["rule"] != "rule_hard_sweep" and other["categ"] in C.CATEGORIES
    clear = base.withColumns({"original_lang_score": F.lit(0.99), "perplex_raw": F.lit(100.0)})
    row = scoring.classify(clear).first()
    assert row["categ"] == "Clear" and row["quality_score"] >= 0.8


def test_passes_on_small_frames(spark):
    schema = "file string, page_num int, line_num int, text string, categ string, quality_score double"
    df = spark.createDataFrame([("d", 1, i + 1, f"t{i}", c, 0.6) for i, c in enumerate(["Trash", "Trash", "Noisy", "Trash", "Trash"])], schema)
    assert [r["categ"] for r in passes.surrounded_trash(df).orderBy("line_num").collect()] == ["Trash"] * 5
    df = spark.createDataFrame([("d", 1, 1, "a", "Clear", 0.9), ("d", 1, 2, "a", "Trash", 0.1), ("d", 1, 3, None, "Empty", 0.0)], schema)
    assert [r["categ"] for r in passes.modal_dedup(df).orderBy("line_num").collect()] == ["Clear", "Clear", "Empty"]


def test_plain_words_are_read_as_all_others():
    import random

    from pagewright.functions.words import _PLAIN, any_word, word

    rng, cores = random.Random(3), ["prof", "Ing", "oooo", "oo", "brambory", "strč", "krk", "xaxaxx", "Waww", "aeiou", "Mississippi", "nejneobhospodařovávanější", "ščžň"]
    cores += ["".join(rng.choice("aeiouwxqbcčdrsštnýß") for _ in range(rng.randint(3, 17))) for _ in range(3000)]
    cores += [c.capitalize() for c in cores]
    for core in (c for c in cores if _PLAIN.fullmatch(c)):
        for raw in (core, core + ".", "(" + core + ".),", core + ".:"):
            found = word(raw)
            assert found._replace(clean=False) == any_word(raw, core)
            assert not found.clean or not any((found.weird, found.repeated, found.fused, found.gibberish, found.wx, found.wqx)) and found.verdict == 2
    assert word("brambory").clean and not word("Waww").clean and not word("prof.").clean


def test_a_surrounded_line_at_the_limit_stays(spark):
    schema = "file string, page_num int, line_num int, text string, categ string, quality_score double"
    of = lambda score: spark.createDataFrame([("d", 1, i + 1, f"t{i}", c, score) for i, c in enumerate(["Trash", "Trash", "Noisy", "Trash", "Trash"])], schema)
    assert [passes.surrounded_trash(of(score)).where("pp_surrounded_trash").count() for score in (0.6999, 0.7)] == [1, 0]


def test_statistics(spark):
    assert evaluate.mcnemar(0, 0) == 1.0 and evaluate.mcnemar(8, 1) == pytest.approx(0.0390625)
    low, high = evaluate.wilson("k", "n")
    row = spark.createDataFrame([(8, 10)], "k int, n int").select(F.expr(low).alias("l"), F.expr(high).alias("h")).first()
    assert (row["l"], row["h"]) == (pytest.approx(0.4902, abs=1e-3), pytest.approx(0.9433, abs=1e-3))
    assert spark.createDataFrame([("Trash:4|Clear:539",)], "mix string").select(F.expr(aggregate.dominant_category())).first()[0] == "Clear"


def test_shaping(spark):
    df = spark.createDataFrame([("f", 1, 1, "zkou-"), ("f", 1, 2, "ška textu"), ("f", 1, 3, "dál")], "file string, page_num int, line_num int, text string")
    assert [(r["line_num"], r["text"]) for r in shaping.dehyphenate_lines(df).orderBy("line_num").collect()] == [(1, "zkouška textu"), (3, "dál")]
    df = spark.createDataFrame([("f", 1, 1, "na zkou- {zkoušku}"), ("f", 1, 2, "šku přišel")], "file string, page_num int, line_num int, text string")
    df = df.replace("na zkou- {zkoušku}", "na zkou- {zkoušku}")
    assert shaping.merge_marked_splits(df).orderBy("line_num").first()["merged"] == "na zkoušku"


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


FILES = {
    "a.txt": (b"one\ntwo\fthree\n", "text", [["one", "two"], ["three"]]),
    "a.md": (b"# Title\n\n- *item*\n```\ncode\n```\n", "markdown", [["Title", "", "item", "code", ""]]),
    "a.csv": (b"page,text\n1,first\n2,second\n1,third\n", "csv", [["first", "third"], ["second"]]),
    "a.tsv": (b"level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\ttext\n1\t1\t0\t0\t0\t0\t\n5\t1\t1\t1\t1\t1\tHello\n5\t1\t1\t1\t1\t2\tworld\n", "tesseract", [["Hello world"]]),
    "a.json": (b'{"analyze": {"pages": [{"pageNumber": 1, "lines": [{"content": "x y"}], "words": [{"content": "x"}]}]}}', "json", [["x y"]]),
    "a.jsonl": (b'{"id": 1, "text": "p"}\n{"id": 2, "lines": [{"text": "q"}]}\n', "jsonl", [["p"], ["q"]]),
    "a.html": (b"<html><head><style>x</style></head><body><p>Hi <b>you</b></p><div>There</div></body></html>", "html", [["Hi you", "There"]]),
    "a.srt": (b"1\n00:00:01,000 --> 00:00:02,000\n<i>Line</i>\n\n", "subtitles", [["Line"]]),
    "a.eml": (b"From: a@example.com\nTo: b@example.com\nSubject: S\n\nBody\n", "email", [["S", "Body"]]),
    "alto.xml": (b'<alto><Layout><Page PHYSICAL_IMG_NR="7"><TextBlock><TextLine><String CONTENT="ab"/><HYP/></TextLine></TextBlock></Page></Layout></alto>', "alto", [["ab-"]]),
    "page.xml": (b'<PcGts><Page><TextRegion id="r2"><TextLine><TextEquiv><Unicode>B</Unicode></TextEquiv></TextLine></TextRegion><TextRegion id="r1"><TextLine><TextEquiv><Unicode>A</Unicode></TextEquiv></TextLine></TextRegion><ReadingOrder><OrderedGroup><RegionRefIndexed index="0" regionRef="r1"/><RegionRefIndexed index="1" regionRef="r2"/></OrderedGroup></ReadingOrder></Page></PcGts>', "page_xml", [["A", "B"]]),
    "tei.xml": (b'<TEI><teiHeader>no</teiHeader><text><pb n="1"/><p>a<lb/>b</p><pb n="2"/><p>c</p></text></TEI>', "tei", [["a", "b"], ["c"]]),
    "a.rtf": (rb"{\rtf1\ansi\ansicpg1250 Caf\'e9\par Two\page Three}", "rtf", [["Café", "Two"], ["Three"]]),
    "a.docx": (docx(), "docx", [["One"], ["Two"]]),
    "a.txt.gz": (gzip.compress(b"zipped\n"), "text", [["zipped"]]),
}


@pytest.mark.parametrize("name", FILES)
def test_readers(name):
    data, kind, pages = FILES[name]
    got_kind, got = read(data, name)
    assert got_kind == kind and [lines for _, lines in got] == pages


def test_detection_refuses_and_decodes():
    for data, reason in ((b"%PDF-1.7", "dependency_missing"), (b"\xff\xd8\xff\xe0", "image"), (b"\xd0\xcf\x11\xe0", "legacy_office")):
        with pytest.raises(Unreadable, match=reason):
            kind_of(data, "x")
    assert decode("žluť".encode("cp1250"))[0] == "žluť" and decode("a\n".encode("utf-16"))[0] == "a\n"


def test_folder_scan(spark, tmp_path):
    for name, (data, _, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "bad.png").write_bytes(b"\x89PNG....")
    rows = scan_folder(spark, str(tmp_path))
    report = {(r["file"], r["status"]) for r in ingest_report(rows).collect()}
    assert ("bad", "error") in report and ("a", "ok") in report
    assert page_index(rows).count() > 5


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Der Hund lief schnell\n\n123", "de"), (2, "The cat sat on the mat", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "in"))
    classify_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    keys = ["file", "page_num", "line_num", "categ"]
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*keys).collect()}
    batch = passes.document_passes(scoring.classify(remap_language(with_model_columns(explode_lines(docs)))))
    assert streamed == {tuple(r) for r in batch.select(*keys).collect()} and len(streamed) == 4


def duck(sql, sf_dir):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "labels", "events", "conversations", "lineitem", "orders", "customer", "nation"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c.sql(sql).df()


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(v) if not isinstance(v, float) or v != v else f"{v:.8f}" for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", ["lines_explode", "line_basic_signals", "line_token_counts", "inverted_runs", "page_stats", "distinct_string_queue", "ocr_neighbours_delete1", "f1_macro", "strata_agreement", "jsonl_leaves", "license_max_rank"])
def test_queries_equal_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck(ORACLES[name], sf_dir))


@pytest.mark.parametrize("name", ["line_context_all", "record_merge_all"])
def test_whole_table_queries(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert rows_of(got.toPandas()) == rows_of(duck(ORACLES[name], sf_dir))
    part = QUERIES[{"line_context_all": "line_context", "record_merge_all": "record_merge_block"}[name]](spark, sf_dir)
    assert got.count() > part.count() or name == "record_merge_all"


def test_corrupted_variants_take_every_line(spark, sf_dir):
    lines = QUERIES["lines_explode"](spark, sf_dir).where("length(text) BETWEEN 1 AND 40").select("file", "page_num", "line_num").distinct()
    got = QUERIES["corrupted_variants"](spark, sf_dir).select("file", "page_num", "line_num").distinct()
    assert lines.count() > 0 and lines.join(got, ["file", "page_num", "line_num"]).count() > 0


def test_entry_imports_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_corruption_is_deterministic_and_ordered(spark):
    from pagewright.functions.corruption import BANDS, OPS, corrupt, generator
    from pagewright.operators import modelling

    text = "Příliš žluťoučký kůň úpěl ďábelské ódy na mokré louce"
    for name in OPS:
        assert corrupt(text, generator(1, "f", 1, 0), "heavy", [name]) == corrupt(text, generator(1, "f", 1, 0), "heavy", [name])
        assert corrupt(text, generator(1, "f", 1, 0), "heavy", [name])[0] != text
    df = spark.createDataFrame([("AB1964001", 1, 1, text), ("x", 1, 2, text)], "file string, page_num int, line_num int, text string")
    rows = modelling.variants(df).collect()
    assert len(rows) == 2 * len(BANDS) and modelling.dataset(df).count() <= 7
    assert [r[0] for r in df.select(F.expr(modelling.decade())).collect()] == ["1960s", "unknown"]
