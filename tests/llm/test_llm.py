"""The training-data operators against brute force, round trips and held-out accuracy; and their corner cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import components, decontamination, embeddings, language, licences, line_dedup, packing, pii, sharding, simhash, sstable, tokens
from pagewright.llm.queries import oracle_sql, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Null, empty, blank, repeated and odd texts; the other columns clash with names that operators use.
ODD = [(1, "the cat sat on the mat today"), (1, "the cat sat on the mat today"), (2, None), (3, ""), (4, " \n\t"), (None, "a null id with some words here"), (5, "12345 !!!"), (6, "ž" * 3000), (7, "word " * 2000)]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", F.lit(1).alias("slot"), F.lit("x").alias("score"), F.lit(2).alias("n_lines"), F.lit(3).alias("offset"), F.lit("en").alias("lang"))


def empty(spark):
    return odd(spark).limit(0)


def groups(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 500 + k) for k in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == groups(pairs, nodes)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_tokens_equal_the_library(path):
    ours, theirs = tokens.PieceTokenizer(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    assert ours.rule != "whole"
    rng, alphabet = random.Random(2), "abst 'rsvelldm  \n\t\ré9Σİ²ßſ!…́中’​Å\x1c\x85 😀𝔘"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", "it's we'RE they're ''s\n's", "<|endoftext|> <|startoftext|>"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, off = ours.ids(part)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [e.ids for e in theirs.encode_batch(part, add_special_tokens=False)]


# 1


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries()["op1_language"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_brute_and_corners(spark):
    text = "The cat, the HAT. Übermut 42"
    padded = "_".join(["", *re.findall(r"[^\W\d_]+", text.lower()), ""])
    want = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_")
    codes, counts = language._grams(text)
    got = {"".join(chr(c) if c else "_" for c in ((code >> s) & 0x1FFFFF for s in ((42, 21, 0) if code >> 42 or code > 1 << 42 else (21, 0) if code >> 21 else (0,)))): n for code, n in zip(codes.tolist(), counts.tolist(), strict=True)}
    assert sum(got.values()) == sum(want.values())
    language.PART, old = 7, language.PART
    try:
        again = language._grams(text)
    finally:
        language.PART = old
    assert (again[0] == codes).all() and (again[1] == counts).all()
    profiles = language.learn(odd(spark))
    rows = language.identify(odd(spark), profiles).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows} == {"en", "und"}
    assert all((r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in rows)
    assert language.identify(odd(spark), language.learn(empty(spark))).where("lang_pred <> 'und'").count() == 0


# 2


def test_language_of_few_texts_with_many_copies(spark):
    few = [(f"lang{k}", f"{a}{b} {b}{c} {c}{a}{a}") for k in range(8) for a, b, c in [("abcdefgh"[k], "ijklmnop"[k], "qrstuvwx"[k])]]
    rows = [x for x in few for _ in range(400)] + [("many", f"zz{i} yy{i * 7} text") for i in range(400)] + [("many", "ččč")] * 3000
    found = language.learn(spark.createDataFrame(rows, "lang string, text string"), per_language=40)
    assert found.names == sorted({x for x, _ in rows})
    assert all(found.predict(text)[0] == lang for lang, text in few)
    assert found.predict("ččč")[0] == "many" or not np.isin(language.profile("ččč"), found.codes).any()
    # one text of many copies doesn't make the profile
    assert np.isin(language.profile("text"), found.codes).any()


def test_licences(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"), ("a/b/x.py", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("d/e.py", "none"), ("a/b/c/d/deep.py", None), (None, "n"), ("NOTICE", "Licensed under CC BY-NC 4.0."), ("top.py", "t")]
    files = spark.createDataFrame([(i, p, t, 9) for i, (p, t) in enumerate(rows)], "key int, path string, text string, licence int")
    got = {r["path"]: (r["own_licence"], r["licence"], r["inherited_from"], r["distance"]) for r in licences.resolve(files).collect()}
    assert got["a/LICENSE"] == ("MIT", "MIT", None, 0) and got["a/b/c.py"] == (None, "MIT", "a", 2) and got["a/b/x.py"][1] == "Apache-2.0"
    assert got["a/b/c/d/deep.py"] == (None, "MIT", "a", 4) and got["d/e.py"] == (None, "CC-BY-NC-4.0", "", 2) and got["top.py"][1:] == ("CC-BY-NC-4.0", "", 1) and got[None][1] is None
    assert licences.resolve(files.limit(0)).count() == 0


def test_wrapped_licences():
    import textwrap

    m = licences.Matcher()
    mit, gpl = (next(t for _, t in licences.TEMPLATES if t.startswith(x) and len(t) > 220) for x in ("Permission is hereby", "This program is free"))
    mit = max((t for _, t in licences.TEMPLATES if t.startswith("Permission is hereby")), key=len)
    rest = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
    whole = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + textwrap.fill(mit, 78) + "\n\n" + rest
    assert m.scan(whole)[0] == "MIT"
    header = textwrap.fill(gpl, 70, initial_indent="# ", subsequent_indent="# ")
    assert m.scan("#!/usr/bin/env python\n#\n" + header + "\n#\n\nimport os\n" + "print(os.name)\n" * 40)[0] == "GPL-3.0"
    assert m.scan("no licence is named here\nfor the software\nof the program")[0] is None


def test_licence_needles_lose_nothing():
    m = licences.Matcher()
    rng, vocabulary = random.Random(3), sorted({w for _, t in licences.TEMPLATES for w in licences.words(t)})
    for _ in range(3000):
        _, template = rng.choice(licences.TEMPLATES)
        line = " ".join(w for w in template.split() if rng.random() < 0.8) + " " + " ".join(rng.sample(vocabulary, 2))
        if m.score(line)[0]:
            assert any(n in line.lower() for n in m.needles)
    assert all(m.score(t)[1] > 0.999 for _, t in licences.TEMPLATES)


# 3


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_by_brute_force(sizes):
    bins, offsets = packing.sum_of_squares(np.array(sizes, int), 64)
    fill: dict[int, int] = {}
    for s, b, o in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        counts = Counter(64 - f for f in fill.values() if f < 64)

        def cost(gap, s=s, counts=counts):
            c = counts.copy()
            c[gap] -= gap != 64
            c[gap - s] += gap - s > 0
            return sum(n * n for n in c.values())

        choices = [g for g in {64, *counts} if g >= s]
        assert o == fill.get(b, 0) and cost(64 - o) == min(map(cost, choices))
        fill[b] = o + s
    assert all(f <= 64 for f in fill.values())


def test_packing(spark, sf_dir):
    got = queries()["op3_packing"](spark, sf_dir).toPandas()
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    library = Tokenizer.from_file(WORDS)
    want = {}
    for i, text in docs.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, p): (p * 4096, len(ids[p * 4096 :][:4096]), zlib.crc32(ids[p * 4096 :][:4096].tobytes())) for p in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= got.length.sum() / 4096 * 1.02 + 2


def test_packing_corners(spark):
    got = packing.pack_documents(odd(spark), WORDS, 64, 1).toPandas()
    assert got[got.doc_id == 2].length.tolist() == [1] and len(got[(got.doc_id == 1)]) == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


# 4


def test_lookup_table():
    names, size = ["a", "b", "c", "d", "e"], 101
    table = sharding.lookup_table(names, size)
    prefer = []
    for n in names:
        o, s = (int(hashlib.md5(f"{n}/{k}".encode()).hexdigest()[:15], 16) for k in ("offset", "skip"))
        prefer.append([(o % size + j * (s % (size - 1) + 1)) % size for j in range(size)])
    want = [None] * size
    for turn in range(size):
        want[next(x for x in prefer[turn % 5] if want[x] is None)] = turn % 5
    assert table == want and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:-1], size)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 4) < 0.3 * size
    assert sharding.table_size(64) == 6421


def test_sharding_corners(spark, tmp_path):
    names = ["one", "it's"]
    rows = sharding.place(odd(spark), "doc_id", names).collect()
    assert len(rows) == len(ODD) and {r["shard"] for r in rows} <= set(names) and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(empty(spark), "doc_id", names).count() == 0
    sharding.write_shards(odd(spark), "doc_id", names, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# 5


def brute_containment(text, item):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = split(text), split(item)
    k = min(5, len(b))
    if not k:
        return 0.0
    own = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return len(own & {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}) / len(own)


def test_containment_loses_nothing(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 20, 40, 90])))) for i in range(60)] + [(90, None), (91, "!!")]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(200))
        item = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.randrange(4)):
            if item:
                item[rng.randrange(len(item))] = "x"
        docs.append((d, ", ".join(words) + " \n" + "; ".join(item)))
    docs += [(100, None), (101, "")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in found}
    want = {(d, i): c for d, t in docs for i, x in items if (c := brute_containment(t, x)) >= 0.8 - 1e-9}
    assert got == pytest.approx(want) and got


def test_containment_corners(spark):
    items = spark.createDataFrame([(1, "cat sat on the mat"), (2, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(odd(spark), items).collect()) == [(1, 1), (1, 1)]
    assert decontamination.contaminated(empty(spark), items).count() == 0 and decontamination.contaminated(odd(spark), items.limit(0)).count() == 0
    kept = decontamination.without_contaminated(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 2


# 6


def test_shards_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(BYTES)
    manifest, entries = sstable.token_shards(odd(spark).repartition(3), BYTES, "file://" + str(tmp_path / "sst"))
    rows = entries.orderBy("start").collect()
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, text) in zip(rows, ordered, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    readers = [sstable.Reader(r["path"]) for r in manifest.collect()]
    assert sum(len(x.get(1)) for x in readers) == 2 and sum(len(x.get(99)) for x in readers) == 0 and sum(len(x.get(None)) for x in readers) == 1
    assert sstable.token_shards(empty(spark), BYTES, str(tmp_path / "none"))[1].count() == 0


def test_table_lookup_over_many_blocks(tmp_path):
    with open(tmp_path / "t.sst", "wb") as out:
        w = sstable.Writer(out, 2)
        for k in range(-5000, 5000, 2):
            w.add(sstable.encode_key(k), np.arange(abs(k) % 300))
        w.close()
    with sstable.Reader(str(tmp_path / "t.sst")) as r:
        assert len(r.blocks) > 3 and r.n_docs == 5000
        assert all(len(r.get(k)[0]) == abs(k) % 300 for k in range(-5000, 5000, 446)) and not r.get(1)
        assert sum(r.may_have(sstable.encode_key(k)) for k in range(-4999, 5000, 2)) < 150
        assert [k for k, _, _ in r] == list(range(-5000, 5000, 2))


# 7


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("count", [2, 3, 4])
def test_hamming_links(spark, count, monkeypatch):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(40)}
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for f in list(fps) for _ in range(4)}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    monkeypatch.setattr(simhash, "best_count", lambda n, r: count)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4).collect()}
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4}


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries()["op7_simhash"](spark, sf_dir).collect()}
    fps = {d: brute_fingerprint(t) for d, t in docs}
    want = groups([(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4], fps)
    assert all(got[d]["fingerprint"] == f"{fps[d]:016x}" and got[d]["component_id"] == want[d] for d in fps) and len(got) == len(docs)


def test_near_duplicate_corners(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(rows) == len(ODD) and {r["doc_id"] for r in zero} == {2, 3, 4} and {r["component_id"] for r in zero} == {2}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(odd(spark)).columns == odd(spark).columns


# 8


def brute_lines(docs):
    norm = lambda line: re.sub(r"[\W_]+", " ", line.lower()).strip()
    places = [(d, i, norm(line)) for d, t in docs if t is not None for i, line in enumerate(t.split("\n"))]
    places = [p for p in places if len(p[2].split(" ")) >= 5]

    def bits(line):
        c = np.zeros(64, int)
        for w in line.split(" "):
            c += [xxhash.xxh64_intdigest(w.encode(), 42) >> b & 1 for b in range(64)]
        return sum(1 << b for b in range(64) if c[b] * 2 > len(line.split(" ")))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    kinds = sorted({p[2] for p in places})
    prints = {k: bits(k) for k in kinds}
    pairs = []
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                u, v = (a, b) if max(len(a), len(b)) <= 256 else (a.split(" "), b.split(" "))
                if distance(u, v) <= 0.2 * max(len(u), len(v)) + 1e-9:
                    pairs.append((a, b))
    part = groups(pairs, kinds)
    first = {}
    for p in sorted(places, key=lambda p: (p[0], p[1])):
        first.setdefault(part[p[2]], p[:2])
    return {p[:2] for p in places if first[part[p[2]]] != p[:2]}, len(pairs)


def test_duplicate_lines(spark):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    pool = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 12, 30, 60]))) for _ in range(30)]
    docs = []
    for d in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(vocabulary, k=9)) for _ in range(rng.randrange(1, 8))]
        lines = [" ".join(w if rng.random() > 0.02 else w + "s" for w in x.split(" ")) if rng.random() < 0.5 else x.upper() + "!" for x in lines]
        docs.append((d, "\n".join(lines)))
    docs += [(50, None), (51, "")]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, fuzzy = brute_lines(docs)
    assert got == want and fuzzy > 5


def test_line_corners(spark):
    rows = line_dedup.dedup_lines(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["n_lines"] == 0 and r["text"] is None for r in rows if r["doc_id"] == 2)
    assert all(r["n_removed"] == 0 for r in rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "one two three four five\nx"), (2, "ONE two, three four five\ny"), (None, "one two three four five")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(twice).collect()}
    assert got == {None: "one two three four five", 1: "x", 2: "y"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def removed(spark, tmp_path, texts):
    """Lines that op8_line_dedup removes from each text."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r["n_removed"] for r in queries()["op8_line_dedup"](spark, str(tmp_path)).collect()}


def test_line_query_finds_similar_lines_of_every_length(spark, tmp_path):
    rng = random.Random(81)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    texts, copies = [], {}
    for n in [*range(5, 41), 60, 90, 150] * 4:
        words = [word() for _ in range(n)]
        texts.append(" ".join(words))
        k = rng.randrange(n)
        changed = rng.choice([word(), "q" + words[k][1:]])
        copy = " ".join([*words[:k], changed, *words[k + 1 :]])
        if edits(texts[-1], copy) <= 0.2 * max(len(texts[-1]), len(copy)):
            copies[len(texts)] = n
            texts.append(copy)
    got = removed(spark, tmp_path, texts)
    assert len(copies) > 140 and all(got[i] == 0 for i in got if i not in copies)
    for lo, hi in ((5, 9), (10, 14), (15, 24), (25, 200)):
        mine = [got[i] for i, n in copies.items() if lo <= n <= hi]
        assert sum(mine) >= 0.97 * len(mine), (lo, hi)


def test_long_lines_are_held_to_word_edits(spark):
    a = [f"w{i}" for i in range(900)]
    near = [f"z{i}" if i % 33 == 0 else w for i, w in enumerate(a)][:-2]
    edge, far = ([f"z{i}" if i < n else w for i, w in enumerate(a)] for n in (180, 181))
    rows = [(k, " ".join(x), " ".join(y)) for k, (x, y) in enumerate([(a, near), (a, edge), (a, far)])]
    got = dict(spark.createDataFrame(rows, "k int, x string, y string").select("k", line_dedup.similar("x", "y")).collect())
    assert got == {0: True, 1: True, 2: False}


def test_line_query_holds_long_lines_to_words_alone(spark, tmp_path):
    rng = random.Random(82)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    texts = []
    for _ in range(30):
        words = [word(5) for _ in range(64)] + [word(18) for _ in range(16)]
        cut = " ".join([*words[:64], *(word(2) for _ in range(8))])  # 16 edits of 80 words, and under 0.7 of the characters
        assert len(cut) < 0.75 * len(" ".join(words))
        texts += [" ".join(words), cut]
    got = removed(spark, tmp_path, texts)
    assert all(got[i] == 0 for i in range(0, 60, 2)) and sum(got[i] for i in range(1, 60, 2)) >= 29


def test_line_query_takes_short_lines(spark, tmp_path):
    texts = ["All rights reserved\nand ornd\n\n}", "x y\nall rights reserved.\nAnd ornd\n\n}", "all rights reservd", "reproduction", "reproductian", "cat", "cut", "left right", "no such line"]
    assert removed(spark, tmp_path, texts) == {0: 0, 1: 2, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0}


# 9

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    count = lambda m: len(re.sub("[^0-9]", "", m.group()))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= count(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= count(m) <= 15]


@given(st.text(alphabet="0123411.. --+()@ab_%é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii_query_and_added_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = pii.learn(pii.sample_regions(docs), rounds=2)
    texts = dict(docs.collect())
    for r in pii.find(docs, model).collect():
        base = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))
    merged = "call +1 (269) 555-3296 4539578763621486 now"  # one run of digits for the base rule
    assert ("card", 23, 39) in model.spans(merged)
    assert pii.find(odd(spark), model).count() == len(ODD) and pii.find(empty(spark), model).count() == 0 and pii.learn([]).spans("x@y.zz") == [("email", 0, 6)]


def test_pii_regions_hold_whole_spelled_addresses():
    tail = " and so on for a while"
    for entity in ("jane.roe [at] example [dot] com", "jane.roe[at]mail [dot] example [dot] com", "jane.roe (at) mail (dot) example (dot) co (dot) uk", "jane.roe at example dot com", "jane.roe@example.com", "555/123/4567"):
        text = "please write to " + entity + tail
        a = text.index(entity)
        assert any(lo <= a and a + len(entity) <= hi for lo, hi in pii.regions(text)), entity
    assert pii.regions("we met at noon, a polka dot dress; 1/2") == []
    rng = random.Random(9)
    name = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    samples = [f"write to {name()}.{name()}@{name()}.{rng.choice(['com', 'org', 'mail.net'])} or" for _ in range(150)] + [f"call +1 {rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)} now" for _ in range(150)]
    model = pii.learn(samples)
    for entity in ("jane.roe [at] example [dot] com", "jane.roe[at]mail [dot] example [dot] com", "jane.roe at example dot com"):
        text = "please write to " + entity + " or"
        assert model.spans(text) == [("email", 16, 16 + len(entity))], entity


# 10


def brute_vectors(rows):
    ids = [r[0] for r in rows]
    fine = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    pairs = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    part = groups(pairs, range(len(rows)))
    links = Counter(x for p in pairs for x in p)
    return [(ids[k], links[k], min(ids[j] for j in part if part[j] == part[k])) for k in range(len(rows))]


def test_vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((30, 24))
    rows = [(k, (centres[k % 30] * (1 + k % 3) + rng.standard_normal(24) * 0.18).astype(np.float32).tolist()) for k in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [float("inf")] + [1.0] * 23), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, rows[0][1]), (508, rows[0][1]), (509, [None] + [1.0] * 23)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute_vectors(rows)
    assert {r["vec_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (c, i == c) for i, _, c in want}
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(n for _, n, _ in want) and {r["vec_id"]: r["n_links"] for r in got} == {i: n for i, n, _ in want}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# the pipeline and the queries' SQL


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        before, docs = docs, spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0.5 * before.count() < docs.count() <= before.count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    assert not any(brute_containment(r["text"], i["text"]) >= 0.8 for r in docs.collect() for i in items)
    prints = [brute_fingerprint(r["text"]) for r in docs.collect()]
    assert not any(bin(a ^ b).count("1") <= 4 for i, a in enumerate(prints) for b in prints[i + 1 :])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_links_by_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(41)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 20, 80, 250]))]
        for n in (0, 1, 2, 4, 7):  # words replaced
            copy = list(base)
            for i in rng.sample(range(len(base)), min(n, len(base) - 1)):
                copy[i] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(copy).title())
    texts += ["", " ", None, texts[0].upper()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    part, first = groups(pairs, range(len(sets))), {}
    for i in range(len(sets)):
        first.setdefault(part[i], i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    got = [r["doc_id"] for r in stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(first.values()) and sum(0.8 <= jaccard(sets[i], sets[j]) < 0.95 for i, j in pairs) > 10
    assert stage(spark, empty(spark), "").count() == 0 and stage(spark, odd(spark), "").columns == odd(spark).columns


def test_pipeline_looks_for_fingerprints_first(spark, monkeypatch):
    from pagewright.llm import shingle_dedup

    asked, radii = [], []

    def counted(pairs, fetch, same, f=shingle_dedup._verified):
        asked.append({(r["a"], r["b"]) for r in pairs.collect()})
        return f(pairs, fetch, same)

    def searched(fps, radius, f=shingle_dedup.star_links):
        radii.append(radius)
        return f(fps, radius)

    monkeypatch.setattr(shingle_dedup, "_verified", counted)
    monkeypatch.setattr(shingle_dedup, "star_links", searched)
    base = [f"w{i}" for i in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"x{i}" for i in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingle_dedup.keep_one(docs).collect()) == [0, 2]
    assert radii == [4] and [len(pairs) for pairs in asked] == [1]


def test_common_shingles_are_the_last_keys(spark):
    from pagewright.llm import shingle_dedup

    shared = [f"s{i}" for i in range(30)]
    texts = [" ".join([*(f"d{k}x{i}" for i in range(40)), *shared]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = shingle_dedup.common_shingles(docs)
    assert set(common[0].tolist()) == set(shingle_dedup.shingles(" ".join(shared)).tolist())
    rows = shingle_dedup.shingle_sets(docs, 5, 0.8, common).collect()
    assert all(len(r["keys"]) > 10 and not set(r["keys"]) & set(common[0].tolist()) for r in rows)


@pytest.mark.parametrize("name", ["op4_sharding", "op5_decontamination"])
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = c.sql(oracle_sql()[name]).df(), queries()[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_licences_by_brute_force():
    """Cosines over every unit, computed apart from the matcher's postings and needles."""
    from math import log

    bags = [Counter(re.findall(r"[^\W_]+", t.lower())) for _, t in licences.TEMPLATES]
    held = Counter(w for b in bags for w in b)
    most = 2 * max(sum(b.values()) for b in bags)

    def vector(text):
        bag = Counter(re.findall(r"[^\W_]+", text.lower()))
        weighed = {w: n * (1 + log(len(bags) / held[w]) if w in held else 1 + log(len(bags))) for w, n in bag.items()}
        norm = sum(x * x for x in weighed.values()) ** 0.5
        return {w: x / norm for w, x in weighed.items()} if norm else {}

    templates = [vector(t) for _, t in licences.TEMPLATES]

    def best(text):
        v = vector(text)
        scores = [sum(x * t.get(w, 0) for w, x in v.items()) for t in templates]
        top = max(scores)
        return (licences.TEMPLATES[scores.index(top)][0], top) if top >= 0.8 else (None, 0.0)

    def brute(text):
        lines = text.split("\n")
        n_words = [len(re.findall(r"[^\W_]+", x)) for x in lines]
        units = [(i, i) for i in range(len(lines))]
        units += [(i, j) for i in range(len(lines)) for j in range(i + 1, min(len(lines), i + licences.WINDOW)) if n_words[i] and n_words[j] and sum(n_words[i : j + 1]) <= most]
        return max([best("\n".join(lines[a : b + 1])) for a, b in units] + [best(text)], key=lambda x: x[1])

    rng, m = random.Random(22), licences.Matcher()
    vocabulary = ["alpha", "beta", "gamma", "the", "of", "to", "import", "x1", "return"]
    for _ in range(150):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 14))]
        name, template = rng.choice(licences.TEMPLATES)
        words = [w for w in template.split() if rng.random() < rng.choice([0.75, 0.95, 1.0])]
        wrapped = [f"# {' '.join(words[i : i + 9])}" for i in range(0, len(words), 9)]
        at = rng.randrange(len(lines) + 1)
        text = "\n".join(lines[:at] + wrapped + lines[at:])
        want = brute(text)
        got = m.scan(text)
        assert got[1] == pytest.approx(want[1]) and (got[0] is None) == (want[0] is None), text


def test_ancestor_licences_by_brute_force(spark):
    rng = random.Random(23)
    statements = ["Released under the MIT License.", "Licensed under the BSD 3-Clause License.", "Licensed under CC BY 4.0."]
    rows = []
    for k in range(300):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5)))
        kind = rng.random()
        name, text = (f"LICENSE{k}", rng.choice(statements) + "\nmore words of it") if kind < 0.05 else (f"f{k}.py", rng.choice(statements)) if kind < 0.08 else (f"f{k}.py", rng.choice(statements) + "\n" + "code " * 20) if kind < 0.2 else (f"f{k}.py", rng.choice(["code only", "", None, "the of"]))
        rows.append((k, f"{folder}/{name}" if folder else name, text))
    rows += [rows[0], (900, None, None), (901, "deep/x.py", "word " * 40_000)]
    files = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "key int, path string, text string, folder string, passed string")
    m = licences.Matcher()
    folder_of = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    passing = {}
    for _, path, text in rows:
        name, score, _, whole = m.scan(text)
        if name and path and (whole or path.rsplit("/", 1)[-1].startswith("LICENSE")):
            passing.setdefault(folder_of(path), []).append((-score, name))
    want = Counter()
    for key, path, text in rows:
        own = m.scan(text)[0]
        found = (own, None, 0) if own else (None, None, None)
        if not own and path is not None:
            home, up = folder_of(path), 1
            while True:
                if home in passing:
                    found = (min(passing[home])[1], home, up)
                    break
                if not home:
                    break
                home, up = folder_of(home), up + 1
        want[(key, *found)] += 1
    got = Counter((r["key"], r["licence"], r["inherited_from"], r["distance"]) for r in licences.resolve(files).collect())
    assert got == want and sum(n for (_, _, home, _), n in want.items() if home) > 30
    header = licences.resolve(files.where("path LIKE '%.py' AND text LIKE '%code code%'"))
    assert header.where("distance > 0").count() == 0


# repeated rows, crowds, several blocks


def test_repeated_documents_keep_their_own_lines(spark):
    a, b = "the same line of five words here", "another line of some other words"
    docs = spark.createDataFrame([(7, a), (7, b), (1, a), (None, b), (None, None)], "doc_id long, text string").withColumn("gone", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("d", F.lit(3)).withColumn("g", F.lit(4))
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs, 1, None).collect())
    assert got == Counter([(7, ""), (7, ""), (1, a), (None, b), (None, None)])
    prints = line_dedup.line_fingerprints(docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text")))
    assert prints.groupBy("k1", "k2").agg(F.countDistinct("simhash").alias("n")).where("n > 1").count() == 0


def test_a_crowd_of_different_near_copies(spark, monkeypatch):
    from pagewright.llm import linking

    rng = random.Random(84)
    base = [f"word{k}" for k in range(30)]
    texts = []
    for k in range(2000):
        copy = list(base)
        for i in rng.sample(range(30), 2):
            copy[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = []

    def counted(pairs, fetch, same, f=linking._verified):
        rows.append(pairs.count())
        return f(pairs, fetch, same)

    monkeypatch.setattr(linking, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = line_dedup.dedup_lines(docs, 1, None).where("n_removed = 0").collect()
    assert [r["doc_id"] for r in kept] == [0] and sum(rows) < 40 * len(texts)


def test_pairs_are_verified_in_parts(spark, monkeypatch):
    from pagewright.llm import linking

    written = []
    monkeypatch.setattr(linking, "VERIFIED_AT_ONCE", 20)
    monkeypatch.setattr(linking, "cut", lambda df, f=linking.cut: written.append(f(df)) or written[-1])
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(a + 1, 20)], "a long, b long")
    found = linking._verified(pairs, lambda asked: linking.cut(asked.selectExpr("lid", "lid % 5 AS payload")), "x = y")
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in range(20) for b in range(a + 5, 20, 5)} and len(written) == 2 + 10


def test_tables_leave_no_shuffle_files(spark):
    from pagewright.llm import storage

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    left = lambda: sum(len(list(Path(d).rglob("shuffle_*.data"))) for d in folders)
    before = left()
    assert storage.cut(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()).columns == ["k", "count"]
    for _ in range(50):
        if left() > before:
            time.sleep(0.1)
    assert left() <= before


def test_star_links_have_the_components_of_all_links(spark, monkeypatch):
    rng = random.Random(71)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for c in centres for _ in range(60)}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    found = [tuple(r) for r in simhash.star_links(df, 4).collect()]
    assert groups(found, signed) == groups(pairs, signed) and set(found) <= set(pairs) and len(found) < len(pairs) / 2


def test_vectors_over_many_places_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET", 64)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((120, 48))
    rows = [(k, (centres[k % 120 if k % 3 else 0] + rng.standard_normal(48) * 0.16).astype(np.float32).tolist()) for k in range(900)]
    tables, count = embeddings.table_shape(len(rows), 0.95)
    assert tables > 2 and count >= 3
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = {i: n for i, n, _ in brute_vectors(rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values()) > 10_000


def test_licence_needles_hold_as_words():
    m = licences.Matcher()
    rng, vocabulary = random.Random(33), sorted({w for _, t in licences.TEMPLATES for w in licences.words(t)})
    for _ in range(3000):
        _, template = rng.choice(licences.TEMPLATES)
        line = " ".join(w for w in template.split() if rng.random() < 0.8) + " " + " ".join(rng.sample(vocabulary, 2))
        assert m.may_match(line.lower()) or m.score(line)[0] is None


def test_profiles_and_distance_by_brute_force(spark):
    """Ranks, out-of-place distance, ties and score against plain dictionaries."""
    rng = random.Random(11)
    alphabet = {"xa": "abcdefg hij", "xb": "cdefghijkl mn", "xc": "opqrstu vwx", "xd": "opqrstu vwx"}
    rows = [(k, "".join(rng.choices(alphabet[name], k=rng.randrange(5, 80))), name) for k, name in enumerate(sorted(alphabet) * 30)]
    rows += [(900, None, "xa"), (901, "zzz", None), (902, "1 2 3", "xb")]

    learned = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    total = {}
    for _, text, name in rows:
        if text is not None and name is not None:
            codes, counts = language._grams(text)
            mine = total.setdefault(name, Counter())
            for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                mine[c] += n
    want = {name: [c for c, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[: language.PROFILE]] for name, counts in total.items()}
    assert learned.names == sorted(want)
    for text in [r[1] for r in rows[:40]] + ["", None, "qqq", "abc opq", "ž", "7"]:
        codes, counts = language._grams(text or "")
        top = [c for c, _ in sorted(zip(codes.tolist(), counts.tolist(), strict=True), key=lambda p: (-p[1], p[0]))][: language.PROFILE]
        if not top:
            assert learned.predict(text) == ("und", 0.0)
            continue
        apart = {name: sum(min(abs(profile.index(c) - i), language.PROFILE) if c in profile else language.PROFILE for i, c in enumerate(top)) for name, profile in want.items()}
        best = min(sorted(apart), key=apart.get)
        assert learned.predict(text) == (best, pytest.approx(1 - apart[best] / (language.PROFILE * len(top))))


def test_pipeline_runs_whole_and_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(51)
    words = [f"{a}{b}{c}" for a in "bdklmnrst" for b in "aeiou" for c in "bdlmnrst"]
    line = lambda n=12: " ".join(rng.choices(words, k=n))
    bodies = ["\n".join(line(rng.randrange(8, 30)) for _ in range(4)) for _ in range(12)]
    shared, item = line(20), line(25)
    docs = [(k, b, "xx", "web", len(b)) for k, b in enumerate(bodies)]
    docs += [(20, bodies[0] + "\n" + line(3), "xx", "web", 9), (21, bodies[1], "xx", "web", 9), (22, bodies[2] + "\n" + shared, "xx", "web", 9), (23, line(40) + "\n" + shared, "xx", "web", 9), (24, line(30) + " " + item, "xx", "web", 9)]
    docs += [(25, None, "xx", None, 0), (26, "", None, "web", 0), (27, "12 34", "xx", "web", 5), (None, line(15), "xx", "web", 1), (28, line(60_000), "xx", "web", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = {None if i != i else int(i) for i in packed.doc_id.astype(float)}
    assert left >= {*range(12), 22, 23, 28, None} - {0, 1, 2} and not left & {21, 24, 25, 26, 27}
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    for name, stage in corpus_pipeline.STAGES:
        for table in (odd(spark), empty(spark)):
            clash = table.withColumn("lang_pred", F.lit("en")).withColumn("gone", F.lit(1)).withColumn("document", F.lit(2))
            out = stage(spark, clash, str(tmp_path))
            assert name == "packing" or out.columns == clash.columns, name
            assert (out.count() > 0) == (table.limit(1).count() > 0)


def test_python_workers_get_few_rows_of_a_table_at_once(spark):
    from pagewright.llm import storage

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(storage.BATCH)
    seen = [r["n"] for r in storage.cut(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")).collect()]
    assert sum(seen) == 5000 and max(seen) <= 1000 and spark.conf.get(storage.BATCH) == before


def test_a_passage_of_many_unlike_lines_makes_few_pairs(spark, monkeypatch):
    from pagewright.llm import linking

    rng = random.Random(85)
    passage = [f"word{k}" for k in range(60)]
    texts = [" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 30))), *passage]) for _ in range(600)]
    texts.append(texts[7].replace("word30", "other"))
    rows = []

    def counted(pairs, fetch, same, f=linking._verified):
        rows.append(pairs.count())
        return f(pairs, fetch, same)

    monkeypatch.setattr(linking, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = line_dedup.dedup_lines(docs, 1, None).where("n_removed = 1").collect()
    assert [r["doc_id"] for r in gone] == [600] and sum(rows) < 2 * len(texts)


def test_what_pairs_are_made_by_holds_for_every_link(spark):
    rng = random.Random(86)
    texts = []
    for n in [6, 12, 30, 60, 90, 200] * 6:
        words = [f"w{rng.randrange(40)}" for _ in range(n)]
        for share in (0, 0.1, 0.19, 0.2, 0.21, 0.3):
            copy = [f"v{rng.randrange(40)}" if rng.random() < share else w for w in words]
            texts.append(" ".join(copy[: max(1, n - rng.randrange(1 + int(share * n / 2)))]))
    lines = spark.createDataFrame([(i, t, len(t), len(t.split(" "))) for i, t in enumerate(texts)], "lid long, payload string, n int, n_words int")
    marked = lines.join(line_dedup.line_marks(lines.select("lid", "payload")), "lid")
    pairs = marked.alias("a").join(marked.alias("b"), F.expr("a.lid < b.lid AND b.lid < a.lid + 6"))
    got = pairs.select(F.expr(line_dedup.may_link(0.8)).alias("may"), line_dedup.similar("a.payload", "b.payload").alias("is"), F.expr("greatest(a.n, b.n) > 256").alias("long")).collect()
    assert all(r["may"] for r in got if r["is"]) and all(r["may"] == r["is"] for r in got if not r["long"])
    assert sum(r["is"] for r in got) > 50 and sum(not r["may"] for r in got if r["long"]) > 50
