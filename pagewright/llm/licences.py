"""License scans (operator 2).

A line, a run of lines (a header, a paragraph), or a whole file, is compared with
licence templates by sparse TF-IDF cosine. A file without a licence of its own
takes that of the nearest ancestor directory with a licence file, by joins on the
paths of directories. A licence file is one that is named so, or has no words but
the statement; a header in one file licenses no other.

Most text is never tokenised: a line can only reach the threshold if it holds
one of the few heaviest words of a template (without them the cosine can't get
there), so lines are looked up for those words first. That loses nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, small_side

THRESHOLD = 0.8
#: Lines of a wrapped statement, at most.
WINDOW = 16

# Licence statements as they are commonly written, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


class Matcher:
    """TF-IDF vectors of the templates; idf = 1 + ln(templates / templates with the word), the most for unknown words."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        bags = [words(t) for _, t in templates]
        held = Counter(w for b in bags for w in b)
        self.rare = 1 + log(len(bags))
        self.idf = {w: 1 + log(len(bags) / n) for w, n in held.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        needles: set[str] = set()
        for k, bag in enumerate(bags):
            vector = self._vector(bag)
            left = 1.0
            # long words first among the heavy ones: they are rare in other texts
            for w, x in sorted(vector.items(), key=lambda p: (-p[1] * len(p[0]), p[0])):
                self.postings.setdefault(w, []).append((k, x))
                if sqrt(max(0.0, left)) >= threshold:
                    needles.add(w)
                    left -= x * x
        self.needles = sorted(needles)
        self._long = [w for w in self.needles if len(w) > 4]
        self._short = re.compile(rf"(?<![^\W_])(?:{'|'.join(w for w in self.needles if len(w) <= 4) or '(?!)'})(?![^\W_])")
        self.most = 2 * max(map(Counter.total, bags))

    def _vector(self, bag: Counter[str]) -> dict[str, float]:
        got = {w: n * self.idf.get(w, self.rare) for w, n in bag.items()}
        norm = sqrt(sum(x * x for x in got.values()))
        return {w: x / norm for w, x in got.items()}

    def score(self, text: str) -> tuple[str | None, float]:
        """Best template at the threshold or above (ties: first), and its cosine."""
        dots: dict[int, float] = {}
        for w, x in self._vector(words(text)).items():
            for k, y in self.postings.get(w, ()):
                dots[k] = dots.get(k, 0.0) + x * y
        k = min(dots, key=lambda i: (-round(dots[i], 12), i), default=None)
        return (self.names[k], min(1.0, dots[k])) if k is not None and dots[k] >= self.threshold else (None, 0.0)

    def may_match(self, low: str) -> bool:
        """Whether a lower-case text holds a needle, the short ones as whole words."""
        return any(w in low for w in self._long) or bool(self._short.search(low))

    def _windows(self, lines: list[str], hits: list[int]) -> Iterator[tuple[int, int]]:
        """First and last line of every run of 2 to WINDOW lines that holds one of hits, ends in lines with words and has no more words than twice the longest template."""
        sizes: dict[int, int] = {}
        done = -1
        for hit in hits:
            for first in range(max(0, done + 1, hit - WINDOW + 1), hit + 1):
                done, total = first, 0
                for last in range(first, min(len(lines), first + WINDOW)):
                    if last not in sizes:
                        sizes[last] = len(_WORD.findall(lines[last]))
                    total += sizes[last]
                    if total > self.most or not sizes[first]:
                        break
                    if last > first and last >= hit and sizes[last]:
                        yield first, last

    def scan(self, text: str | None) -> tuple[str | None, float, int | None, bool]:
        """Best licence of any line, run of lines or the whole text, its cosine, its first line (-1: the whole text), and whether no word lies outside it."""
        low = (text or "").lower()
        if not self.may_match(low):
            return None, 0.0, None, False
        best: tuple[str | None, float, int | None, int] = (None, 0.0, None, 0)
        lines = text.split("\n")
        hits = [i for i, line in enumerate(lines) if self.may_match(line.lower())]
        units = [(i, i) for i in hits] + list(self._windows(lines, hits))
        for first, last in units:
            name, value = self.score("\n".join(lines[first : last + 1]))
            if name and value > best[1]:
                best = name, value, first, last
        name, value = self.score(text) if len(lines) > 1 else (None, 0.0)
        if name and value > best[1]:
            best = name, value, -1, len(lines) - 1
        name, value, first, last = best
        whole = name is not None and not any(_WORD.search(x) for x in (*lines[: max(0, first)], *lines[last + 1 :]))
        return name, value, first, whole


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (key, path, text) -> key, path, licence, score, is_file.

    is_file: the path names a licence file, or the text has no words but the
    statement; its directory then passes the licence on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        named = re.compile(r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$")
        for batch in batches:
            got = [matcher.scan(t) for t in batch.column(2).to_pylist()]
            paths = batch.column(1).to_pylist()
            ends = [bool(name and (whole or p and named.search(p))) for (name, _, _, whole), p in zip(got, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(ends, pa.bool_())],
                names=["key", "path", "licence", "score", "is_file"],
            )

    return files.select("key", "path", "text").mapInArrow(run, f"key {files.schema['key'].dataType.simpleString()}, path string, licence string, score double, is_file boolean")


def resolve(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (key, path, text) -> key, path, own_licence, score, licence, inherited_from, distance.

    distance is 0 for an own licence, else how many directories up the licence
    lies (its directory: inherited_from; the root is ''). Of several licence
    files in a directory the one with the highest score counts, then the first by
    licence. Null, empty and blank texts have no own licence and inherit like
    others; texts of any length are read whole; null paths inherit nothing;
    repeated rows stay rows; other columns aren't looked at; an empty table gives
    an empty result.
    """
    own = cut(own_licences(files, templates, threshold))
    folder = F.expr("CASE WHEN instr(path, '/') = 0 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END")
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("licence").alias("licence")))
    folders = own.where("is_file AND path IS NOT NULL").groupBy(folder.alias("folder")).agg(best.alias("best")).select("folder", F.col("best.licence").alias("passed"))
    folders = small_side(folders)
    # folders of files without a licence, once each, with all their ancestors
    needing = own.where("licence IS NULL AND path IS NOT NULL").select(folder.alias("home")).distinct()
    up = needing.select("home", F.posexplode(F.expr("transform(sequence(size(split(home, '/')), 0, -1), i -> array_join(slice(split(home, '/'), 1, i), '/'))")).alias("up", "folder"))
    # the root lies above every folder: its one row is joined apart
    found = up.where("folder <> ''").join(folders.where("folder <> ''"), "folder")
    found = found.unionByName(up.where("folder = ''").join(F.broadcast(folders.where("folder = ''")), "folder"))
    nearest = found.groupBy("home").agg(F.min(F.struct("up", "folder", "passed")).alias("near"))
    nearest = small_side(nearest.select("home", "near.up", "near.folder", "near.passed"))
    out = own.withColumn("home", F.when(F.col("licence").isNull(), folder)).join(nearest, "home", "left")
    return out.select(
        "key", "path", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "passed").alias("licence"),
        F.col("folder").alias("inherited_from"), F.when(F.col("licence").isNotNull(), 0).otherwise(F.col("up") + 1).alias("distance"),
    )
