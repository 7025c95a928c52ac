"""Fuzzy line deduplication (operator 8), with DataFrame and SQL functions only.

Lines are normalised, fingerprinted by SimHash over their words, joined on
blocks and verified by edit similarity; of each connected group of lines one
occurrence stays, the first by (doc_id, line number).

Two kinds of blocks. With a distance, pigeonhole blocks of the fingerprints: two
at distance k or less agree in all but k blocks. Lines at edit similarity 0.8
differ in far more bits than blocks can take (README), so without a distance the
blocks are groups of a line's neighbouring words and the fingerprint (of those)
is a filter.

The bit counts of a fingerprint are lanes of a few longs, added up within the
row; equal lines are one row before any pair is looked for, and texts are
fetched for lines that share a block alone.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .linking import find_links
from .storage import cut, drop, small_side

#: Lines of fewer words are never touched.
MIN_WORDS = 5
#: Differing fingerprint bits of linked lines, at most.
DISTANCE = 3
SIMILARITY = 0.8
#: Up to this many characters the edits of two lines are characters, beyond it words, as the cost grows with the square.
EDIT_CHARS = 256
#: Differing bits of two lines of one key, at most: similar lines differ in 13 to 18 of 60 on average, others in 30.
NEAR_BITS = 24
#: The least hashes of neighbouring words that such a fingerprint is made of.
SAMPLE = 24
#: Keys of a line of more than ALL_KEYS words; shorter lines have all their keys.
LONG_KEYS, ALL_KEYS = 8, 12
#: The few words of a line of up to FEW_WORDS decide its fingerprint alone, so its bits say nothing.
FEW_WORDS = 4
#: Lines of FEW_WORDS words or fewer are compared by characters too, up to this many.
SHORT_CHARS = 24


def normalised(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), text: rows equal in doc_id and text are one document."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")


#: SQL of the least hashes of neighbouring words, in order, from the hashes h of the words; the last word's neighbour is the end.
NEIGHBOURS = f"array_distinct(slice(sort_array(zip_with(h, slice(h, 2, size(h)), (x, y) -> x ^ shiftleft(coalesce(y, 0L), 1))), 1, {SAMPLE}))"


def line_keys(norm: str = "norm") -> str:
    """SQL of the keys by which lines are compared, from the hashes h of the words and the least hashes o of neighbouring words.

    A key is two neighbours in the order of the o: a line of more than ALL_KEYS
    words has the LONG_KEYS first of them. Up to ALL_KEYS words it has every one,
    the last and the first being neighbours too, and every three neighbours in the
    order of the words' hashes. A line of FEW_WORDS words or fewer has each word
    with its place too, and up to SHORT_CHARS what is left without any one
    character.
    """
    pairs = f"zip_with(slice(o, 1, {LONG_KEYS}), slice(o, 2, {LONG_KEYS}), (x, y) -> xxhash64(2, x, y))"
    round_pairs = "zip_with(o, concat(slice(o, 2, size(o)), slice(o, 1, 1)), (x, y) -> xxhash64(2, x, y))"
    # w: the distinct hashes of the words in order, bound once
    triples = "transform(array(sort_array(array_distinct(h))), w -> transform(w, (x, i) -> xxhash64(3, x, w[(i + 1) % size(w)], w[(i + 2) % size(w)])))[0]"
    less = f"CASE WHEN length({norm}) <= {SHORT_CHARS} THEN transform(sequence(1, length({norm})), i -> xxhash64(1, overlay({norm} PLACING '' FROM i FOR 1))) ELSE array() END"
    all_keys = f"array_distinct(concat({round_pairs}, {pairs}, {triples}))"
    few = f"array_distinct(concat({round_pairs}, {triples}, transform(h, (x, i) -> xxhash64(4, x, i, size(h))), array(xxhash64(1, {norm})), {less}))"
    return f"CASE WHEN size(h) > {ALL_KEYS} THEN {pairs} WHEN size(h) > {FEW_WORDS} THEN {all_keys} WHEN size(h) > 0 THEN {few} END"


def _votes(hashes: str, n: str, width: int) -> str:
    """SQL of a fingerprint of the hashes (n of them, less than 2^width): counters of that width, as many to a long as 63 bits hold, and one of the last bit of 64."""
    lanes = 63 // width
    ones = sum(1 << i for i in range(0, lanes * width, width))
    lift = f"({(1 << (width - 1)) - 1}L - {n} div 2)"  # takes counters of more than half the hashes to their top bit
    counted = [(c, ones) for c in range(width)] + ([(63, 1)] if lanes * width == 63 else [])
    sums = [(c, m, f"aggregate({hashes}, 0L, (s, x) -> s + (shiftrightunsigned(x, {c}) & {m}L))") for c, m in counted]
    return " | ".join(f"shiftleft(shiftrightunsigned(({s} + {lift} * {m}L) & {m << (width - 1)}L, {width - 1}), {c})" for c, m, s in sums)


def simhash(hashes: str, n: str) -> str:
    """SQL of the fingerprint: each bit is set that is set in over half the hashes. The width of the counters changes the work alone."""
    return f"CASE WHEN {n} < {1 << 7} THEN {_votes(hashes, n, 7)} WHEN {n} < {1 << 21} THEN {_votes(hashes, n, 21)} ELSE {_votes(hashes, n, 63)} END"


def line_fingerprints(docs: DataFrame, keys: bool = False) -> DataFrame:
    """Every line: doc_id, row, line_no (from 0), k1 and k2 (128 bits of its content), n_words, n, simhash; a null text has none.

    A word counts as often as it occurs; n is the normalised length. An empty
    line has no word. keys: the fingerprint has 60 bits and is that of SAMPLE
    hashes of neighbouring words, and line_keys are added.
    """
    lines = _rows(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "row", "line_no", normalised(F.col("line")).alias("norm"))
    hashes = "CASE WHEN norm = '' THEN array() ELSE transform(split(norm, ' '), w -> xxhash64(w)) END"
    lines = lines.withColumn("h", F.expr(hashes).cast("array<bigint>"))
    lines = lines.select("*", F.xxhash64("norm").alias("k1"), F.xxhash64("h").alias("k2"), F.size("h").alias("n_words"), F.length("norm").alias("n"))
    if not keys:
        return lines.withColumn("simhash", F.expr(simhash("h", "cast(n_words AS bigint)"))).drop("norm", "h")
    lines = lines.withColumn("o", F.expr(NEIGHBOURS))
    lines = lines.withColumn("simhash", F.expr(_votes("o", "cast(size(o) AS bigint)", SAMPLE.bit_length())))
    return lines.withColumn("keys", F.expr(line_keys())).drop("norm", "h", "o")


def _blocks(count: int) -> list[int]:
    """Masks of count blocks of the 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(mask: int) -> str:
    return f"{mask - (1 << 64) if mask >> 63 else mask}L"


def _tables(n: int, distance: int) -> list[int]:
    """Masks of which two fingerprints within distance agree in one at least; the number of blocks with the least work."""

    def work(count: int) -> float:
        width = 64 * (count - distance) / count
        return comb(count, distance) * n * (1 + 0.01 * n / 2**width)

    count = min(range(distance + 1, distance + 5), key=work)
    masks = _blocks(count)
    return [sum(masks[i] for i in held) for held in combinations(range(count), count - distance)]


def block_keys(n: int, distance: int) -> str:
    """SQL of the pigeonhole blocks of n fingerprints."""
    return f"array({', '.join(f'xxhash64({k}, simhash & {_signed(m)})' for k, m in enumerate(_tables(n, distance)))})"


def similar(x: str, y: str, similarity: float = SIMILARITY) -> Column:
    """Edit similarity of two normalised lines, 1 - distance / longer length, in characters or in words.

    One character stands for each distinct word of the two lines, of any number.
    """
    wx, wy = "r.x", "r.y"  # bound once: inside a lambda every mention of an expression is computed again
    longer = f"greatest(length({x}), length({y}))"
    more = f"greatest(size({wx}), size({wy}))"

    def allowed(length: str) -> str:
        return f"cast(floor({1 - similarity:.6f} * {length} + 1e-9) AS int)"

    def coded(words: str) -> str:
        # chr wraps at 256; surrogates (from 55296) are no characters
        place = "array_position(known, w)"
        wide = f"decode(unhex(array_join(transform({words}, w -> lpad(hex({place} + CASE WHEN {place} < 55296 THEN 0 ELSE 2048 END), 8, '0')), '')), 'UTF-32')"
        return f"CASE WHEN size(known) > 255 THEN {wide} ELSE array_join(transform({words}, w -> chr({place})), '') END"

    # a word of one line that the other lacks is an edit at least; words that differ in place are so many edits at most
    apart = f"greatest(size(array_except({wx}, {wy})), size(array_except({wy}, {wx})))"
    placed = f"(size({wx}) = size({wy}) AND aggregate(zip_with({wx}, {wy}, (p, q) -> CASE WHEN p = q THEN 0 ELSE 1 END), 0, (s, d) -> s + d) <= {allowed(more)})"
    by_words = f"levenshtein({coded(wx)}, {coded(wy)}, {allowed(more)}) >= 0"
    coded_edits = f"exists(array(array_distinct(concat({wx}, {wy}))), known -> {by_words})"
    long = f"CASE WHEN {placed} THEN true WHEN {apart} > {allowed(more)} THEN false ELSE {coded_edits} END"
    # the characters of words that differ in place are so many edits at most
    placed = f"(size({wx}) = size({wy}) AND aggregate(zip_with({wx}, {wy}, (p, q) -> CASE WHEN p = q THEN 0 ELSE greatest(length(p), length(q)) END), 0, (s, d) -> s + d) <= {allowed(longer)})"
    short = f"CASE WHEN {placed} THEN true ELSE levenshtein({x}, {y}, {allowed(longer)}) >= 0 END"
    return F.expr(f"exists(array(named_struct('x', split({x}, ' '), 'y', split({y}, ' '))), r -> CASE WHEN {longer} <= {EDIT_CHARS} THEN {short} ELSE {long} END)")


def line_marks(texts: DataFrame) -> DataFrame:
    """lid, short (a line of up to EDIT_CHARS, else empty) and words, for longer ones the hashes of their words, the second to fourth time of a word being others."""
    times = "CASE WHEN i > 2 AND s[i - 3] = x THEN hash(x, 3) WHEN i > 1 AND s[i - 2] = x THEN hash(x, 2) WHEN i > 0 AND s[i - 1] = x THEN hash(x, 1) ELSE x END"
    words = f"transform(array(sort_array(transform(split(payload, ' '), w -> hash(w)))), s -> transform(s, (x, i) -> {times}))[0]"
    long = f"length(payload) > {EDIT_CHARS}"
    return texts.select("lid", F.expr(f"CASE WHEN {long} THEN '' ELSE payload END").alias("short"), F.expr(f"CASE WHEN {long} THEN {words} ELSE array() END").alias("words"))


def may_link(similarity: float) -> str:
    """SQL that holds for every two marked lines a and b of that edit similarity: up to EDIT_CHARS it is the similarity, beyond, a word that one line lacks, or has fewer times, is an edit at least."""
    edits, word_edits = (f"cast(floor({1 - similarity:.6f} * greatest(a.{c}, b.{c}) + 1e-9) AS int)" for c in ("n", "n_words"))
    lacks = " AND ".join(f"size(array_except({x}.words, {y}.words)) <= {word_edits}" for x, y in ("ab", "ba"))
    return f"CASE WHEN greatest(a.n, b.n) <= {EDIT_CHARS} THEN levenshtein(a.short, b.short, {edits}) >= 0 ELSE least(a.n, b.n) <= {EDIT_CHARS} OR {lacks} END"


def _texts(docs: DataFrame, kinds: DataFrame, asked: DataFrame) -> DataFrame:
    """lid and payload: the normalised text of the lines asked for, from their first occurrences."""
    places = kinds.select("lid", "first").join(asked, "lid").groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct("first.line_no", "lid")).alias("places"))
    places = small_side(places.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "places"))
    held = _rows(docs).join(places, F.expr("doc_id <=> d AND row = r"))
    line = "transform(array(split(text, '\n', -1)), ls -> transform(places, p -> named_struct('lid', p.lid, 'line', ls[p.line_no])))[0]"
    lines = held.select(F.expr(f"inline({line})")).dropDuplicates(["lid"])
    texts = cut(lines.select("lid", normalised(F.col("line")).alias("payload")))
    drop(places)
    return texts


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, distance: int | None = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row and line_no of every line whose group has an earlier occurrence.

    distance None: the similarity alone says what is linked, and line_keys find
    the pairs to be held to it (two texts of one 64-bit hash count as one there).
    Occurrences are in order of doc_id (null first),
    line number, then the hash of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    by_keys = distance is None
    lines = cut(line_fingerprints(docs, by_keys)).where(f"n_words >= {min_words} AND n_words > 0")
    kinds = lines.groupBy("k1", "k2").agg(F.count("*").alias("copies"), *[F.max(c).alias(c) for c in ("simhash", "n", "n_words")], F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    kinds = cut(kinds.withColumn("lid", F.col("k1") if by_keys else F.monotonically_increasing_id()))
    lengths, bits = f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n)", "bit_count(a.simhash ^ b.simhash)"
    words = f"least(a.n_words, b.n_words) >= {similarity} * greatest(a.n_words, b.n_words)"
    attributes = ["lid", "simhash", "n", "n_words"]
    if by_keys:
        # of equal lines the first alone has keys
        repeats = small_side(kinds.where("copies > 1").select("k1", "first"))
        distinct = lines.join(repeats, "k1", "left").where("first IS NULL OR first <=> struct(doc_id, line_no, row)")
        keyed = distinct.select(F.col("k1").alias("lid"), *attributes[1:], F.explode("keys").alias("v"))
        # lines beyond EDIT_CHARS are held to edits in words, whatever their characters
        near = f"(least(a.n_words, b.n_words) <= {FEW_WORDS} OR {bits} <= {NEAR_BITS}) AND CASE WHEN greatest(a.n, b.n) <= {EDIT_CHARS} THEN {lengths} ELSE {words} END"
    else:
        keyed = kinds.select(*attributes, F.explode(F.expr(block_keys(kinds.count(), distance))).alias("v"))
        near = f"{bits} <= {distance} AND {lengths}"
    links = find_links(keyed, kinds.select(*attributes), near, lambda asked: _texts(docs, kinds, asked), similar("x", "y", similarity), marks=line_marks if by_keys else None, closer=may_link(similarity))
    parts = connected_components(links).withColumnRenamed("node", "lid")
    grouped = cut(kinds.select("lid", "first").join(parts, "lid").select("lid", "component", "first"))
    kept = cut(grouped.groupBy("component").agg(F.min("first").alias("keep")))
    fuzzy = small_side(grouped.join(kept, "component").select("lid", "keep"))
    repeated = kinds.select("lid", "k1", "k2", "copies", "first").join(fuzzy, "lid", "left").where("copies > 1 OR keep IS NOT NULL")
    repeated = small_side(repeated.select("k1", "k2", F.coalesce("keep", "first").alias("keep")))
    return lines.select("doc_id", "row", "line_no", "k1", "k2").join(repeated, ["k1", "k2"]).where("NOT (struct(doc_id, line_no, row) <=> keep)").select("doc_id", "row", "line_no")


def new_name(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, distance: int | None = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with text less its duplicate lines, and n_lines, n_removed (columns of these names are replaced).

    Null text stays null and has no line, empty text is one empty line. Rows equal
    in doc_id and text are one document and are treated alike; rows that share
    only a doc_id (or have none) are documents of their own. Lines of any length
    are taken whole. All other columns are carried; an empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    return with_line_counts(docs, min_words, distance, similarity, "n_lines", "n_removed")


def with_line_counts(docs: DataFrame, min_words: int, distance: int | None, similarity: float, n_lines: str, n_removed: str) -> DataFrame:
    """dedup_lines under other names of its two columns, which docs must not have."""
    gone_name = new_name(docs, "gone")
    gone = duplicate_lines(docs, min_words, distance, similarity).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("lines"))
    gone = small_side(gone.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("lines").alias("g")))
    left = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    joined = left.join(gone, F.expr("i <=> d AND h = r"), "left").select("doc.*", F.col("g").alias(gone_name))
    lines = "split(text, '\n', -1)"
    rest = f"transform(array({lines}), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), {gone_name}), i -> ls[i]), '\n'))[0]"
    columns = [F.expr(f"CASE WHEN {gone_name} IS NULL OR text IS NULL THEN text ELSE {rest} END").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *columns, F.expr(f"CASE WHEN text IS NULL THEN 0 ELSE size({lines}) END").alias(n_lines), F.expr(f"CASE WHEN {gone_name} IS NULL OR text IS NULL THEN 0 ELSE size({gone_name}) END").alias(n_removed)
    )
