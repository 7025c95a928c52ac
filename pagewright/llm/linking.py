"""Links among items that share keys: couples, stars, then whatever stars leave apart.

A key held by two items proposes their pair. Of a key held by more, every item
is first compared with one item of the key, and the groups that result are one
part each; where that linked many, what is left is compared with another item of
the key, and so on. Only items of different parts that still share a key are
compared in pairs. So a large group of near-copies costs rows in proportion to
its size, and no link between different parts is lost. Links inside a part aren't
all returned: they change no component.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import cut, drop, small_side


#: Rounds of stars, at most, and the share of the items left that a round has to link for another to follow. They change the work alone.
ROUNDS, FRUITFUL = 8, 0.01
#: Pairs within keys that are compared at once, without a round before; this changes the work alone too.
FEW_PAIRS = 100_000
#: Pairs are verified in parts of half as many as there are payloads, or of so many: what is shuffled at once stays in proportion to the payloads.
VERIFIED_AT_ONCE = 50_000


def find_links(keyed: DataFrame, info: DataFrame, near: str, fetch: Callable[[DataFrame], DataFrame], same: str, alone: str = "true", known: DataFrame | None = None, marks: Callable[[DataFrame], DataFrame] | None = None, closer: str = "true") -> DataFrame:
    """Pairs (a, b) of item numbers whose components are those of all links.

    keyed: lid, v and the columns that near mentions, a row for each key v of an
    item (repeated rows change nothing); info: the same columns but v, a row for
    each item. A link: two items that share a key, for which near holds (SQL over
    a.column and b.column; symmetric) and same (SQL over x and y, their payloads);
    of those that share one key, which others have too, alone must hold besides.
    fetch: items asked for (lid) -> lid, payload. known: links that are there
    already; keys whose items they make one group aren't looked at.
    marks: payloads (lid, payload) -> lid and columns that closer mentions, SQL like
    near that holds for every link; pairs of a key of more than two items are
    made only where it does. All payloads are fetched once then.
    """
    keyed = keyed.withColumn("part", F.col("lid")) if known is None else _with_parts(keyed, known)
    ends = [f("lid").alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    ends += [f("part").alias(name) for f, name in ((F.min, "first"), (F.max, "last")) if known is not None]
    held = cut(keyed.groupBy("v").agg(F.count("*").alias("held"), *ends).where("lo <> hi" if known is None else "first <> last"))
    couples = held.where("held = 2").select(F.col("lo").alias("lid"), F.col("hi").alias("other")).distinct()
    couples = couples.join(info, "lid").alias("a").join(info.alias("b"), F.expr(f"a.other = b.lid AND {near}")).select(F.col("a.lid").alias("a"), F.col("b.lid").alias("b"))
    crowds = small_side(held.where("held > 2").select("v"))
    members = cut(keyed.join(crowds, "v").distinct())
    if marks is not None:
        couples = cut(couples)
        asked = cut(members.select("lid").unionByName(couples.select(F.expr("explode(array(a, b))").alias("lid"))).distinct())
        payloads = fetch(asked)
        marked = cut(members.join(marks(payloads), "lid"))
        drop(asked, members)
        members, near = marked, f"{near} AND {closer}"
        fetch = lambda asked: cut(payloads.join(small_side(asked), "lid", "left_semi"))
    attributes = [c for c in members.columns if c != "v"]
    apart = f"a.v = b.v AND a.part <> b.part AND {near}"

    def proposed(found: DataFrame) -> DataFrame:
        pairs = found.select(F.expr("least(a.lid, b.lid)").alias("a"), F.expr("greatest(a.lid, b.lid)").alias("b"), F.expr(alone).alias("alone"))
        return pairs.groupBy("a", "b", "alone").agg(F.count("*").alias("shared")).where("shared > 1 OR alone").select("a", "b")

    links, tried = known, None
    for turn in range(ROUNDS):
        counted = cut(members.groupBy("v").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) div 2")).alias("pairs"), F.sum("c").alias("items")))
        size = counted.first()
        drop(counted)
        if (size[0] or 0) <= max(FEW_PAIRS, 2 * (size[1] or 0)):
            break
        centre = F.min_by(F.struct(*attributes), F.xxhash64("lid", F.lit(turn)))
        stars = small_side(members.groupBy("v").agg(centre.alias("s")).select("v", "s.*"))
        pairs = proposed(members.alias("a").join(stars.alias("b"), F.expr(apart)))
        pairs = cut(couples.unionByName(pairs).distinct() if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = _verified(pairs, fetch, same)
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        parted = cut(_with_parts(members.drop("part"), links))
        mixed = small_side(parted.groupBy("v").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("v"))
        left = cut(parted.join(mixed, "v", "left_semi"))
        drop(members, parted)
        members = left
        if found.count() < FRUITFUL * (size[1] or 0):
            break
    rest = proposed(members.alias("a").join(members.alias("b"), F.expr(f"{apart} AND a.lid < b.lid")))
    rest = cut(couples.unionByName(rest).distinct() if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    drop(held)
    found = _verified(rest, fetch, same)
    return found if links is None else links.unionByName(found)


def _with_parts(items: DataFrame, links: DataFrame) -> DataFrame:
    """items (lid, ...) with part, the least item that links reach."""
    label = small_side(connected_components(links).select(F.col("node").alias("lid"), F.col("component").alias("part")))
    return items.join(label, "lid", "left").withColumn("part", F.coalesce("part", "lid"))


def _verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], same: str) -> DataFrame:
    """Those of the pairs (a, b) for which same holds of their payloads x and y."""
    asked = cut(pairs.select(F.expr("explode(array(a, b))").alias("lid")).distinct())
    payload = fetch(asked)
    x, y = payload.select(F.col("lid").alias("a"), F.col("payload").alias("x")), payload.select(F.col("lid").alias("b"), F.col("payload").alias("y"))
    parts = max(1, ceil(pairs.count() / max(VERIFIED_AT_ONCE, asked.count() // 2)))
    held = [pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("a", "b", F.lit(1)), F.lit(parts)) == k) for k in range(parts)]
    links = [cut(some.join(x, "a").join(y, "b").where(same).select("a", "b")) for some in held]
    drop(asked, payload)
    return reduce(DataFrame.unionByName, links)
