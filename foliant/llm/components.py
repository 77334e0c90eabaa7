"""Distributed union-find and exact linking of similar sets through inverted lists, in DataFrame operations only.

Skew: a list that holds a third of all nodes is never paired with itself. Short
lists are paired at once. The members of longer lists are centred: the
*centre* of a group of lists is the set of elements that more than half of the
members have, and what is compared afterwards is how each member differs from
it. Let T(x) be the symmetric difference of x and the centre C, and

    g(x) = (100 + p) |T(x)| - (100 - p) |x|.

Whatever C is, two sets have a Jaccard similarity of at least p % exactly if

    g(x) + g(y) <= 2 (100 + p) |T(x) & T(y)|.

So the member with the least g links at once with every x for which the sum is
not above zero, a star of links in one row for each member, and any further
link of the rest (the *outer* members) needs common differences from the
centre, the more the farther out. Differences that many members share are
absorbed by the centre, and those left are mostly rare: a prefix filter with
positions over them leaves few pairs. Lists of differences that are long again
are centred again. No step drops a link: the bound is exact, and each pair that is left is
verified on full sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps: each hangs the neighbours of a
    node on the smallest of them. A step aggregates with map-side combine and
    joins its minima back, so a node with very many neighbours costs one row for
    each edge. Every step is written, so lost executors don't restart the loop.
    Empty edges give an empty table. Null ends and loops are ignored.
    """
    edges = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = scratch.keep(edges, "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of each node move to its minimum
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: smaller neighbours, and the node itself, move to its minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = hung.where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.keep(new, "small")
        state = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        scratch.drop(edges)
        edges = new
        if state == last:
            break
        last = state
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


#: Lists of at most SMALL nodes are paired at once, lists of differences of at
#: most SHORT; after LEVELS centrings all lists are. None of them changes what is linked.
SMALL, SHORT, LEVELS = 8, 256, 6


def small_pairs(lists: DataFrame) -> DataFrame:
    """Distinct (a, b) that meet in ``lists`` (key, node) of bounded length, and in how many."""
    met = lists.groupBy("key").agg(F.collect_list("node").alias("v"))
    each = "flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> struct(least(x, y) as a, greatest(x, y) as b))))"
    return met.select(F.inline(F.expr(each))).groupBy("a", "b").agg(F.count("*").alias("met"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, unfold: Callable[[str], str]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; what travels is what ``unfold`` makes sets of."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    both = both.selectExpr("a", "b", "na + nb as n", f"size(array_intersect({unfold('sa')}, {unfold('sb')})) as k")
    return both.where(f"100 * k >= {percent} * (n - k)").select("a", "b")


def centred(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, unfold: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(links (a, b); lists of differences (key, node, outer, g, rest)) of the groups ``members`` (r, node), distinct.

    ``rest`` is the number of differences that come after this one in the order of the group.
    """
    up, down = 100 + percent, 100 - percent
    full = members.join(sets, "node").selectExpr("r", "node", "n", f"{unfold('s')} as s")
    counts = full.select("r", F.explode("s").alias("e")).groupBy("r", "e").agg(F.count("*").alias("c"))
    centre = counts.join(members.groupBy("r").agg(F.count("*").alias("m")), "r").where("2 * c > m").groupBy("r").agg(F.collect_list("e").alias("centre"))
    moved = full.join(centre, "r", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    moved = moved.selectExpr("r", "node", "n", "concat(array_except(s, centre), transform(array_except(centre, s), x -> ~x)) as d")
    moved = scratch.keep(moved.selectExpr("r", "node", "d", "size(d) as t", f"{up}L * size(d) - {down}L * n as g"), "moved")
    best = moved.groupBy("r").agg(F.min(F.struct("g", "node")).alias("best"))
    placed = moved.join(best.select("r", F.col("best.g").alias("gb"), F.col("best.node").alias("first")), "r")
    links = placed.where("g + gb <= 0 and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    outer = placed.where("g + gb > 0").groupBy("r").agg(F.min("g").alias("go"))
    rows = placed.join(outer, "r").selectExpr("r", "node", "d", "t", "g", "g + gb > 0 as outer", f"t + 1 - greatest(1, ceil((g + case when g + gb > 0 then gb else go end) / {2 * up}.0D)) as prefix")
    each = rows.where("prefix >= 1").select("r", "node", "t", "g", "outer", "prefix", F.explode("d").alias("e"))
    # differences of one member alone, or of no outer one, link nothing and come first in the order
    shared = each.groupBy("r", "e").agg(F.count("*").alias("c"), F.max("outer").alias("any")).where("c > 1 and any").select("r", "e", "c")
    ranked = each.join(shared, ["r", "e"]).selectExpr(
        "*", "t - count(*) over (partition by r, node) + row_number() over (partition by r, node order by c, e) as place"
    )
    lists = ranked.where("place <= prefix").selectExpr("xxhash64(r, e) as key", "node", "outer", "g", "t - place as rest")
    return links, scratch.keep(lists, "differences")


def link(postings: DataFrame, near: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, unfold: Callable[[str], str] = str) -> DataFrame:
    """(node, root) of all nodes with a link.

    ``postings``: (key, node), distinct; nodes of one list may link. ``near``
    leaves of the pairs (a, b) those that may be similar, by their signatures.
    ``sets`` gives (node, s) of the nodes asked for; ``unfold`` is SQL for the set of a column like s, an
    array of distinct longs, so that what is stored and shuffled may be smaller than sets. By default s is the set.
    """
    up = 100 + percent
    sized = scratch.keep(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    listed = scratch.keep(postings.join(sized, "key"), "listed")
    pairs = [scratch.keep(near(small_pairs(listed.where(f"n <= {SMALL}"))).select("a", "b"), "pairs")]
    # groups of long lists are named by a member of them; one that is in many long lists joins most of them
    long = listed.where(f"n > {SMALL}").select("key", "node", "n")
    reach = long.join(long.groupBy("node").agg(F.sum("n").alias("reach")), "node")
    names = reach.groupBy("key").agg(F.max(F.struct("reach", "node")).alias("r")).select("key", F.col("r.node").alias("r"))
    members = scratch.keep(long.join(names, "key").select("r", "node").distinct(), "members")
    asked = members.select("node").union(pairs[0].select(F.col("a").alias("node"))).union(pairs[0].select("b")).distinct()
    known = scratch.keep(sets(asked).selectExpr("node", "s", f"size({unfold('s')}) as n"), "sets")
    links = []
    for level in range(LEVELS):
        if members.isEmpty():
            break
        stars, lists = centred(members, known, percent, scratch, unfold)
        links.append(stars)
        sizes = lists.groupBy("key").agg(F.count("*").alias("n"), F.max("outer").alias("any"), F.min(F.struct("g", "node")).alias("low"))
        sizes = sizes.where("n > 1 and any").select("key", "n", F.col("low.node").alias("r"))
        lists = scratch.keep(lists.join(sizes, "key"), "lists")
        here = lists.where(f"n <= {SHORT}") if level + 1 < LEVELS else lists
        x = here.where("outer").select("key", F.col("node").alias("x"), F.col("g").alias("gx"), F.col("rest").alias("rx"))
        y = here.select("key", F.col("node").alias("y"), F.col("g").alias("gy"), F.col("rest").alias("ry"), "outer")
        met = x.join(y, "key").where(f"(x < y or x > y and not outer) and {2 * up} * (1 + least(rx, ry)) >= gx + gy")
        pairs.append(scratch.keep(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs"))
        members = scratch.keep(lists.where(f"n > {SHORT}").select("r", "node").distinct(), "members") if level + 1 < LEVELS else members.limit(0)
    every = pairs[0]
    for p in pairs[1:]:
        every = every.union(p)
    found = verified(every.distinct(), known, percent, unfold)
    for stars in links:
        found = found.union(stars)
    return scratch.keep(connected_components(found, scratch), "roots")
