"""Classes of similar things from candidate buckets, without all pairs of a bucket.

Members of a bucket are candidates for each other. The members of one class
need not be compared with one another, so links are found in rounds: every
member is compared with one pivot of its bucket (first the member that shares
most buckets, then others by hash), verified links are merged into components,
and buckets whose members are all in one component are done. Buckets that the
rounds leave open are compared at once if they hold no more than a few pairs a
member and pairs have a cheap test of sketches: small ones in full, the members of
larger ones with a pivot first and then with those that differ from it in the
same places. Others are refined by a prefix filter: two members are compared if
they also share one of the rarest elements of each, so many of them that two
links must share one. So no link between two members of different classes is
missed, a large group of copies costs a few comparisons per member, and things
of one pattern that are no links do not form pairs.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Shared

PIVOT_ROUNDS = 4
POOR = 2  # pairs per link from which on pivots are given up
FEW = 4  # pairs per member up to which open buckets are refined at once,
DIRECT = 4  # up to which they are compared at once, given sketches,
MANY = 100  # and after the first pivots
SMALL = 4  # members up to which a bucket is compared in full, where it could be divided


def components(nodes: DataFrame, edges: DataFrame, shared: Shared) -> DataFrame:
    """(id, comp): nodes is (id, comp) so far, edges (a, b) join ids; comp is the least id of a component.

    Components hook onto their least neighbour, twice per round, and edges
    inside a component fall away; the graph of components stays connected while
    it shrinks, so none is split when no edge is left.
    """
    lab = nodes
    e = shared.write(_between(edges, lab))
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = shared.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")))
        over = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = shared.write(up.join(over, "to").select(F.col("a").alias("comp"), "next"))
        lab, old = shared.write(lab.join(step, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))), lab
        e, old_e = shared.write(_between(e, step.select(F.col("comp").alias("id"), F.col("next").alias("comp")))), e
        shared.drop(up, step, old, old_e)
    shared.drop(e)
    return lab


def _between(edges: DataFrame, lab: DataFrame) -> DataFrame:
    """Distinct edges between components."""
    a = lab.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = lab.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    return (edges.join(a, "a").join(b, "b").where("ca <> cb")
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())


def open_buckets(members: DataFrame, shared: Shared) -> DataFrame:
    """The members of buckets with two different members or more."""
    wide = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    return shared.write(members.join(wide, "key").distinct())


def _by_id(members: DataFrame) -> DataFrame:
    """(id, keys): a thing's own buckets, no more than it has bands or segments; joins by id take one row a thing."""
    return members.groupBy("id").agg(F.collect_list("key").alias("keys"))


def link(members: DataFrame, things: Callable[[DataFrame], DataFrame],
         verify: Callable[[DataFrame, DataFrame], DataFrame], shared: Shared,
         elements: Callable[[DataFrame, DataFrame], DataFrame],
         likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
         enough: Callable[[Column, Column], Column] | None = None,
         sketches: tuple[Callable[[DataFrame, DataFrame], DataFrame], Callable[[Column, Column], Column]] | None = None,
         divide: Callable[[DataFrame, DataFrame], DataFrame] | None = None, rounds: int = PIVOT_ROUNDS, few: int | None = None) -> DataFrame:
    """(id, comp) of every id that shares a bucket with another.

    members: (key, id), repeats allowed. things: ids in open buckets -> what
    verify needs of them, taken once. verify: pairs (a, b) -> those that are
    links. elements: what things gave, (id, comp) -> (id, comp, el, size, most), a row for each of
    the ``size`` elements of a thing, no two alike; of any order of elements, the
    first ``most`` of two links have one in common. A column ``at`` may have the place
    of an element that a thing holds only once. likely: a cheap filter of
    pairs that keeps links. enough: of two things' (size, rest, lost, lo, hi), where rest
    elements are left from their first common one on, and of those before it, which the
    other lacks, ``lost`` have places, from lo to hi, whether they can be links.
    sketches: what things gave, (id, comp) -> (id, sketch), and a cheap test of two
    sketches that all links pass, in the place of a common bucket. divide, with sketches:
    pairs (id, pivot), what things gave -> (id, pivot, linked, lo, hi, low, high), a row for each,
    of which links of two that are not both linked to the pivot have numbers in common, both of
    lo to hi and of low to high.
    """
    few = FEW if few is None else few
    found = open_buckets(members, shared)
    lab = shared.write(found.select("id", F.col("id").alias("comp")).distinct())
    known = things(lab.select("id"))
    r = -1
    while True:
        r += 1
        if r == 0:
            here = found.select("id", F.col("id").alias("comp"), "key")
        else:
            here = shared.write(found.join(lab, "id").select("id", "comp", F.explode("keys").alias("key")))
        sizes = here.groupBy("key", "comp").agg(F.count("*").alias("n"))
        state = sizes.groupBy("key").agg(
            F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("top"),
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where("pairs > 0")
        here, before = shared.write(here.join(state, "key")), here
        if r:
            shared.drop(before)
        pairs, n = here.agg(F.sum(F.col("pairs") / F.col("n")), F.count("*")).first()
        if not n:
            break
        last = r >= rounds or pairs <= (few if r == 0 else MANY) * n
        if sketches is not None and pairs <= DIRECT * n:
            last = True  # no more pairs than a few a member
            found_pairs = likely(_bucket_pairs(here, known, shared, sketches, divide))
        elif last:
            found_pairs = likely(_refined_pairs(here, elements, known, shared, enough, sketches))
        else:
            found_pairs = likely(_pivot_pairs(here, r))
        found_pairs = shared.write(found_pairs)
        links = shared.write(verify(found_pairs, known))
        lab = components(lab, links, shared)
        if last:
            break
        if links.count() * POOR < found_pairs.count():
            rounds = r + 1  # pivots have found what they can
        shared.drop(found)
        found = shared.write(_by_id(here))
        shared.drop(here, links)
    return lab


def _pivots(here: DataFrame, r: int) -> DataFrame:
    """The members of open buckets, beside each the bucket's pivot."""
    if r == 0:
        here = here.withColumn("shares", F.sum("n").over(Window.partitionBy("id")))  # a thing's own buckets
        order = F.struct("shares", F.xxhash64("id"))
    else:
        order = F.struct(F.xxhash64("key", "id", F.lit(r)))
    pivot = here.groupBy("key").agg(F.max_by(F.struct("id", "comp"), order).alias("p"))
    return here.join(pivot, "key")


def _pivot_pairs(here: DataFrame, r: int) -> DataFrame:
    """Every member of an open bucket beside the bucket's pivot, unless they are in one component."""
    return (_pivots(here.select("id", "comp", "n", "key"), r).where(F.col("comp") != F.col("p.comp"))
            .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())


def _bucket_pairs(here: DataFrame, known: DataFrame, shared: Shared, sketches: tuple,
                  divide: Callable[[DataFrame, DataFrame], DataFrame] | None) -> DataFrame:
    """Pairs of different components that share a bucket and pass the test of sketches.

    Where buckets can be divided, only members of a small bucket, or of a part of
    a larger one, form pairs.
    """
    make, near = sketches
    own = shared.write(make(known, here.select("id", "comp").distinct()))
    small = here if divide is None else here.where(F.col("n") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    pairs = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.id") < F.col("y.id")))
             .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    if divide is not None:
        pairs = pairs.unionByName(_divided_pairs(here.where(F.col("n") > SMALL), known, shared, divide))
    pairs = pairs.distinct()
    a = own.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    b = own.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(a, "a").join(b, "b").where(near(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")


def _divided_pairs(here: DataFrame, known: DataFrame, shared: Shared,
                   divide: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Members of buckets beside their pivot, and beside those that differ from it in the same places.

    A part with more than a few members is cut by the second range too. Two
    things meet in the first numbers that they have in common only, and not
    if they are both linked to the pivot.
    """
    beside = shared.write(_pivots(here.select("id", "comp", "n", "key"), 0).where(F.col("id") != F.col("p.id"))
                          .select("id", "comp", F.col("p.id").alias("pivot"), F.col("p.comp").alias("of")).distinct())
    ranges = divide(beside.select("id", "pivot"), known).join(beside.drop("of"), ["id", "pivot"])
    ranges = shared.write(ranges.withColumn("part", F.explode(F.sequence("lo", "hi"))))
    wide = ranges.groupBy("pivot", "part").agg(F.count("*").alias("n")).where(F.col("n") > SMALL)
    cut = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence("low", "high"))
    parts = shared.write(ranges.join(wide, ["pivot", "part"], "left").withColumn("cut", F.explode(cut)).drop("n"))
    x, y = parts.alias("x"), parts.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("pivot", "part", "cut")]
    on += [F.col("x.comp") != F.col("y.comp"), F.col("x.id") < F.col("y.id"), ~(F.col("x.linked") & F.col("y.linked")),
           F.col("x.part") == F.greatest("x.lo", "y.lo"), F.greatest("x.low", "y.low") <= F.least("x.high", "y.high"),
           (F.col("x.cut") < 0) | (F.col("x.cut") == F.greatest("x.low", "y.low"))]
    met = x.join(y, functools.reduce(operator.and_, on)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return met.unionByName(beside.where("comp <> of").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")))


def _refined_pairs(here: DataFrame, elements: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame, shared: Shared,
                   enough: Callable[[Column, Column], Column] | None, sketches: tuple | None = None) -> DataFrame:
    """Pairs of different components that share a bucket, or pass the test of sketches, and an element of their prefixes.

    Elements are ordered by the number of things that hold them, those that
    only one component holds before all others, so a prefix is made of what is
    rare and things that merely follow one pattern do not meet. A pair is taken
    at its first common element only. Elements of one component take part as a
    number: they have places in a prefix, but no rows.
    """
    if sketches is None:
        own = here.groupBy("id", "comp").agg(F.array_sort(F.collect_set("key")).alias("sketch"))  # a thing's own buckets
        near = F.arrays_overlap
    else:
        make, near = sketches
        own = here.select("id", "comp").distinct()
    own = shared.write(own)
    ids = own.select("id", "comp")
    els = shared.write(elements(known, ids))
    if sketches is not None:
        own = ids.join(make(known, ids), "id")
    if "at" not in els.columns:
        els = els.withColumn("at", F.lit(None).cast("int"))
    live = (els.groupBy("el").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo <> hi").select("el", "n"))
    each = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "el", "at")
    listed = els.join(live, "el", "left").groupBy("id", "size", "most").agg(
        F.slice(F.sort_array(F.collect_list(each)), 1, F.col("most")).alias("first"))  # a thing's own elements
    before = F.transform(F.filter(F.slice("first", 1, F.col("i")), lambda e: e["at"].isNotNull()), lambda e: e["at"])
    listed = (listed.withColumn("prefix", F.transform(F.filter("first", lambda e: e["n"] > 0), lambda e: e["el"]))
              .join(own, "id").select("id", "comp", "sketch", "size", "prefix", "first", F.posexplode("first").alias("i", "e"))
              .where("e.n > 0")
              .withColumn("left", F.struct("size", (F.col("size") - F.col("i")).alias("rest"), F.size(before).alias("lost"),
                                           F.array_min(before).alias("lo"), F.array_max(before).alias("hi"))))
    listed = shared.write(listed.select("id", "comp", "sketch", "prefix", "left", F.col("e.el").alias("el")))
    shared.drop(els)
    x, y = listed.alias("x"), listed.alias("y")
    on = (F.col("x.el") == F.col("y.el")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.id") < F.col("y.id"))
    if sketches is not None:
        on = on & near(F.col("x.sketch"), F.col("y.sketch"))  # the cheapest test first
    if enough is not None:
        on = on & enough(F.col("x.left"), F.col("y.left"))
    if sketches is None:
        on = on & near(F.col("x.sketch"), F.col("y.sketch"))
    on = on & (F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x.el"))
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
