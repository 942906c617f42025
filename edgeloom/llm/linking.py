"""Groups of similar items from buckets, without listing a bucket's pairs.

Items that share a bucket may be similar. A bucket is compared in stars: a
few members are centres, and every other member is compared with each of
them. Members already known to belong together need no comparison. A bucket
takes part in further rounds, with 32 times as many centres each time, until all
its members belong together or every pair of different groups has had one end
as a centre. So no link that the buckets allow is lost. Two members outside a
bucket's largest group, or one and a member of that group, are all that is left
to compare. So in a bucket of at most ``PART_ROWS`` members all outside of that
group are centres in the second round, and in the third one in every bucket
that has no more of them, however large the group is; its rows are not moved
again. Pairs that cannot be
linked are sorted out in the join itself; a large bucket meets its centres in
many places, so its work is spread, though a bucket of many members none of
which are alike still has each of them compared with all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.storage import discard, packed, stored

MAX_CENTRES = 32_768  # of a bucket and round; a bucket with more members takes more rounds
PART_ROWS = 1024  # members of a bucket that meet its centres in one place; the second round settles a bucket of no more


ROWS_A_TASK, MEMBERS_A_TASK, LINKS_A_TASK = 50_000, 10_000, 20_000  # small tables are written by few tasks
TASK_ROWS = 1_000_000  # links that one task may connect; more are connected by shuffles
FEW_ROWS = 50_000  # of buckets, whose centres one task may name
KEY_WORDS = 1 << 19  # of 64 bits, that ``narrowed`` has for keys


def narrowed(rows: DataFrame, keys: Column, wanted: DataFrame, others: bool = False) -> DataFrame:
    """Rows whose ``keys`` are in ``wanted`` (one column of that type), and few others; nulls go.

    With ``others``, exactly the rows that are not returned without it.

    Each wanted key sets one of 2^25 bits, which are broadcast: ``KEY_WORDS``
    rows at most, however many keys there are. So of rows that are mostly not
    wanted, most need not be moved to be told from the others.
    """
    bit = lambda key: F.pmod(F.xxhash64(key), F.lit(64 * KEY_WORDS))
    one = F.lit(1).cast("bigint")
    place = wanted.select(F.col(wanted.columns[0]).alias("_key")).filter("_key is not null").select(bit(F.col("_key")).alias("_bit"))
    words = place.groupBy((F.col("_bit") / 64).cast("int").alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", one, (F.col("_bit") % 64).cast("int"))).alias("_bits"))
    asked = (bit(keys) / 64).cast("int") == F.col("_word")
    is_set = F.call_function("shiftright", F.col("_bits"), (bit(keys) % 64).cast("int")).bitwiseAND(one) == 1
    return rows.join(F.broadcast(words), keys.isNotNull() & asked & is_set, "left_anti" if others else "left_semi")


def _state() -> dict[str, Column]:
    """A fingerprint of an edge set, to see when it no longer changes."""
    return {"v": F.sum(F.col("v").cast("decimal(38,0)")), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def connected(links: DataFrame, most: int | None = None) -> DataFrame:
    """``node, root``: the smallest node reached, for every node that reaches a smaller one.

    Alternating large-star and small-star steps; ``links`` has ``a, b`` (bigint)
    and, where that is known, ``most`` rows. A round over ``TASK_ROWS`` links or
    fewer is one task without shuffles: its minima are windows, as a join of
    estimated size would be dealt out again.
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = stored(packed(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(), most, LINKS_A_TASK), "links", **_state())
    while edges.rows_seen["rows"]:
        few = edges.rows_seen["rows"] <= TASK_ROWS
        once = edges.coalesce(1) if few else edges
        lowest = (lambda df: df.withColumn("m", F.min("v").over(Window.partitionBy("u")))) if few else (
            lambda df: df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u"))
        both = once.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*")
        large = (
            lowest(both).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        )
        small = (
            lowest(large).select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e"))
            .select("e.*").filter("u <> v").distinct()
        )
        last, edges = edges, stored(small, "stars", **_state())
        discard(last)
        if edges.rows_seen.values() == last.rows_seen.values():
            break
    once = edges.coalesce(1) if edges.rows_seen["rows"] <= TASK_ROWS else edges
    out = once.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    out._scratch, out.links_seen = edges._scratch, edges.rows_seen["rows"]
    return out


def _order(turn: int) -> Column:
    """A reversible scramble of item ids, another one each round: its minimum names a member at random."""
    return F.col("item").bitwiseXOR(F.xxhash64(F.lit(turn)))


def _merged(roots: DataFrame | None, links: DataFrame, most: int) -> DataFrame | None:
    """``item, root`` after ``links`` (a, b; ``most`` rows) connect further groups; the tables it came from are deleted."""
    if roots is None:
        moved = connected(links, most)
        out = stored(moved.withColumnRenamed("node", "item"), "roots") if moved.links_seen else None
        discard(moved)
        return out
    ends = (
        links.join(roots.select(F.col("item").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("item").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    moved = connected(ends, most)
    if not moved.links_seen:
        discard(moved)
        return roots
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left")
    new = moved.join(roots.select(F.col("item").alias("node")), "node", "left_anti")
    out = stored(
        old.select("item", F.coalesce("r2", "root").alias("root"))
        .unionByName(new.select(F.col("node").alias("item"), "root")), "roots")
    discard(moved, roots)
    return out


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("item"))
    return rows.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets in which items that have not served are of different groups.

    ``size`` is the bucket's, ``top`` the largest group of those items and
    ``apart`` the number of them that are not in it.
    """
    waiting = F.count(F.when(~F.col("served"), 1))
    kinds = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), waiting.alias("w"))
    state = kinds.groupBy("bucket").agg(
        F.sum("n").alias("size"), F.sum("w").alias("w"), F.max(F.struct("w", "root")).alias("most"))
    left = state.filter("most.w < w").select("bucket", "size", F.col("most.root").alias("top"), F.expr("w - most.w").alias("apart"))
    return rows.drop("size", "top", "apart").join(left, "bucket")


def _shared(members: DataFrame, roots: DataFrame | None, most: int | None) -> DataFrame:
    """What ``_open`` keeps of all members before the first round.

    Most buckets hold one item. Their rows are told by the buckets' smallest
    and largest root alone and are not moved themselves.
    """
    rows = _with_roots(members, roots)
    several = stored(packed(
        rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("bucket"),
        most, ROWS_A_TASK), "several")
    some = narrowed(rows, F.col("bucket"), several)
    out = stored(packed(_open(some.withColumn("served", F.lit(False))).distinct(), most, ROWS_A_TASK), "buckets")
    discard(several)
    return out


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Rows of one bucket of all that have the same items: the others would only repeat its pairs."""
    item = F.col("item")
    kinds = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_"), F.bit_xor(F.xxhash64(item)).alias("x_"), F.bit_xor(F.xxhash64(item, F.lit(1))).alias("y_"))
    return rows.join(kinds.groupBy("n_", "x_", "y_").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    traits: Callable[[DataFrame], DataFrame],
    may_link: Callable[[str, str], Column],
    roots: DataFrame | None = None,
    turns: int | None = None,
    most: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``item, root``: the smallest item reached through links, for every item that reaches a smaller one.

    ``members``: ``bucket, item`` (bigint). ``traits`` gets the items (distinct) that
    share a bucket and adds what ``may_link`` needs of each.
    ``verify`` gets ``a, b`` (a < b, distinct, a ``stored`` table) and returns the pairs that are linked.
    ``may_link`` is a condition on the traits of both (given the prefixes of the
    two names) without which a pair cannot be linked; it is part of the join of
    a bucket with its centres, so pairs that fail it are never made.
    ``roots`` are groups that are known before. After ``turns`` rounds (all that
    are needed, by default) the rows of buckets that are not settled are
    returned too; they are empty if all are. ``most``: no fewer than the rows of
    ``members``, if known; it bounds the number of files.
    """
    shared = _shared(members, roots, most)
    known = traits(shared.select("item").distinct())
    extra = [c for c in known.columns if c != "item"]
    columns = ["bucket", "item", "root", "served", "size", "top", "apart", *extra]
    pack = lambda df: packed(df, grown.rows_seen["rows"], MEMBERS_A_TASK)
    grown, turn = shared, 0
    grown = stored(pack(_one_of_each(shared).join(known, "item").select(columns)), "members")
    discard(shared)
    while grown.rows_seen["rows"] and turn != turns:
        some = min(32 ** turn, MAX_CENTRES)
        few = grown.rows_seen["rows"] <= FEW_ROWS
        once = grown.coalesce(1) if few else grown
        # centres: each of ``some`` parts of a bucket names one member that has not served yet
        part = F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(some))
        # all outside the largest group of these buckets are centres; of a large bucket, few are left there after two rounds
        last_turn = F.lit(False) if not turn else F.col("apart" if turn > 1 else "size") <= PART_ROWS
        large = once.filter(~last_turn)
        named = (
            large.filter("not served").withColumn("part", part)
            .groupBy("bucket", "part").agg(F.min(_order(turn)).alias("m"))
            .select("bucket", F.col("m").bitwiseXOR(F.xxhash64(F.lit(turn))).alias("item"), F.lit(True).alias("now"))
        )
        marked = large.join(named.hint("merge") if few else named, ["bucket", "item"], "left").withColumn("now", F.coalesce("now", F.lit(False)))
        if turn:
            marked = marked.unionByName(once.filter(last_turn).withColumn("now", ~F.col("served") & (F.col("root") != F.col("top"))))
        marked = stored(pack(marked), "centres")
        discard(grown)
        # a large bucket is dealt into parts, and its centres go to each of them; who has served has met them all
        parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
        dealt = marked.filter("not served").withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn), F.lit(1)), parts).cast("int"))
        centres = marked.filter("now").select(
            "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("item").alias("centre"),
            F.col("root").alias("c_root"), *[F.col(x).alias(f"c_{x}") for x in extra])
        pairs = stored(packed(
            dealt.join(centres, ["bucket", "part"]).filter("root <> c_root and (item < centre or not now)").filter(may_link("", "c_"))
            .select(F.least("item", "centre").alias("a"), F.greatest("item", "centre").alias("b")).distinct(),
            grown.rows_seen["rows"], MEMBERS_A_TASK // 10), "pairs")
        after = marked.filter(~last_turn)
        if pairs.rows_seen["rows"]:
            before, roots = roots, _merged(roots, verify(pairs), pairs.rows_seen["rows"])
            if roots is not before:
                after = stored(pack(_with_roots(after.drop("root"), roots)), "rooted")  # read twice
        grown = stored(pack(_open(after.withColumn("served", F.col("served") | F.col("now")).select(columns)).select(columns)), "open")
        discard(marked, pairs, after)
        turn += 1
    if roots is None:
        roots = grown.select("item", "root").limit(0)
    return roots, grown
