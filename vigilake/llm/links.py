"""Connected components and links between rows that share a key, in DataFrame operations only.

Nothing here gathers edges or components on the driver: a round returns two
numbers. Buckets of any size are first compared with one member of theirs and
then, where several components are left, in tiles of bounded size; a member
reports one neighbour per tile, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, rare_keys, release


Check = Callable[[Column, Column], Column]
#: Slots of the filter that keeps rows from being shuffled for nothing; it never has more rows than that.
SLOTS = 1 << 22
#: Keys of a row that are shuffled at once.
PASS = 10


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` less most of those whose ``key`` is not in ``wanted``, by the slots of the keys' hashes, so that a join shuffles few of them."""
    slot = F.pmod(F.xxhash64(F.lit(3), key), F.lit(SLOTS)).cast("int").alias("__slot")
    taken = wanted.select(slot).distinct()
    return rows.select("*", slot).join(F.broadcast(taken), "__slot", "left_semi").select(*rows.columns)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the ``u``-``v`` edges; root is the least node reachable.

    Alternating large-star and small-star rounds: each keeps the components and
    moves every node to a smaller neighbour, until all point at their least node.
    Each node's least neighbour is written before it is joined, so that the join
    reads plain shuffles and a hub's edges can be split over tasks.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, materialise(down.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last, least)
        state, before = _state(now), state
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def block_keys(fp: Column, distance: int, blocks: int) -> list[Column]:
    """One long key for each choice of ``blocks - distance`` of the blocks of a 64-bit fingerprint.

    Two fingerprints that differ in at most ``distance`` bits leave that many
    blocks untouched, so they share at least one key.
    """
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        if sum(widths[i] for i in chosen) > 54:
            raise ValueError("too many blocks for a long key")
        key = F.lit(n).cast("long")
        for i in chosen:
            part = F.shiftrightunsigned(fp, starts[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))
            key = F.shiftleft(key, widths[i]).bitwiseOR(part)
        keys.append(key)
    return keys


def hamming_components(fps: DataFrame, distance: int, blocks: int, tile: int = 512) -> DataFrame:
    """(node, root) of each fingerprint ``id`` of ``fps`` (long, unique) that differs from another in at most ``distance`` bits."""
    choices = block_keys(F.col("id"), distance, blocks)
    return keyed_components(fps, choices, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance, tile=tile)


def keyed_components(items: DataFrame, keys: list[Column], near: Check, describe: Callable[[DataFrame], DataFrame] | None = None, verify: Check | None = None, tile: int = 512, anywhere: bool = False) -> DataFrame:
    """(node, root) of the ids of ``items`` (id long, unique) that have a link, root being the least id reachable.

    ``keys`` are a row's keys, longs (null: none); with ``anywhere`` one key may stand at different places in two
    rows, else different places have different keys. A link joins two ids that
    share a key and pass ``near`` and then ``verify``, which is the dearer check. Both get the two ids or, with
    ``describe``, what that tells of them: it takes ids (id) and returns (id, about).

    Every member of a bucket is compared with the bucket's least id, which settles
    buckets of two and groups of near copies of any size. Where members
    are left in other components than that id, they are compared with all members in tiles of
    about ``tile``: a member names one linked member of up to MOST other components in each
    tile, and those that named as many look again, by the components found so far. So
    no link is lost, no pairs are listed, and members of the leading component
    are not compared with each other. With ``describe``, two members are verified in the least of the buckets they share only;
    if that has no other component left, they are in one already.
    """
    small = []
    passes = -(-len(keys) // PASS)
    for at in range(passes):  # a share of the keys at a time, so that their shuffles don't lie side by side
        some = F.lit(True) if not anywhere else F.pmod(F.col("key"), F.lit(passes)) == at
        dealt = items.select("id", F.explode(F.array(*(keys if anywhere else keys[at::passes]))).alias("key")).filter(F.col("key").isNotNull() & some)
        if anywhere:  # most such keys come once, so sums before the shuffle would only make its rows wider
            dealt = dealt.repartition("key")
        found = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"))
        with rare_keys(items.sparkSession):
            small.append(materialise(found.filter("lo < hi"), "buckets"))
    buckets = reduce(DataFrame.unionByName, small)
    two = buckets.filter("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    # buckets of the same members, as near copies make for key after key, hold the same links: one of them is enough
    many = materialise(buckets.filter("n > 2").groupBy("n", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", "lo", "n"), "many")
    dealt = items.select("id", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    rows = materialise(only(dealt, many, "key").join(many, "key").select("key", "lo", "n", "id"), "members")
    pairs = materialise(two.unionByName(rows.filter("id <> lo").select(F.col("lo").alias("u"), F.col("id").alias("v"))).distinct(), "pairs")
    about = None
    both = lambda a, b: near(a, b) if verify is None else near(a, b) & verify(a, b)
    if describe is None:
        passed = pairs.filter(both(F.col("u"), F.col("v")))
    else:
        ids = materialise(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
        about = materialise(describe(ids), "about")
        whose = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
        passed = pairs.join(about.toDF("u", "a"), "u").join(about.toDF("v", "b"), "v").filter(both(F.col("a"), F.col("b")))
    edges = materialise(passed.select("u", "v"), "edges")
    labels, active = materialise(connected_components(edges), "labels"), None
    while True:
        of, looked, own = labels.toDF("id", "label"), many, rows
        if active is not None:  # nobody looks in the other buckets again
            again = active.select("key").distinct()
            looked, own = many.join(again, "key", "left_semi"), only(rows, again, "key").join(again, "key", "left_semi")
        leads = looked.join(of.toDF("lo", "lead"), "lo", "left").select("key", F.coalesce("lead", "lo").alias("lead"))
        named = own.join(of, "id", "left").join(leads, "key").select("key", "n", "id", F.coalesce("label", "id").alias("label"), "lead")
        named = materialise(named.withColumn("other", F.col("label") != F.col("lead")).drop("lead"), "named")
        live = materialise(named.filter("other").groupBy("key").agg(F.count(F.lit(1)).alias("others")), "live")
        if live.isEmpty():
            return labels
        told = about if about is None else about.join(whose, "id")
        found = materialise(_crossed(named, live, active, near, verify, told, tile), "found")
        release(named, live)
        if found.isEmpty():
            return labels
        # the components that the links join are few beside their members
        roots = materialise(connected_components(found.select("u", "v")), "roots")
        joined = labels.join(roots.toDF("root", "over"), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
        alone = roots.join(labels, "node", "left_anti")
        last, labels = labels, materialise(joined.unionByName(alone), "labels")
        active = materialise(found.filter("again").select("key", "id").distinct(), "active")
        release(last, found, roots)
        if active.isEmpty():
            return labels


#: Links that a member names in a tile at once, to different components.
MOST = 4


def _crossed(named: DataFrame, live: DataFrame, active: DataFrame | None, near: Check, verify: Check | None, about: DataFrame | None, tile: int) -> DataFrame:
    """(key, id, u, v, again): links of members to other components, as those components u and v, from rows (key, n, id, label, other) of the buckets ``live`` (key, others); ``again``: the member may have more of them.

    ``active`` (key, id) are the members that look; all that are not in the leading component, if None. ``about`` (id, about, keys)
    has all keys of a member, in every round.
    """
    at = lambda count: F.pmod(F.xxhash64("id"), F.greatest(F.ceil(count / tile), F.lit(1))).cast("int")
    own, rest = F.col("others"), F.col("n") - F.col("others")
    rows = only(named, live, "key").join(live, "key").withColumn("tile", F.when(F.col("other"), at(own)).otherwise(at(rest)))
    if about is not None:
        rows = rows.join(about, "id")
    told = [F.col("id").alias("told")] if about is None else [F.col("about").alias("told"), F.col("keys")]
    member = F.collect_list(F.struct("id", "label", *told))
    by = ["key", "other", "tile", "n", "others"]
    tiles = materialise(rows.groupBy(*by).agg(member.alias("m"), F.min("label").alias("low"), F.max("label").alias("high")), "tiles")
    looking = tiles.filter("other")
    if active is not None:
        looking = rows.filter("other").join(active, ["key", "id"], "left_semi").groupBy(*by).agg(member.alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    last = lambda count: F.greatest(F.ceil(count / tile), F.lit(1)).cast("int") - 1
    first = F.col("tile") if active is None else F.lit(0)  # two tiles of others meet once, unless few look
    others = F.transform(F.sequence(first, last(own)), lambda t: F.struct(F.lit(True).alias("other"), t.alias("tile")))
    leading = F.transform(F.sequence(F.lit(0), last(rest)), lambda t: F.struct(F.lit(False).alias("other"), t.alias("tile")))
    left = looking.select("key", F.col("m").alias("a"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.concat(others, leading)).alias("with"))
    left = left.select("key", "a", "l1", "h1", "with.other", "with.tile")
    right = tiles.select("key", "other", "tile", F.col("m").alias("b"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    both = left.join(right, ["key", "other", "tile"]).filter("least(l1, l2) < greatest(h1, h2)")
    start = F.array().cast("array<bigint>")

    def passes(a: Column, b: Column) -> Column:
        here = F.lit(True) if about is None else F.array_min(F.array_intersect(a["keys"], b["keys"])) == F.col("key")
        return here if verify is None else here & verify(a["told"], b["told"])

    def look(a: Column) -> Column:
        elsewhere = F.filter("b", lambda b: (b["label"] != a["label"]) & near(a["told"], b["told"]))

        def step(got: Column, b: Column) -> Column:  # no row of a component is verified once one of it has passed
            done = (F.size(got) >= MOST) | F.array_contains(got, b["label"])
            return F.when(done, got).when(passes(a, b), F.concat(got, F.array(b["label"]))).otherwise(got)

        return F.struct(a["id"].alias("id"), a["label"].alias("u"), F.aggregate(elsewhere, start, step).alias("got"))

    seen = both.select("key", F.explode(F.filter(F.transform("a", look), lambda e: F.size(e["got"]) > 0)).alias("e"))
    return seen.select("key", "e.id", "e.u", F.explode("e.got").alias("v"), (F.size("e.got") >= MOST).alias("again"))
