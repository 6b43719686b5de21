"""Fuzzy line dedup in DataFrame operations only: blocks of rare words, SimHash, edit similarity, one occurrence kept.

A fingerprint of 63 bits moves by about 13 bits between lines at an edit
similarity of 0.8, so blocks of its bits that all such lines share would have a
few bits only. The pigeonhole blocks are therefore cut from what the fingerprint is made
of: a line's words in one fixed order. Lines at that similarity differ in few
words, so most of their first words are the same, and any three of these are a
block. The SimHash then decides which candidates are worth an edit distance.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import keyed_components, only
from .scratch import joint_shuffles, materialise, scope


#: Bits of a lane: 7 lanes of a long count up to 255 words each and leave the sign alone.
LANE, MOST, LONG = 9, 255, 1
ONES = sum(1 << at for at in range(0, 63, LANE))
SUMS = [f"s{j}" for j in range(LANE)]
#: A block is BLOCK of the FIRST first words of a line: 20 blocks a line.
FIRST, BLOCK = 6, 3


def normal(line: Column) -> Column:
    """Lower case, trimmed, every run of white space one space; the expression is only for lines that have such a run."""
    low = F.trim(F.lower(line))  # a trim that takes a set of characters notes the place of each one first
    runs = [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")]
    return F.when(reduce(lambda x, y: x | y, runs), F.trim(F.regexp_replace(low, "[ \\t\\r\\x0b\\x0c]+", " "))).otherwise(low)


def first_words(lines: DataFrame, norm: str, least: int, names: list[str]) -> DataFrame:
    """``lines`` with ``names`` in place of ``norm``: hashes of the first words of a line of at least ``least`` words, else null.

    Longer words, which are rarer, come first, then as they stand, so words that
    two lines have in common come in the same order in both. Each step is a column of
    its own, because what a lambda names is computed again for each element; the
    hashes are outside of any lambda, where the JVM compiles them.
    """
    keep = [c for c in lines.columns if c != norm]
    split = lines.select(*keep, F.split(norm, " ").alias("__ws"))
    place = F.transform("__ws", lambda w, i: F.shiftleft(F.lit(31) - F.least(F.length(w), F.lit(31)), 26) + i)  # lines have under 2^26 words
    placed = split.select(*keep, "__ws", F.slice(F.sort_array(place), 1, len(names)).alias("__at"))
    word = lambda i: F.get("__ws", F.get("__at", F.lit(i)).bitwiseAND(F.lit((1 << 26) - 1)))
    return placed.select(*keep, *[F.when((F.size("__ws") >= least) & (F.size("__at") > i), F.xxhash64(word(i))).alias(f) for i, f in enumerate(names)])


def blocks(nodes: DataFrame, first: list[str]) -> tuple[DataFrame, list[Column]]:
    """(id and what the keys need) and the keys of each line's blocks; of equal words the earlier ones make a block, so that no key comes twice.

    A key is the exclusive or of its words' hashes, turned by their place in
    the block: little code, which the JVM compiles, for many keys.
    """
    turn = lambda c, by: F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))
    parts = [turn(F.col(f), by).alias(f"{f}_{by}") for f in first for by in (21, 42)]
    same = [(F.col(b) == F.col(a)).alias(f"{b}_same") for a, b in zip(first, first[1:], strict=False)]
    held = nodes.select("id", *first, *parts, *same)
    keys = []
    for chosen in combinations(range(FIRST), BLOCK):
        key = reduce(lambda x, y: x.bitwiseXOR(y), [F.col(first[i] + ("" if not at else f"_{21 * at}")) for at, i in enumerate(chosen)])
        later = [F.col(f"{first[i]}_same") for i in chosen if i and i - 1 not in chosen]
        keys.append(F.when(~reduce(lambda x, y: x | y, later), key) if later else key)
    return held, keys


def _majority(n: Column) -> Column:
    """The 63 bits that over half of ``n`` words have, from the sums: one addition compares all lanes of a sum."""
    over = F.lit(MOST).cast("long") - F.floor(n / 2)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f) + over * F.lit(ONES), LANE - 1).bitwiseAND(F.lit(ONES)), j) for j, f in enumerate(SUMS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def simhashes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n and fp of each row of ``lines`` (keys; norm): the 63-bit SimHash of its n words.

    All words count (LONG is 1). A bit is 1 if it is set in over half of the words'
    hashes. Lane l of sum j counts bit j + 9 * l, so a word costs 9 additions, which the JVM
    compiles; lines with more words than a lane can count are counted in stretches and added up bit by bit.
    """
    words = lines.select(*keys, F.posexplode(F.split("norm", " ")).alias("at", "w"))
    counts = F.length("w") >= LONG
    hashed = words.select(*keys, "at", counts.cast("long").alias("one"), F.when(counts, F.xxhash64("w")).otherwise(F.lit(0).cast("long")).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(ONES))).alias(s) for j, s in enumerate(SUMS)]
    stretches = hashed.groupBy(*keys, F.floor(F.col("at") / MOST).alias("stretch")).agg(F.sum("one").alias("n"), *sums)
    counted = stretches.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list(F.struct(*SUMS)).alias("cs"))
    counted = counted.select(*keys, "n", "cs", F.col("cs")[0].alias("c")).select(*keys, "n", "cs", "c.*")
    lane = lambda c, bit: F.shiftrightunsigned(c[SUMS[bit % LANE]], LANE * (bit // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))
    total = lambda bit: F.aggregate("cs", F.lit(0).cast("long"), lambda acc, c: acc + lane(c, bit))
    long = reduce(lambda x, y: x.bitwiseOR(y), [F.when(total(bit) * 2 > F.col("n"), F.lit(1 << bit)).otherwise(F.lit(0).cast("long")) for bit in range(63)])
    return counted.select(*keys, "n", F.when(F.col("n") <= MOST, _majority(F.col("n"))).otherwise(long).alias("fp"))


def symbols(norm: Column) -> Column:
    """One character of 2^19 a word, from its hash, so that edits of words are edits of characters.

    The four bytes are F0 to F3, 90 to 9F or B0 to BF, and twice 80 to BF, which is valid UTF-8. An edit distance
    compares first bytes before whole characters, so these differ as well.
    """
    code = lambda w: F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x032F3F3F)).bitwiseOR(F.lit(0xF0908080)))
    return F.unhex(F.array_join(F.transform(F.split(norm, " "), code), "")).cast("string")


def _allowed(a: Column, b: Column, similarity: float) -> Column:
    return F.floor(F.greatest(F.length(a), F.length(b)) * (1 - similarity) + 1e-9).cast("int")


def as_long(a: Column, b: Column, similarity: float) -> Column:
    """Whether two strings' lengths let them have an edit similarity of at least ``similarity``."""
    return F.abs(F.length(a) - F.length(b)) <= _allowed(a, b, similarity)


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two strings have an edit similarity of at least ``similarity``."""
    # with a bound only the band that can stay within it is computed; -1: beyond it
    return as_long(a, b, similarity) & (F.call_function("levenshtein", a, b, _allowed(a, b, similarity)) >= 0)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, fuzzy_words: int = 5, distance: int = 24, similarity: float = 0.8) -> DataFrame:
    """(__id, __text, removed): of each document with lines to remove, their positions (from 0) as an array.

    ``__text`` is the hash of the text: rows with the same id and text count as
    one document. Lines whose normal form has fewer than ``least_chars``
    characters stay. Equal normal forms are one line. Lines of at least
    ``fuzzy_words`` words (with fewer, no word can differ at 0.8) are also linked if they share a block, their
    SimHashes differ in at most ``distance`` bits and the edit similarity of their
    words is at least ``similarity``. Of each connected group the occurrence with the smallest
    id, text hash and position stays.
    """
    with scope() as kept, joint_shuffles(docs.sparkSession):
        # a text is hashed and split here, once: what stands beside a generator is computed again for each row it makes
        texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__whole"))
        split = lambda some: some.select("__id", "__text", F.split("__whole", "\n").alias("__lines"))
        lines = split(texts).select("__id", "__text", F.posexplode("__lines").alias("pos", "line"))
        # no filter here: pushed down, it would make every normal form twice
        hashed = lines.select("__id", "__text", "pos", normal(F.col("line")).alias("norm")).withColumn("norm", F.when(F.length("norm") >= least_chars, F.col("norm")))
        seen = hashed.select("__id", "__text", "pos", F.when(F.col("norm").isNotNull(), F.xxhash64("norm")).alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"), "norm")
        names = [f"f{i}" for i in range(FIRST)]
        seen = materialise(first_words(seen, "norm", fuzzy_words, names), "lines").filter("k1 is not null")
        firsts = [F.min(f).alias(f) for f in names]  # equal lines have equal ones; longs keep the aggregate in generated code
        distinct = materialise(seen.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), *firsts), "distinct")
        nodes = distinct.filter("f0 is not null").withColumnRenamed("k1", "id")

        def describe(ids: DataFrame) -> DataFrame:
            """The SimHash and the symbols of each line, from one document that has it; only lines that are wanted leave the task that cuts them."""
            spot = F.xxhash64("__text", "__id", "pos").alias("spot")
            own = seen.select("__text", spot, F.col("k1").alias("id"))
            at = only(own, ids, "id").groupBy("id").agg(F.min("__text").alias("__text"), F.min_by("spot", F.struct("__text", "spot")).alias("spot")).join(ids, "id")  # a line of very many documents is one row before it is joined
            wanted = materialise(at, "wanted")
            found = split(only(texts, wanted, "__text")).select("__id", "__text", F.posexplode("__lines").alias("pos", "line")).select(spot, "line")
            cut = only(found, wanted, "spot").dropDuplicates(["spot"]).join(wanted.select("spot", "id"), "spot")
            cut = materialise(cut.select("id", normal(F.col("line")).alias("norm")), "cut")
            told = simhashes(cut, ["id"]).join(cut.select("id", symbols(F.col("norm")).alias("symbols")), "id")
            return told.select("id", F.struct("fp", "symbols").alias("about"))

        near = lambda a, b: (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= distance) & as_long(a["symbols"], b["symbols"], similarity)
        verify = lambda a, b: similar(a["symbols"], b["symbols"], similarity)
        linked_table = keyed_components(*blocks(nodes, names), near, describe, verify, anywhere=True)
        linked = linked_table.toDF("k1", "root")
        groups = distinct.join(linked, "k1", "left").filter("n > 1 or root is not null").select("k1", "k2", F.coalesce("root", "k1").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).alias("g2"))
        groups = materialise(groups, "groups")
        many = only(seen.select("__id", "__text", "pos", "k1", "k2"), groups, "k1").join(groups, ["k1", "k2"])
        many = materialise(many.select("__id", "__text", "pos", "g1", F.coalesce("g2", F.lit(0)).alias("g2"), F.col("g2").isNull().alias("g3")), "repeated")
        least = materialise(many.groupBy("g1", "g2", "g3").agg(F.min(F.struct("__id", "__text", "pos")).alias("first")), "first")
        gone = many.join(least, ["g1", "g2", "g3"]).filter(~F.struct("__id", "__text", "pos").eqNullSafe(F.col("first")))
        removed = materialise(gone.groupBy("__id", "__text").agg(F.collect_set("pos").alias("removed")), "removed")
        kept += [removed]
        return removed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without repeated lines, with ``n_lines`` and ``n_removed``, which replace columns of those names.

    See :func:`removed_lines` for what repeats. The lines that stay keep their
    order and bytes. A null text stays null with 0 lines; an empty one is one
    empty line, which stays. A document of which all lines go has an empty
    text. Every row of the input is returned, repeated rows each with the same
    result; ids may be null; an empty table gives an empty result.
    """
    gone = removed_lines(docs, id_col, text_col, **how).withColumnRenamed("removed", "__removed")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text_col).alias("__hash"))
    joined = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")), "left")
    joined = joined.select("*", F.split(text_col, "\n").alias("__lines"))  # once for both columns that need it
    lines = F.col("__lines")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__removed", i)), "\n")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("__removed"), F.lit(0)).alias("n_removed"),
    )
