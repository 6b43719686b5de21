"""SimHash near-duplicate detection: pigeonhole blocks, join on blocks, Hamming check, connected groups; MinHash bands with a Jaccard check add what SimHash does not reach."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .links import connected_components, hamming_components, keyed_components, only
from .scratch import materialise, scope


#: MinHash bands: texts at a Jaccard similarity of 0.8 share at least one of them in 99.98 % of cases.
BANDS, ROWS = 16, 4
CHUNK = 1 << 12
SPACE = " \t\n\x0b\x0c\r"
PIECE, SPACES = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end between words, so memory doesn't grow with a text."""
    at = 0
    while at < len(text):
        gap = SPACES.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _digests(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of ``text``, some at a time; a text of fewer words is one shingle."""
    digest, held, any_whole = xxhash.xxh64_intdigest, [], False
    for piece in _pieces(text):
        w = held + piece.lower().split()  # bytes: only A-Z change, only ASCII white space splits
        if len(w) < words:
            held = w
            continue
        whole, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = list(zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True))
        view, any_whole = memoryview(whole), True
        held = w[len(w) - words + 1 :] if words > 1 else []
        for at in range(0, len(spans), CHUNK):
            yield np.array([digest(view[s:e], 42) for s, e in spans[at : at + CHUNK]], np.uint64)
    if held and not any_whole:
        yield np.array([digest(b" ".join(held), 42)], np.uint64)


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(0).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: bytes, words: int, bands: bool = False) -> tuple[int, list[int] | None]:
    """SimHash of the word shingles of ``text`` (a bit is 1 if it is set in over half of their XXH64) and, with ``bands``, the hashes of its MinHash bands; 0 and none of a text without words."""
    ones, n, least = np.zeros(64, np.int64), 0, np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for h in _digests(text, words):
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if bands:
            least = np.minimum(least, (_multipliers() * (h ^ (h >> np.uint64(32)))).min(axis=1))
    fp = int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)
    if not bands or not n:
        return fp, None
    return fp, [int.from_bytes(xxhash.xxh64_digest(band.tobytes(), i), "big", signed=True) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def simhash(text: bytes, words: int) -> int:
    return signature(text, words)[0]


def fingerprints(docs: DataFrame, words: int, carry: list[str], text_col: str = "text", bands: bool = False) -> DataFrame:
    """``carry`` and fp (long) of each row, and bands (longs) if asked for; null text counts as empty, whose fingerprint is 0 and whose bands are null."""
    given = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("fp", T.LongType()), *([T.StructField("bands", T.ArrayType(T.LongType()))] if bands else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(carry)).cast(pa.large_binary())
            made = [signature(t.as_py() or b"", words, bands) for t in texts]
            more = [pa.array([m[1] for m in made], pa.list_(pa.int64()))] if bands else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([m[0] for m in made], pa.int64()), *more], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, about) of (id, text): hashes of the distinct word shingles of a text, cut as those of :func:`signature`.

    The words are a column of their own, because what a lambda names is computed again for each element.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    cut = texts.select("id", F.split(F.btrim(lower, F.lit(SPACE)), "[ \\t-\\r]+").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    return cut.select("id", F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))).alias("about"))


def bounded(a: Column, b: Column, jaccard: float) -> Column:
    """Whether the sizes of two sets allow a Jaccard similarity of ``jaccard``."""
    return F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * jaccard - 1e-9


def alike(a: Column, b: Column, jaccard: float) -> Column:
    """Whether two sets have a Jaccard similarity of at least ``jaccard``."""
    sizes, both = F.size(a) + F.size(b), F.size(F.array_intersect(a, b))
    return bounded(a, b, jaccard) & (both >= (sizes - both) * jaccard - 1e-9)


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 4, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), jaccard: float | None = None) -> DataFrame:
    """(id_col, carry, fp, component_id, component) of each row of ``docs``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked and,
    with ``jaccard``, rows whose shingle sets have at least that similarity
    and that share a MinHash band;
    ``component_id`` is the least id reachable and
    ``component`` the least fingerprint. The 64 bits are cut into
    ``blocks`` (default: two more than ``distance``). Rows repeat as in the
    input; null or blank texts share fingerprint 0 and are linked like any
    others; null ids are carried and never name a component unless nothing else
    does. Other columns of ``docs`` are not read. An empty table gives an empty
    result.
    """
    with scope() as kept:
        given = docs if jaccard is None else docs.withColumn("__set", F.xxhash64(text_col))
        marked = materialise(fingerprints(given, words, [id_col, *carry, *([] if jaccard is None else ["__set"])], text_col, jaccard is not None), "fingerprints")
        least = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
        groups = hamming_components(least.select(F.col("fp").alias("id")), distance, blocks or distance + 2)
        if jaccard is not None:
            sets = materialise(marked.filter("bands is not null").groupBy(F.col("__set").alias("id")).agg(F.min("fp").alias("fp"), F.min("bands").alias("bands")), "sets")
            texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("id"), F.col(text_col).alias("text"))

            def shingles(ids: DataFrame) -> DataFrame:
                return shingle_sets(only(texts, ids, "id").join(ids, "id").groupBy("id").agg(F.min("text").alias("text")), words)

            keys = [F.xxhash64(F.lit(i), F.get("bands", F.lit(i))) for i in range(BANDS)]
            found = keyed_components(sets, keys, lambda a, b: bounded(a, b, jaccard), shingles, lambda a, b: alike(a, b, jaccard))
            of = sets.select("id", "fp")
            close = found.toDF("id", "root").join(of.toDF("id", "u"), "id").join(of.toDF("root", "v"), "root").select("u", "v")
            groups = connected_components(groups.toDF("u", "v").unionByName(close))
        roots = groups.toDF("fp", "root").join(least, "fp").groupBy("root").agg(F.min("first").alias("least"))
        linked = groups.toDF("fp", "root").join(roots, "root").select("fp", "root", "least")
        named = materialise(least.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("least", "first").alias("component_id")), "named")
        kept += [marked, named]
        return marked.join(named, "fp").select(id_col, *carry, "fp", "component_id", "component")


def drop_near_duplicates(docs: DataFrame, words: int = 5, distance: int = 6, blocks: int = 9, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """The rows of ``docs`` that represent their component: of each, one row of its least id (of several: the one whose text has the smallest hash).

    All columns stay. Of rows that repeat one stays; rows that share an id and
    differ, and rows with null ids, belong to components like all others.
    """
    with scope() as kept:
        hashed = docs.withColumn("__hash", F.xxhash64(text_col))
        found = near_duplicates(hashed, words, distance, blocks, id_col, text_col, ("__hash",), jaccard)
        stays = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("component", "component_id").agg(F.min("__hash").alias("__kept"))
        stays = materialise(stays.select(F.col("component_id").alias("__id"), "__kept"), "stays")
        kept += [stays]
        rest = hashed.join(stays, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__kept")))
        once = Window.partitionBy(id_col, "__hash").orderBy(F.lit(1))
        return rest.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
