"""Exact top-k inner products by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import count_blocks, first_rows, in_blocks, rows_of, usable, widen
from .scratch import materialise, release, scope

SCHEMA = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("part", pa.int64())])
DDL = "query long, row long, part long"
BITS = pa.schema([("block", pa.int32()), ("q", pa.int32()), ("bits", pa.binary())])
BITS_DDL = "block int, q int, bits binary"
LIMIT, CHUNK = 2.0**52, 1 << 14
#: Pairs of a row and a query that one round looks at; each list marks them in at most an eighth as many bytes.
PAIRS = 1 << 31
#: What stands before a query's vector: its cutoff, and the first and last row of its own id.
HEAD = 3


def _floats_do(q: np.ndarray, x: np.ndarray) -> bool:
    return q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < LIMIT


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all pairs of rows. Exact: as floats while they hold every sum, else as integers."""
    wide = max(q.shape[1], x.shape[1])
    q, x = widen(q, wide), widen(x, wide)
    if not _floats_do(q, x):
        q, x = (np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (q, x))
    return q @ x.T if wide else np.zeros((len(q), len(x)))


def _held(score: np.ndarray) -> np.ndarray:
    top = np.iinfo(np.int64)
    return np.array([min(max(int(v), top.min), top.max) for v in score], np.int64) if score.dtype == object else score.astype(np.int64)


def _batch(query: list, row: list, part: list) -> pa.RecordBatch:
    cat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(x), pa.int64()) for x in (query, row, part)], schema=SCHEMA)


def _best(own: int, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, part) of the ``k`` largest scores, ties to the first rows; rows ascend."""
    if len(rows) > k:
        least = np.partition(score, len(rows) - k)[len(rows) - k]
        over = np.flatnonzero(score > least)
        at = np.concatenate((over, np.flatnonzero(score == least)[: k - len(over)]))
        rows, score = rows[at], score[at]
    return np.full(len(rows), own, np.int64), rows, _held(score)


def _others(rows: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Which rows are not of the query's own id; rows are numbered in the order of ids."""
    return (rows < lo) | (rows > hi)


def _with_queries(blocks: DataFrame, asked: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``run`` on each block of rows with the blocks of queries of a round, which every task holds; the rows' blocks stay where they are."""
    packed = asked.agg(F.collect_list(F.struct(F.col("block").alias("q"), "ids", "data")).alias("asked"))  # one row of a bounded number of queries

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1).to_pylist()[0]
                rows, x = rows_of(one)
                for of in one["asked"]:
                    yield run(one["block"], rows, x, of["q"], *rows_of(of))

    return blocks.crossJoin(F.broadcast(packed)).mapInArrow(each, ddl)


def _resolve(pairs: DataFrame, blocks: DataFrame, lefts: int) -> DataFrame:
    """(query, row, part): the whole score of each of the pairs (query, row, vector of the query), by blocks of whole vectors."""

    def run(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return SCHEMA.empty_table()
        ids, x = rows_of(held.to_pylist()[0])
        query, row = wanted.column("query").to_numpy(), wanted.column("row").to_numpy()
        j, parts = np.searchsorted(ids, row), []
        for at in range(0, len(j), CHUNK):
            flat = wanted.column("vector").slice(at, CHUNK).to_pylist()
            wide = max(x.shape[1], *(len(v) for v in flat))
            u, v = np.zeros((len(flat), wide)), widen(x[j[at : at + CHUNK]], wide)
            for a, b in zip(u, flat, strict=True):
                a[: len(b)] = b
            if _floats_do(u, v):
                parts.append(np.einsum("nd,nd->n", u, v).astype(np.int64))
            else:
                parts.append(_held(np.array([sum(int(m) * int(n) for m, n in zip(f, g, strict=True)) for f, g in zip(u, v, strict=True)], object)))
        return pa.Table.from_arrays([pa.array(query), pa.array(row), pa.array(np.concatenate(parts))], schema=SCHEMA)

    block = F.pmod(F.xxhash64("row"), F.lit(lefts)).cast("int")  # as in_blocks deals them
    asked = pairs.select(block.alias("block"), "query", "row", "vector")
    return asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(run, DDL)


def top_scores(vectors: DataFrame, queries, k: int = 5, scale: int = 256, lists: int = 4, block_rows: int = 8192, blocks: int = 4, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): of each id that the condition ``queries`` on ``id_col`` names, the ``k`` best other rows.

    Components become floor(scale * x) and scores are their integer inner
    products; ties go to the smaller id. The components are cut into ``lists``
    runs, each a list of partial scores that tasks of its own hold (at least ``blocks`` blocks of
    about ``block_rows`` rows). Phase one gathers the ``k`` top entries of
    every block of every list and resolves the scores of each list's best; a query's k-th best score t is a safe
    cutoff, sent to all lists with the query. Phase two collects the
    entries with a partial score of t / lists or more, one bit each: a row without one scores below t.
    Phase three resolves the rows that a list marked and keeps the best. Queries go in rounds of whole blocks
    of ``query_rows``, about PAIRS pairs each, so what lies between the phases doesn't grow with the queries.
    Rows with a null id and
    vectors that are null or hold a null or non-finite component take no part; a
    shorter vector counts as padded with zeros; rows that share an id count each
    for itself, but are never a query's own candidates, and the least of their
    vectors is the query. Scores beyond a long are
    held at its limits. An empty table gives no rows.
    """
    with scope() as kept:
        whole = usable(vectors, id_col, vector_col).select("id", F.transform("vector", lambda v: F.floor(v * scale).cast("double")).alias("vector"))
        whole = materialise(whole.sort("id").withColumn("row", F.monotonically_increasing_id()), "integers")
        asked = whole.withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "id").groupBy("id").agg(F.min(F.struct("vector", "row")).alias("q"), F.min("row").alias("lo"), F.max("row").alias("hi"))
        asked = materialise(asked.select("id", F.col("q.row").alias("row"), "lo", "hi", F.col("q.vector").alias("vector")), "asked")
        n, wide = whole.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        cuts = np.linspace(0, wide or 0, lists + 1).astype(int)
        lefts, rights = count_blocks(n, block_rows, blocks), count_blocks(asked.count(), query_rows, 1)
        run_of = lambda c, i: F.slice(c, int(cuts[i]) + 1, int(cuts[i + 1] - cuts[i]))
        in_files = lambda rows: materialise(in_blocks(rows.withColumnRenamed("row", "id"), lefts).repartition(lefts, "block"), "blocks")  # noqa: E731  a file a block
        held = [in_files(whole.select("row", run_of("vector", i).alias("vector"))) for i in range(lists)]
        full = in_files(whole.select("row", "vector"))
        names = whole.select("row", "id")

        def best(block: int, rows: np.ndarray, x: np.ndarray, q: int, who: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            part, out = _products(of[:, HEAD:], x), []
            for own, (_, lo, hi), p in zip(who, of[:, :HEAD], part, strict=True):
                other = _others(rows, lo, hi)
                out.append(_best(own, rows[other], p[other], k))
            return _batch(*([a[i] for a in out] for i in range(3)))

        def marked(block: int, rows: np.ndarray, x: np.ndarray, q: int, who: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            part = _products(of[:, HEAD:], x)
            bits = np.packbits((part * lists >= of[:, :1]).astype(bool), axis=None).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([q], pa.int32()), pa.array([zlib.compress(bits, 1)], pa.binary())], schema=BITS)

        def last(found: pa.Table, of: pa.Table) -> pa.Table:
            if not found.num_rows:
                return SCHEMA.empty_table()
            rows, x = rows_of(of.to_pylist()[0])
            marks: dict[int, np.ndarray] = {}
            asked: dict[int, dict] = {}
            for r in found.to_pylist():
                if r["data"] is not None:
                    asked[r["q"]] = r
                bits = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
                marks[r["q"]] = marks[r["q"]] | bits if r["q"] in marks else bits
            out = []
            for q, block in asked.items():
                who, v = rows_of(block)
                mark = np.unpackbits(marks[q], count=len(who) * len(rows)).astype(bool).reshape(len(who), len(rows))
                score = _products(v[:, HEAD:], x)
                for own, (_, lo, hi), m, s in zip(who, v[:, :HEAD], mark, score, strict=True):
                    m &= _others(rows, lo, hi)
                    out.append(_best(own, rows[m], s[m], k))
            return pa.Table.from_batches([_batch(*([a[i] for a in out] for i in range(3)))])

        def armed(rows: DataFrame, vector, name: str) -> DataFrame:
            """Blocks of queries (row, cut, lo, hi, vector) with those three as first components."""
            head = F.array("cut", F.col("lo").cast("double"), F.col("hi").cast("double"))
            return in_blocks(rows.select(F.col("row").alias("id"), F.concat(head, vector).alias("vector")), rights)

        def all_lists(rows: DataFrame, run: Callable, ddl: str) -> list[DataFrame]:
            return [_with_queries(held[i], armed(rows, run_of("vector", i), "run"), run, ddl) for i in range(lists)]

        none = F.lit(float("-inf"))
        each, tops = max(1, PAIRS // max(n * query_rows, 1)), []
        for at in range(0, rights, each):
            own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(rights)).between(at, at + each - 1))
            first = None
            for entries in all_lists(own.withColumn("cut", none), best, DDL):
                some = first_rows(entries, "query", 4 * k, F.desc("part"), "row").select("query", "row")
                first = some if first is None else first.unionByName(some)
            pairs = first.distinct().join(own.select(F.col("row").alias("query"), "vector"), "query")
            known = first_rows(_resolve(pairs, full, lefts), "query", k, F.desc("part"), "row").filter(F.col("rank") == k)
            cutoff = materialise(known.select(F.col("query").alias("row"), F.col("part").alias("cutoff")), "cutoffs")
            c = F.col("cutoff").cast("double")
            low = F.when(F.col("cutoff") > -(1 << 62), c - F.abs(c) * 1e-15 - 1).otherwise(none)  # a double of a large long may be above it; at a long's lower limit there is none
            cut = materialise(own.join(cutoff, "row", "left").withColumn("cut", F.coalesce(low, none)).drop("cutoff"), "cut")  # nor for a query with fewer than k entries
            bits = None
            for i, found in enumerate(all_lists(cut, marked, BITS_DDL)):
                if i == 0:
                    whole_of = armed(cut, F.col("vector"), "whole").select(F.col("block").alias("q"), "ids", "data")
                    found = found.join(F.broadcast(whole_of), "q")  # the round's queries
                else:
                    found = found.withColumns({"ids": F.lit(None).cast("binary"), "data": F.lit(None).cast("binary")})
                bits = found if bits is None else bits.unionByName(found)
            resolved = bits.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(last, DDL)
            tops.append(materialise(first_rows(resolved, "query", k, F.desc("part"), "row"), "top"))
            release(cutoff, cut)
        top = tops[0]
        for more in tops[1:]:
            top = top.unionByName(more)
        ids = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
        named = materialise(top.join(names, "row").join(ids, "query").select("query_id", "rank", F.col("id").alias(id_col), F.col("part").alias("score")), "named")
        kept.append(named)
        return named
