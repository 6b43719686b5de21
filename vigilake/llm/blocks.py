"""Vectors in blocks of bounded size, and every block against every block of queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>) of the rows with an id and a vector of which all components are finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter("id is not null and vector is not null").filter(~bad)


def count_blocks(n: int, most: int, least: int) -> int:
    return max(least, math.ceil(n / most))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows; shorter ones are padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max()) if len(sizes) else 0
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def widen(x: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x


def rows_of(block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 rows of a plain block."""
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["data"], np.float64).reshape(len(ids), -1)


def in_blocks(rows: DataFrame, blocks: int, build: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
    """(block, ids, data): rows (id, vector) dealt by a hash of the id; data: float64 rows, or what ``build`` makes of ids and rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, vectors = table.column("id").to_numpy(), matrix(table.column("vector").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        data = build(ids, vectors) if build else vectors.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data], pa.binary())], names=["block", "ids", "data"])

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, data binary")


def every_pair(left: DataFrame, right: DataFrame, lefts: int, rights: int, run: Callable[[dict, dict], pa.RecordBatch], schema: pa.Schema, ddl: str) -> DataFrame:
    """``run`` on each block of ``left`` with each block of ``right``; a task holds one pair of blocks at a time."""

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_batches([run(x, y) for x in a.to_pylist() for y in b.to_pylist()], schema)

    a = left.select(F.col("block").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(rights - 1))).alias("r"), "ids", "data")
    b = right.select(F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("l"), F.col("block").alias("r"), "ids", "data")
    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInArrow(pair, ddl)


def first_rows(rows: DataFrame, by: str, keep: int, *order) -> DataFrame:
    """The ``keep`` first rows of each ``by``, as ``rank`` from 1; the limit already holds in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= keep)
