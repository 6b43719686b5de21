"""Approximate nearest neighbours: a navigable small-world graph per shard, as flat arrays; shard results are merged."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import count_blocks, every_pair, first_rows, in_blocks, rows_of, usable, widen
from .scratch import materialise, scope

CANDIDATES, CHUNK = 48, 512
#: Starts of a search: rows of the largest norm, nearest rows of the lowest layer that has at most WHOLE rows.
HEADS, STARTS, WHOLE = 32, 8, 1024


def _layer(x: np.ndarray, degree: int) -> np.ndarray:
    """Neighbour array (rows, degree), -1 where there is none, of a graph over the rows of ``x`` by cosine of equal norms.

    Each row takes its nearest rows that are not nearer to one already taken
    (so links point in different directions), then the other nearest, and gets
    links back; what exceeds the degree falls off, farthest first.
    """
    n, k = len(x), min(len(x) - 1, CANDIDATES)
    if k <= 0:
        return np.full((n, degree), -1, np.int32)
    ends = []
    for at in range(0, n, CHUNK):
        sim = x[at : at + CHUNK] @ x.T
        rows = np.arange(len(sim))
        sim[rows, rows + at] = -np.inf
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sim, axis=1)[:, :k]
        own = np.take_along_axis(sim, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        among = x[near] @ x[near].transpose(0, 2, 1)
        taken = np.zeros(near.shape, bool)
        for j in range(k):
            hidden = (taken & (among[:, j, :] > own[:, j, None])).any(axis=1)
            taken[:, j] = ~hidden & (taken.sum(axis=1) < degree // 2)
        taken |= np.arange(k) < degree // 4
        r, c = np.nonzero(taken)
        ends.append(np.stack([r + at, near[r, c], own[r, c]]))
    u, v, s = np.concatenate(ends, axis=1)
    u, v = u.astype(np.int64), v.astype(np.int64)
    both, first = np.unique(np.concatenate([u * n + v, v * n + u]), return_index=True)
    u, v, s = both // n, both % n, np.concatenate([s, s])[first]
    order = np.lexsort((-s, u))
    u, v = u[order], v[order]
    place = np.arange(len(u)) - np.searchsorted(u, u)
    out = np.full((n, degree), -1, np.int32)
    fits = place < degree
    out[u[fits], place[fits]] = v[fits]
    return out


def _largest(x: np.ndarray, degree: int) -> np.ndarray:
    """Array (rows, degree) of the other rows with the largest inner product to each, -1 where there are fewer."""
    n, k = len(x), min(len(x) - 1, degree)
    out = np.full((n, degree), -1, np.int32)
    for at in range(0, n if k > 0 else 0, CHUNK):
        sim = x[at : at + CHUNK] @ x.T
        rows = np.arange(len(sim))
        sim[rows, rows + at] = -np.inf
        out[at : at + len(sim), :k] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return out


def build_index(ids: np.ndarray, x: np.ndarray, degree: int = 32) -> bytes:
    """Vectors, layer members, starts and flat neighbour arrays of one shard.

    A row's top layer is drawn from a hash of its id. Inner products become
    cosines by one more component that brings all rows to the largest norm. Where norms differ
    the largest inner products lie far from a row by that measure, so on the lowest layer a quarter of
    the links are by it, a quarter by direction alone and half go to the largest inner products, and a search also starts at the HEADS
    rows of the largest norm.
    """
    square = (x**2).sum(axis=1)
    even = np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], axis=1)
    way = x / np.sqrt(np.maximum(square, 1e-300))[:, None]
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    level = (-np.log(((mixed >> np.uint64(11)).astype(float) + 1) / 2**53) / np.log(degree / 2)).astype(int)
    level[0] = max(1, level.max())
    lowest = np.concatenate([_layer(even, degree // 4), _layer(way, degree // 4), _largest(x, degree // 2)], axis=1)
    arrays = {"x": x, "top": np.array([level.max()]), "n0": lowest, "heads": np.argsort(-square, kind="stable")[:HEADS].astype(np.int32)}
    for i in range(1, level.max() + 1):
        members = np.flatnonzero(level >= i)
        arrays[f"m{i}"], arrays[f"n{i}"] = members.astype(np.int32), _layer(even[members], degree // 2)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def search(index: dict, q: np.ndarray, beam: int, expand: int = 4) -> np.ndarray:
    """Row numbers (queries, beam) found nearest by inner product, in any order; -1 where there are fewer."""
    x = index["x"].astype(np.float32)
    q = q.astype(np.float32)
    small = next(i for i in range(1, int(index["top"][0]) + 1) if i == int(index["top"][0]) or len(index[f"m{i}"]) <= WHOLE)
    members = index[f"m{small}"].astype(np.int64)  # few: compared whole, so that a search starts near several groups of rows
    near_members = q @ x[members].T
    few = min(STARTS, len(members))
    first = np.argpartition(-near_members, few - 1, axis=1)[:, :few]
    order = np.argsort(-np.take_along_axis(near_members, first, 1), axis=1, kind="stable")
    starts = members[np.take_along_axis(first, order, 1)]
    at = starts[:, 0]
    for i in range(small - 1, 0, -1):  # greedy descent
        members, near = index[f"m{i}"], index[f"n{i}"]
        spot = np.searchsorted(members, at)  # a row of a layer is in all layers below
        best, live = np.einsum("qd,qd->q", q, x[members[spot]]), np.arange(len(q))
        while len(live):
            ring = near[spot[live]]
            sim = np.einsum("qd,qkd->qk", q[live], x[members[ring]])
            sim[ring < 0] = -np.inf
            j = sim.argmax(axis=1)
            value = sim[np.arange(len(live)), j]
            better = value > best[live]
            live, j, value = live[better], j[better], value[better]
            best[live], spot[live] = value, near[spot[live], j]
        at = members[spot].astype(np.int64)
    near, n = index["n0"], len(x)
    seen = np.zeros((len(q), n + 1), bool)  # the last column stands for none
    found = np.full((len(q), beam), n, np.int64)
    sims = np.full((len(q), beam), -np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    begin = np.concatenate([at[:, None], starts, np.broadcast_to(index["heads"].astype(np.int64), (len(q), len(index["heads"])))], axis=1)[:, :beam]
    begin = np.sort(begin, axis=1)
    begin[:, 1:][begin[:, 1:] == begin[:, :-1]] = n
    m = begin.shape[1]
    sim = np.einsum("qd,qkd->qk", q, x[np.minimum(begin, n - 1)])
    found[:, :m], sims[:, :m], done[:, :m] = begin, np.where(begin < n, sim, -np.inf), begin == n
    np.put_along_axis(seen, begin, True, 1)
    seen[:, n] = True
    padded = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
    live = np.arange(len(q))
    while True:
        live = live[~done[live].all(axis=1)]
        if not len(live):
            break
        open_sims = np.where(done[live], -np.inf, sims[live])
        j = np.argpartition(-open_sims, expand - 1, axis=1)[:, :expand] if expand < beam else np.argsort(-open_sims, axis=1)[:, :expand]
        mine = np.isfinite(np.take_along_axis(open_sims, j, 1))
        nodes = np.where(mine, np.take_along_axis(found[live], j, 1), n)
        state = done[live]
        np.put_along_axis(state, j, True, 1)
        done[live] = state
        ring = np.where((nodes < n)[:, :, None], near[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1).astype(np.int64)
        ring = np.sort(np.where(ring < 0, n, ring), axis=1)
        ring[:, 1:][ring[:, 1:] == ring[:, :-1]] = n
        ring[seen[live[:, None], ring]] = n
        seen[live[:, None], ring] = True
        sim = np.einsum("qd,qkd->qk", q[live], padded[ring])
        sim[ring == n] = -np.inf
        every, each = np.concatenate([sims[live], sim], axis=1), np.concatenate([found[live], ring], axis=1)
        flags = np.concatenate([done[live], ring == n], axis=1)
        top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims[live], found[live], done[live] = (np.take_along_axis(a, top, 1) for a in (every, each, flags))
    return np.where(found == n, -1, found)


def nearest(vectors: DataFrame, queries, k: int = 20, beam: int = 96, shard_rows: int = 4096, shards: int = 16, query_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): of each row that the condition ``queries`` on ``id_col`` names, the ``k`` nearest other rows found.

    Nearness is the inner product, in double precision on the vectors as given;
    ties go to the smaller id. There are at least ``shards`` shards of about
    ``shard_rows`` distinct vectors, each with its own graph, and each query
    searches all with a beam of ``beam`` (shards of four times as many rows lose a
    third of the neighbours of clustered rows, see README). Equal vectors are one node with its
    k + 1 smallest ids, as many as an answer can hold, so copies neither crowd
    the graph nor are lost. Rows with a null id and vectors that are null, zero
    or hold a null or non-finite component take no part; a shorter vector counts
    as padded with zeros; rows that share an id and differ are all candidates.
    An empty table, or no other row, gives no rows.
    """
    with scope() as kept:
        rows = usable(vectors, id_col, vector_col).filter(F.exists("vector", lambda v: v != 0))
        copies = materialise(first_rows(rows, "vector", k + 1, "id").groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "copies")
        nodes = copies.select(F.col("ids")[0].alias("id"), "vector")
        asked = materialise(rows.withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "id"), "asked")
        distinct = materialise(asked.groupBy("vector").agg(F.min("id").alias("id")), "queries")
        lefts, rights = count_blocks(nodes.count(), shard_rows, shards), count_blocks(distinct.count(), query_rows, 1)
        index = materialise(in_blocks(nodes, lefts, build_index), "index")
        schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])

        def run(shard: dict, block: dict) -> pa.RecordBatch:
            ids = np.frombuffer(shard["ids"], np.int64)
            arrays = dict(np.load(io.BytesIO(shard["data"])))
            who, q = rows_of(block)
            wide = max(q.shape[1], arrays["x"].shape[1])
            q, arrays["x"] = widen(q, wide), widen(arrays["x"], wide)
            out = []
            for at in range(0, len(q), CHUNK):
                part = q[at : at + CHUNK]
                hits = search(arrays, part, min(beam, len(ids)))
                score = np.einsum("qd,qkd->qk", part, arrays["x"][np.maximum(hits, 0)])
                score[hits < 0] = -np.inf
                named = np.where(hits < 0, np.iinfo(np.int64).max, ids[np.maximum(hits, 0)])
                order = np.lexsort((named, -score), axis=1)[:, : k + 1]
                score, named = np.take_along_axis(score, order, 1), np.take_along_axis(named, order, 1)
                r, c = np.nonzero(np.isfinite(score))
                out.append((who[at + r], named[r, c], score[r, c]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out, strict=True)], schema=schema)

        found = every_pair(index, in_blocks(distinct, rights), lefts, rights, run, schema, "query long, node long, score double")
        best = first_rows(found, "query", k + 1, F.desc("score"), "node").drop("rank")
        spread = best.join(copies.select(F.col("ids")[0].alias("node"), "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
        top = first_rows(spread, "query", k + 1, F.desc("score"), "id")
        hits = materialise(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("hits")), "hits")
        kept += [asked, distinct, hits]
        named = distinct.withColumnRenamed("id", "query").join(hits, "query").select("vector", "hits")
        own = asked.join(named, "vector").select(F.col("id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
        return own.select("query_id", F.posexplode("hits").alias("p", "h")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.id").alias(id_col), F.col("h.score").alias("score"))
