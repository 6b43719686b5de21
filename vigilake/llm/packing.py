"""Sequence packing along a Hilbert curve through projected document vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, partitions, scope

DIMENSIONS, BITS, HASHED = 4, 10, 512
#: Characters below this: both libraries split them alike. Texts with others, or with an added token's own text, go to the reference tokenizer.
PLAIN = 0x250


@cache
def _encoder(model: str, ranks: str | None):
    """A function from a text to its ids as an array; ``ranks``: the same vocabulary for the faster library."""
    import base64
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(model))
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    slow = lambda t: exact.encode(t, add_special_tokens=False).ids
    if ranks is None:
        return slow
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    plain = lambda t: (t.isascii() or ord(max(t)) < PLAIN) and not any(a in t for a in added)
    return lambda t: fast.encode_ordinary(t) if plain(t) else slow(t)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of unsigned coordinates (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (HASHED, DIMENSIONS))


def _key(vectors: np.ndarray) -> np.ndarray:
    v = np.log1p(vectors)
    v -= v.mean(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
    at = 1 / (1 + np.exp(-1.7 * (v @ _projection())))  # near-uniform in (0, 1)
    return hilbert_key(np.clip((at * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, model: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every row's tokens.

    Each row's ids and ``end_id`` are laid end to end in the order of the rows'
    Hilbert keys (equal keys: input order) and cut at every ``length`` ids, so
    only the last sequence has padding. ``ids`` holds little-endian unsigned
    32-bit ids. A null or empty text is one ``end_id``. Rows that repeat, or
    share an id, are packed each for itself; a null id is carried. Other columns
    are not read. An empty table gives an empty result.
    """
    with scope() as kept:
        spark = docs.sparkSession
        kind = docs.schema[id_col].dataType.simpleString()

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _encoder(model, ranks)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    ids, sizes = [], []
                    vectors = np.zeros((b.num_rows, HASHED))
                    for i, t in enumerate(b.column(2)):
                        own = np.array([*encode(t.as_py() or ""), end_id], np.uint32)
                        vectors[i] = np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(23), minlength=HASHED)
                        sizes.append(len(own))
                        ids.append((own.astype("<u2") if own.max() < 1 << 16 else own.astype("<u4")).tobytes())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_key(vectors), pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["row", "id", "key", "n", "ids"])

        rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.col(text_col))
        known = materialise(rows.mapInArrow(tokens, f"`__row` long, `__id` {kind}, `__key` long, `__n` long, `__ids` binary"), "tokens")

        sorted_keys = known.select("__row", "__key", "__n").repartitionByRange(partitions(spark), "__key", "__row").sortWithinPartitions("__key", "__row")
        line = materialise(sorted_keys.withColumn("__part", F.spark_partition_id()), "curve")
        sums = {r["__part"]: r["n"] for r in line.groupBy("__part").agg(F.sum("__n").alias("n")).collect()}  # one number a partition
        base, run = {}, 0
        for part in sorted(sums):
            base[part], run = run, run + sums[part]

        def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at = None, 0
            for b in batches:
                part_ids, n = b.column(3).to_numpy(), b.column(2).to_numpy()
                begins = np.empty(len(n), np.int64)
                for own in np.unique(part_ids):
                    here = np.flatnonzero(part_ids == own)
                    if own != part:
                        part, at = own, base[own]
                    before = np.cumsum(n[here]) - n[here]
                    begins[here] = at + before
                    at += int(n[here].sum())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(begins)], names=["row", "begin"])

        ordered = line.repartition(partitions(spark), "__part").sortWithinPartitions("__part", "__key", "__row").select("__row", "__key", "__n", "__part")
        begins = materialise(ordered.mapInArrow(offsets, "`__row` long, `__begin` long"), "begins")

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    out: list[list] = [[] for _ in range(6)]
                    of = []
                    for i, (n, raw, begin) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                        own = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                        s = 0
                        while s < n:
                            place = (begin + s) % length
                            size = min(n - s, length - place)
                            for col, v in zip(out, (s, size, own[4 * s : 4 * (s + size)], n, (begin + s) // length, place), strict=True):
                                col.append(v)
                            of.append(i)
                            s += size
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kept += [known, begins]
        cut = known.join(begins, "__row").select("__id", "__n", "__ids", "__begin")
        return cut.mapInArrow(pieces, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
