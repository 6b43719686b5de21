"""Exact substring dedup: names of growing prefixes at sampled suffixes, kept while they are shared.

Prefix doubling gives every suffix a name for its first 1, 2, 4, ... bytes from
the names at two offsets, and drops suffixes whose name is theirs alone. Names of
all positions would take many times the input, so the first names that leave a
task are those of 24 bytes at minimizers: of the 27 such names in a window of 50
bytes, the least. Two equal windows have the same one, so windows whose name is
in one text only are settled. For the others the bytes around the name go to
one place, where the names grow to the full 50 bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, scope

SPAN, NAME = 50, 24
CHUNK = 1 << 20
FEW = 8
_B = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def _doubled(a: np.ndarray, parts: list[int]) -> np.ndarray:
    """Names (polynomial hashes) of the ``sum(parts)`` bytes at each position; parts: falling powers of two."""
    h, size, by = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, {}
    while size <= parts[0]:
        if size in parts:
            by[size] = h
        if len(h) > size:
            h = h[:-size] * _power(size) + h[size:]
        else:
            h = h[:0]
        size *= 2
    n, at, total = len(a) - sum(parts) + 1, 0, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    for p in parts:
        own = by[p][at : at + n]
        total = own if total is None else total * _power(p) + own
        at += p
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _least_names(a: np.ndarray) -> np.ndarray:
    """For each window of SPAN bytes, the least name of NAME bytes within."""
    m, wide, size = _doubled(a, [16, 8]), SPAN - NAME + 1, 1
    while size * 2 <= wide:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = wide - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _runs(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and of each maximal run of windows with one least name: text, first window (in the bytes), last window, name."""
    sizes = np.array([len(d) for d in datas])
    a = np.frombuffer(b"".join(datas), np.uint8)
    none = np.zeros(0, np.int64)
    if len(a) < SPAN:
        return a, none, none, none, none.astype(np.uint64)
    text = np.repeat(np.arange(len(datas), dtype=np.int32), sizes)
    least = _least_names(a)
    inside = text[: len(least)] == text[SPAN - 1 :]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new, True) | np.append(~inside, True))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    return a, text[first].astype(np.int64), first, last, least[first]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _pieces(datas: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts, long ones in pieces of CHUNK bytes that overlap by a window less one byte; each piece's text and where it begins there."""
    pieces, of, begin = [], [], []
    for i, d in enumerate(datas):
        for at in range(0, max(1, len(d) - SPAN + 1) if len(d) > CHUNK else 1, CHUNK):
            pieces.append(d[at : at + CHUNK + SPAN - 1] if len(d) > CHUNK else d)
            of.append(i)
            begin.append(at)
    return pieces, np.array(of, np.int64), np.array(begin, np.int64)


def _starts(ordered: np.ndarray, *more: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = False
    for x in (ordered, *more):
        new[1:] |= x[1:] != x[:-1]
    return new


def _table(batches) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks() if batches else None


def _named(buckets: int):
    """(bucket, sure, uids, names) of each chunk of texts: the texts' distinct names, by bucket.

    Of a name that more than FEW texts of the chunk have, two go to its bucket;
    the others are sure to be shared, and only pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            uids = b.column(0).to_numpy()
            datas, of, _ = _pieces(b.column(1).to_pylist())
            uids = uids[of]
            for i, j in _chunks([len(d) for d in datas]):
                _, text, _, _, name = _runs(datas[i:j])
                order = np.lexsort((text, name))
                text, name = text[order], name[order]
                own = _starts(name, text)
                text, name = text[own], name[own]
                if not len(name):
                    continue
                begin = np.flatnonzero(_starts(name))
                size = np.diff(np.append(begin, len(name)))
                place = np.arange(len(name)) - np.repeat(begin, size)
                sure = (np.repeat(size, size) > FEW) & (place >= 2)
                bucket = (name % np.uint64(buckets)).astype(np.int32)
                turn += 1
                bucket[sure] = turn % buckets
                order = np.lexsort((text, sure, bucket))
                uid, name, bucket, sure = uids[i:j][text[order]], name[order], bucket[order], sure[order]
                cut = np.append(np.flatnonzero(_starts(bucket, sure)), len(name))
                pairs = list(zip(cut, cut[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[s]) for s, _ in pairs], pa.int32()), pa.array([bool(sure[s]) for s, _ in pairs]), pa.array([uid[s:e].tobytes() for s, e in pairs], pa.binary()), pa.array([name[s:e].tobytes() for s, e in pairs], pa.binary())],
                    names=["bucket", "sure", "uids", "names"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, names): each text's names that another text has too."""
    table = _table(batches)
    uids = [np.frombuffer(x, np.int64) for x in table.column("uids").to_pylist()]
    names = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
    sure = np.repeat(table.column("sure").to_numpy(), [len(x) for x in uids])
    uid, name = np.concatenate(uids), np.concatenate(names)
    order = np.argsort(name, kind="stable")
    order = order[~sure[order]]
    begin = np.flatnonzero(_starts(name[order]))
    size = np.diff(np.append(begin, len(order)))
    keep = np.concatenate([order[np.repeat(size, size) > 1], np.flatnonzero(sure)])
    uid, name = uid[keep], name[keep]
    order = np.argsort(uid, kind="stable")
    uid, name = uid[order], name[order]
    cut = np.append(np.flatnonzero(_starts(uid)), len(uid)) if len(uid) else np.zeros(1, int)
    for at in range(0, len(cut) - 1, 10_000):
        own = cut[at : at + 10_001]
        yield pa.RecordBatch.from_arrays([pa.array(uid[own[:-1]]), pa.array([name[s:e].tobytes() for s, e in zip(own, own[1:], strict=False)], pa.binary())], names=["uid", "names"])


_CONTEXT = pa.schema([("name", pa.int64()), ("uid", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("context", pa.binary())])
_SPANS = pa.schema([("uid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _contexts(texts: pa.Table, shared: pa.Table) -> pa.Table:
    """Runs of windows with a shared name: their bytes for one document of each content, or a settled span (no bytes) for later documents."""
    if not texts.num_rows or not shared.num_rows:
        return _CONTEXT.empty_table()
    texts = texts.combine_chunks()
    known: dict[int, list[np.ndarray]] = {}
    for u, x in zip(shared.column("uid").to_pylist(), shared.column("names").to_pylist(), strict=True):
        known.setdefault(u, []).append(np.frombuffer(x, np.uint64))
    datas, of, offset = _pieces(texts.column("data").to_pylist())
    uids, docs = texts.column("uid").to_numpy()[of].tolist(), texts.column("doc").to_numpy()[of]
    kept = [i for i, u in enumerate(uids) if u in known and len(datas[i]) >= SPAN]
    parts, contexts = [], []
    for i, j in _chunks([len(datas[k]) for k in kept]):
        own = kept[i:j]
        a, text, first, last, name = _runs([datas[k] for k in own])
        tag = lambda t, n: n ^ ((t.astype(np.uint64) + np.uint64(1)) * np.uint64(_B))  # noqa: E731  another text's tag at worst costs work
        lists = [np.concatenate(known[uids[k]]) for k in own]
        there = tag(np.repeat(np.arange(len(own)), [len(x) for x in lists]), np.concatenate(lists))
        hit = np.isin(tag(text, name), there)
        text, first, last, name = text[hit], first[hit], last[hit], name[hit]
        raw = a.tobytes()
        own_contexts = [raw[s : e + SPAN] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
        contexts += own_contexts
        begin = np.concatenate(([0], np.cumsum([len(datas[k]) for k in own])))[text]
        rows = np.array(own)[text]
        digest = np.array([xxhash.xxh3_64_intdigest(c) for c in own_contexts], np.uint64)
        parts.append((name, digest, rows, first - begin + offset[rows], last - begin + offset[rows]))
    if not contexts:
        return _CONTEXT.empty_table()
    name, digest, rows, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc, uid = docs[rows], np.array(uids)[rows]
    order = np.lexsort((doc, digest, name))
    begin = np.flatnonzero(_starts(name[order], digest[order]))
    size = np.diff(np.append(begin, len(order)))
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > np.repeat(doc[order][begin], size)
    return pa.Table.from_arrays(
        [pa.array(name.view(np.int64)), pa.array(uid), pa.array(doc), pa.array(first), pa.array(last + SPAN), pa.array([None if gone else c for c, gone in zip(contexts, later, strict=True)], pa.binary())], schema=_CONTEXT
    )


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that a smaller document has too, from all contexts of a bucket's names."""
    table = _table(batches)
    order = np.argsort(table.column("name").to_numpy(), kind="stable")  # so that a chunk holds whole names
    name = table.column("name").to_numpy()[order]
    table = table.take(pa.array(order))
    uid, doc, start = (table.column(c).to_numpy() for c in ("uid", "doc", "start"))
    contexts = table.column("context").to_pylist()
    sizes = np.array([len(c) for c in contexts])
    ends = np.append(np.flatnonzero(_starts(name))[1:], len(name))
    at, total = 0, np.cumsum(sizes)
    while at < len(name):
        base = total[at - 1] if at else 0
        to = int(ends[min(len(ends) - 1, np.searchsorted(ends, max(at + 1, np.searchsorted(total, base + 4 * CHUNK))))])
        n = sizes[at:to]
        a = np.frombuffer(b"".join(contexts[at:to]), np.uint8)
        grown = _doubled(a, [32, 16, 2])
        entry = np.repeat(np.arange(to - at), n)[: len(grown)]
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        offset = np.arange(len(grown)) - begin[entry]
        whole = offset <= n[entry] - SPAN
        entry, offset, grown = entry[whole], offset[whole], grown[whole]
        d = doc[at:to][entry]
        group = np.cumsum(_starts(name[at:to]))[entry]
        order = np.lexsort((d, grown, group))
        first = np.flatnonzero(_starts(group[order], grown[order]))
        size = np.diff(np.append(first, len(order)))
        gone = np.zeros(len(order), bool)
        gone[order] = d[order] > np.repeat(d[order][first], size)
        entry, offset = entry[gone], offset[gone]
        if len(entry):
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1)
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(entry)) - 1
            who = entry[s] + at
            yield pa.RecordBatch.from_arrays([pa.array(uid[who]), pa.array(start[who] + offset[s]), pa.array(start[who] + offset[e] + SPAN)], schema=_SPANS)
        at = to


_RESULT = pa.schema([("uid", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Each text's removed spans, merged, and the digest of what stays."""
    spans = spans.combine_chunks()
    uid, start, stop = (spans.column(c).to_numpy() for c in ("uid", "start", "stop"))
    order = np.lexsort((start, uid))
    uid, start, stop = uid[order], start[order], stop[order]
    rows = []
    for u, data in zip(texts.column("uid").to_pylist(), texts.column("data").to_pylist(), strict=True):
        i, j = np.searchsorted(uid, u), np.searchsorted(uid, u, side="right")
        found: list[dict[str, int]] = []
        if i < j:
            s, e = start[i:j], np.maximum.accumulate(stop[i:j])
            new = np.append(True, s[1:] > e[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)
            found = [{"start": int(x), "stop": int(y)} for x, y in zip(s[new], e[last], strict=True)]
        h, at = hashlib.sha256(), 0
        for x in found:
            h.update(data[at : x["start"]])
            at = x["stop"]
        h.update(data[at:])
        rows.append((u, sum(x["stop"] - x["start"] for x in found), found, h.hexdigest()))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT) if rows else _RESULT.empty_table()


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, least_buckets: int = 64) -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept_sha256) of each row of ``docs``.

    A byte is removed if it is covered by a string of 50 bytes that also starts
    in a row with a smaller id; ``spans`` are the removed byte ranges, merged
    (start, stop), and ``kept_sha256`` the digest of the other bytes. Texts are
    UTF-8 bytes, null counts as empty, and strings don't cross texts. Equal
    texts are compared once, by their smallest id: at 50 bytes or more the
    others go wholly. Rows that share an id don't cover each other. A null id
    comes after all others. Other columns are not read. An empty table gives an
    empty result.
    """
    with scope() as kept:
        big = F.lit((1 << 63) - 1)
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), big).alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.cast("binary").alias("data"))
        first = materialise(rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc")), "first")
        whole = rows.join(first, ["h1", "h2", "doc"]).select("h1", "h2", "doc", "data")
        texts = materialise(whole.withColumn("uid", F.monotonically_increasing_id()), "texts")
        size = texts.agg(F.sum(F.length("data").cast("long")).alias("n")).first()["n"] or 0
        buckets = max(least_buckets, math.ceil(size / bucket_bytes))

        names = texts.select("uid", "data").mapInArrow(_named(buckets), "bucket int, sure boolean, uids binary, names binary")
        shared = materialise(names.groupBy("bucket").applyInArrow(_shared, "uid long, names binary"), "shared")
        place = F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("place")
        dealt = texts.select(place, "uid", "doc", "data").groupBy("place")
        runs = dealt.cogroup(shared.select(place, "uid", "names").groupBy("place")).applyInArrow(_contexts, "name long, uid long, doc long, start long, stop long, context binary")
        runs = materialise(runs, "runs")
        open_runs = runs.filter("context is not null").withColumn("bucket", F.pmod("name", F.lit(buckets))).groupBy("bucket")
        spans = materialise(open_runs.applyInArrow(_covered, "uid long, start long, stop long"), "spans")
        spans = spans.unionByName(runs.filter("context is null").select("uid", "start", "stop"))
        cut = texts.select(place, "uid", "data").groupBy("place").cogroup(spans.select(place, "uid", "start", "stop").groupBy("place"))
        results = cut.applyInArrow(_cut, "uid long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string")
        found = materialise(results, "results").join(texts.select("uid", "h1", "h2", F.col("doc").alias("least")), "uid").dropDuplicates(["h1", "h2"]).drop("uid")
        found = materialise(found, "found")
        kept += [found]
        joined = rows.select(id_col, "doc", "h1", "h2", F.length("data").cast("long").alias("n_bytes")).join(found, ["h1", "h2"])
        gone = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= SPAN)
        all_bytes = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
        return joined.select(
            id_col, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(gone, all_bytes).otherwise(F.col("spans")).alias("spans"),
            F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
