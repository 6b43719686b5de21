"""Operators on documents: contracts against brute force, and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vigilake.llm import language_id, licenses, line_dedup, links, mixing, near_dedup, packing, quality, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, Copy int, removed int, license string, path string"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ts", "ö", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, rng.randint(5, 90)) for _ in range(30)]
    near = [base[0].replace(base[0].split()[3], "zzz", 1), base[1] + " tail"]
    odd = [None, "", "   ", "\n\n", "!!! 123", "a", "A", "b c", words(rng, 6000), "ab" * 30_000, "Licensed under the Apache License, Version 2.0.\n" + base[2]]
    return base + near + odd + base[:4] + [base[5] + "\n" + base[6], base[6] + "\n" + base[5].upper()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s", "s", "s", "t", None][i % 5], 0, 1.5, "x", 7, 8, "l", "p") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[3], None, None, None, None, None, None, None, None, None), (3, "other text of id three", "en", "s", 1, 0.0, "", 0, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fp(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_groups(spark, docs, empty):
    rows = docs.collect()
    got = near_dedup.near_duplicates(docs, 4, 4).collect()
    fp = [brute_fp(r["text"], 4) for r in rows]
    label = components(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    least = {x: min((rows[i]["doc_id"] for i in range(len(rows)) if label[i] == x and rows[i]["doc_id"] is not None), default=None) for x in label}
    want = Counter((r["doc_id"], f, least[x]) for r, f, x in zip(rows, fp, label, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_drop_near_duplicates(docs, empty):
    rows = docs.collect()
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    fps = [brute_fp(r["text"], 5) for r in got]
    assert all((a ^ b).bit_count() > 6 for i, a in enumerate(fps) for b in fps[:i])
    assert all(min((f ^ brute_fp(r["text"], 5)).bit_count() for f in fps) <= 12 for r in rows)
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_copies_at_a_jaccard_of_08_go(spark):
    rng = random.Random(11)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near = [], 0
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 400]))]
        copy = list(w)
        for at in range(0, len(w), len(w) // (2 + len(w) // 60)):
            copy[at] = "other"
        j = len(sets(w) & sets(copy)) / len(sets(w) | sets(copy))
        near += 0.8 <= j < 0.95
        rows += [(2 * i, " ".join(w), j), (2 * i + 1, "\n".join(copy).upper(), j)]
        rows.append((1000 + i, " ".join(w[: len(w) // 2] + [f"v{rng.randrange(10**6)}" for _ in w[len(w) // 2 :]]), 0.0))
    got = {r[0] for r in corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, j double"), "").select("doc_id").collect()}
    assert near > 12 and got == {i for i, _, j in rows if i >= 1000 or i % 2 == 0 or j < 0.8}


def test_hot_buckets_are_exact(spark):
    rng = random.Random(0)
    centre = rng.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "id long").withColumn("fp", F.col("id"))
    got = {r["node"]: r["root"] for r in links.hamming_components(df, 4, 6, tile=16).collect()}
    x = np.array(fps).astype(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = components(len(fps), lambda i, j: near[i, j])
    assert [got.get(f, f) for f in fps] == [fps[c] for c in label]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long").repartition(4)
    got = {r["node"]: r["root"] for r in links.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_line_dedup(spark, docs, empty):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"{long}\nshort\nalpha beta gamma"), (2, f"  {long.upper()}\nshort\nnew line of its own"), (3, long.replace("word7", "other")), (4, None), (5, ""), (1, f"{long}\nshort\nalpha beta gamma")]
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=12).collect()}
    assert got[(1, rows[0][1])] == (3, 0) and got[(2, "short\nnew line of its own")] == (3, 1)
    assert got[(3, "")] == (1, 1) and got[(4, None)] == (0, 0) and got[(5, "")] == (1, 0)
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_at_an_edit_similarity_of_08_go(spark):
    rng, rows, close = random.Random(6), [], set()
    for i in range(300):
        w = [f"word{rng.randrange(10**6)}" for _ in range(rng.choice([10, 20, 40, 300]))]
        copy, least = list(w), i % 2 == 0  # at 0.8, or below it and never linked
        for at in rng.sample(range(len(w)), len(w) // 5 if least else len(w) // 2):
            copy[at] = f"other{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
        close |= {2 * i + 1} if least else set()
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0").collect()}
    assert got <= close and len(got) >= 0.95 * len(close)


def word_edits(a, b, most):
    """Word edit distance, or most + 1 if it is beyond that."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def test_line_dedup_against_brute_force(spark):
    """Default parameters, every pair of lines; planted near lines beside those of the given documents."""
    rng = random.Random(12)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    pool = sorted({line for _, t in given for line in (t or "").split("\n") if 5 <= len(line.split()) <= 60})
    for i in range(60):  # some words of each replaced, dropped or added
        w = rng.choice(pool).split()
        for _ in range(rng.randint(1, max(1, len(w) // 5))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([1, 1, 0])] = rng.choice([[rng.choice(pool).split()[0]], []])
        given.append((10_000 + i, "\n".join(rng.sample(["  ".join(w), f"only here {i} {i * i}"], 2))))
    key = lambda line: " ".join(re.split("[ \t\r\x0b\x0c]+", line.strip(" \t\r\x0b\x0c").lower()))
    distinct = sorted({key(line) for _, t in given for line in (t or "").split("\n")} - {""})
    distinct = [d for d in distinct if len(d) >= 10]
    split = [d.split(" ") for d in distinct]
    bags = [Counter(w) for w in split]
    label, pairs = list(range(len(distinct))), []
    for i in range(len(distinct)):
        for j in range(i):
            longer = max(len(split[i]), len(split[j]))
            most = int(longer * 0.2 + 1e-9)
            if abs(len(split[i]) - len(split[j])) <= most and longer >= 5 and (bags[i] & bags[j]).total() >= longer - most and word_edits(split[i], split[j], most) <= most:
                pairs.append((i, j))
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    of = dict(zip(distinct, label, strict=True))
    first, want = {}, {}
    for i, t in sorted(given, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            at = first.setdefault(of.get(key(line), (i, len(kept))), (i, len(kept)))
            kept.append(at == (i, len(kept)))
        want[i] = [at for at, stays in enumerate(kept) if not stays]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = {r["__id"]: sorted(r["removed"]) for r in line_dedup.removed_lines(docs).collect()}
    lost = sum(len(set(want[i]) - set(got.get(i, []))) for i in want)
    more = sum(len(set(got[i]) - set(want[i])) for i in got)
    assert len(pairs) > 50 and more == 0 and lost <= 0.01 * sum(map(len, want.values()))


def test_line_white_space_and_short_words(spark):
    rows = [(0, "alpha beta gamma"), (1, " Alpha\tbeta \x0b  gamma"), (2, "it is an old red cat on my big bed"), (3, "it  is an old red dog on my big bed"), (4, "alphabeta gamma")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}


def test_line_simhash_of_any_length(spark):
    rng = random.Random(2)
    lines = [words(rng, n) for n in (1, 3, 40, 254, 255, 256, 700)]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, norm string")
    hashed = spark.createDataFrame([(w,) for w in {w for t in lines for w in t.split(" ")}], "w string").withColumn("h", F.xxhash64("w")).collect()
    h = {r["w"]: r["h"] % (1 << 64) for r in hashed}
    got = {r["k"]: (r["n"], r["fp"]) for r in line_dedup.simhashes(df, ["k"]).collect()}
    for k, t in enumerate(lines):
        own = [h[w] for w in t.split(" ") if len(w) >= line_dedup.LONG]
        assert got[k] == (len(own), sum(1 << b for b in range(63) if 2 * sum(x >> b & 1 for x in own) > len(own)) if own else None) or not own


def test_two_members_are_verified_in_one_of_the_buckets_they_share(spark, monkeypatch):
    tables, write = {}, links.materialise

    def seen(df, name):
        table = write(df, name)
        if name == "found":
            tables[name] = tables.get(name, []) + [table.collect()]
        return table

    monkeypatch.setattr(links, "materialise", seen)
    items = spark.createDataFrame([(0, 7, None), (1, None, 8), (10, 7, 8), (11, 7, 8), (12, 7, 9), (13, None, 9), (2, None, 9)], "id long, a long, b long")
    describe = lambda ids: ids.select("id", F.struct(F.col("id").alias("x")).alias("about"))
    linked = lambda a, b: (a["x"] > 2) & (b["x"] > 2)
    got = links.keyed_components(items, [F.col("a"), F.col("b")], lambda a, b: F.lit(True), describe, linked, anywhere=True)
    assert {r["node"]: r["root"] for r in got.collect()} == {10: 10, 11: 10, 12: 10, 13: 10}
    pairs = [{(r["key"], *sorted((r["u"], r["v"]))) for r in t} for t in tables["found"]]
    assert sorted(pairs[0]) == [(7, 10, 11), (7, 10, 12), (7, 11, 12), (9, 12, 13)]


def test_line_dedup_splits_a_text_once_for_its_result(spark, docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text#") == 1


def test_normal_form_of_lines(spark):
    lines = ["", "  ", " \t A \t b\r", "\x0b\x0cÄB  c", "x\ty\x0cz ", "plain line", "a\u00a0 b"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i").select(line_dedup.normal(F.col("line"))).collect()]
    assert got == ["", "", "a b", "äb c", "x y z", "plain line", "a\u00a0 b"]


def test_line_dedup_reads_a_text_once_not_once_a_line(spark, docs, monkeypatch):
    """No table hashes or splits a text above the generator of its lines, where each line would do it again."""
    plans, write = {}, line_dedup.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialise", seen)
    line_dedup.removed_lines(docs).count()
    cutting = {name: p[: p.index("Generate posexplode")] for name, p in plans.items() if "Generate posexplode" in p}
    assert "lines" in cutting and len(cutting) > 1
    assert not [name for name, p in cutting.items() if re.search(r"(xxhash64|split)\(text#", p)]


def test_members_look_again_only_in_their_own_buckets(spark, monkeypatch):
    rows = []
    for key in range(30):  # a leader that links nobody, and a hub that links more components than one look names
        size = 12 if key == 0 else 3
        rows += [(1000 * key + i, key) for i in range(size)]
    df = spark.createDataFrame(rows, "id long, k long")
    named, write = [], links.materialise

    def seen(t, name):
        out = write(t, name)
        named.extend([out.count()] if name == "named" else [])
        return out

    monkeypatch.setattr(links, "materialise", seen)
    hub = lambda a, b: (a != b) & ((a == 6) | (b == 6)) & (a != 0) & (b != 0)
    got = {r["node"]: r["root"] for r in links.keyed_components(df, [F.col("k")], hub).collect()}
    assert got == {i: 1 for i in range(1, 12)}
    assert len(named) > 1 and named[0] == len(rows) and max(named[1:]) <= 12


def test_substrings(docs, empty):
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, (r["text"] or "").encode()) for r in docs.collect())
    got = Counter((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in substrings.repeated_substrings(docs, bucket_bytes=4000, least_buckets=5).collect())
    first: dict[bytes, int] = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = Counter()
    for i, b in rows:
        cov = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cov[p] += 1
                cov[p + 50 if p + 50 <= len(b) else len(b)] -= 1
        gone = np.cumsum(cov)[:-1] > 0
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert substrings.repeated_substrings(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect())
    got = packing.pack(docs).collect()
    laid = sorted((r["sequence_id"], r["offset"], r) for r in got)
    at = 0
    for s, o, r in laid:
        assert s * 1024 + o == at and o + r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
    assert at == sum(len(k) * n for k, n in want.items())
    built, open_ = Counter(), {}
    for _, _, r in laid:
        ids = open_.pop((r["doc_id"], r["doc_tokens"], r["start"]), ()) + tuple(np.frombuffer(r["ids"], "<u4").tolist())
        if len(ids) == r["doc_tokens"]:
            built[ids] += 1
        else:
            open_[(r["doc_id"], r["doc_tokens"], len(ids))] = ids
    assert built == want and not open_
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tokenizers_agree():
    slow, fast = packing._encoder("byte_bpe_50k.json", None), packing._encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for t in ("", "Hello  world\n\n x<|endoftext|>", "naïve ÉÈ 12,345's", "日本語 ١٢", "\t\t a" * 9, "é ẞ"):
        assert list(slow(t)) == list(fast(t))
    assert list(fast("a <|endoftext|> b")) == [64, 220, 50256, 275]


def test_language(spark, docs, empty):
    rng = random.Random(1)
    sound = {"aa": "kapolitu", "bb": "wrzeschy", "cc": "ñóíaue"}
    rows = [(i, " ".join("".join(rng.choice(sound[g]) for _ in range(5)) for _ in range(30)), g) for i, g in enumerate(rng.choice(list(sound)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df).join(df, "doc_id").filter("held_out")
    assert got.count() > 30 and got.filter("lang <> lang_pred").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect() if r["doc_id"] is not None}
    for r in docs.collect():
        if r["doc_id"] not in (None, 3):
            assert (out[r["doc_id"]]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language_id.identify(docs).count() == docs.count() and language_id.identify(empty).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_unlearned_languages_go(spark):
    d = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(d).select("doc_id", "text", "lang")
    rng = random.Random(8)
    odd = ["Это простой русский текст о погоде и природе. " * 5, "这是一个关于天气的简单中文文本。" * 8, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300))]
    more = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), "").select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert not any(i >= 10**9 for i in kept) and len(lettered - kept) <= 0.002 * len(lettered) and kept <= lettered


def test_language_scores_match_a_plain_sum():
    langs, rng = ["a", "b"], np.random.default_rng(0)
    logp = np.vstack([rng.normal(size=(language_id.BUCKETS, 2)), np.zeros((1, 2))])
    texts_ = ["abc déf", "", "x", "Qrs!!tu" * 3]
    starts, has, grams = language_id._grams(texts_)
    whole = [sum(logp[h[s:e]].sum(axis=0) for h in grams) for s, e in zip(starts, [*starts[1:], len(grams[0])], strict=True)]
    for t, w in zip(texts_, whole, strict=True):
        own = language_id._grams([t])[2]
        assert np.allclose(w, sum(logp[h].sum(axis=0) for h in own) if own else 0)


def test_long_texts_in_pieces_give_the_same(spark, monkeypatch):
    rng = random.Random(21)
    texts_ = [words(rng, 3000), "ab " * 2000, "x" * 9000, words(rng, 3) + " " * 5000, words(rng, 4), "", "İstanbul " * 400]
    rows = [(i, t, ["en", "de"][i % 2]) for i, t in enumerate(texts_)] + [(10, texts_[0][500:] + " tail", "en"), (11, texts_[2][:4000], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)

    def results():
        fps = [near_dedup.signature(t.encode(), 4, True) for t in texts_]
        data = [t.encode() for _, t, _ in rows]
        named = set()
        for i, t in enumerate(substrings._pieces(data)[0]):
            of = int(substrings._pieces(data)[1][i])
            named |= {(of, int(n)) for n in substrings._runs([t])[4]}
        total = np.zeros(language_id.BUCKETS + 1, np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array(["en"] * len(rows))], names=["text", "lang"])
        for b in language_id._count(iter([batch])):
            total[: language_id.BUCKETS] += np.concatenate([np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()])
        return fps, named, total.tolist()

    whole = results()
    monkeypatch.setattr(near_dedup, "PIECE", 100)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert results() == whole


def test_texts_of_tens_of_megabytes(spark):
    """Texts far longer than a piece, through the whole operators."""
    rng = random.Random(5)
    big = words(rng, 40_000) * 40
    rows = [(0, big, "en"), (1, "short text of its own", "de"), (2, big + " x", "en"), (3, "!" * 3_000_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert len(big) > 8_000_000
    groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 4, 4).collect()}
    assert groups[0] == groups[2] == 0 and groups[1] == 1
    got = {r["doc_id"]: r["n_removed"] for r in substrings.repeated_substrings(df).collect()}
    assert got[0] == 0 and got[1] == 0 and got[2] >= len(big.encode()) and got[3] == 0
    langs, logp = language_id.train(df)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, langs, logp).collect()}[3] == "und"


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, words(rng, 40) if i % 4 else words(rng, 40).upper().replace(" ", "!! ")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(500)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(df, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) / len(held) > 0.97
    out = quality.score(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0


def test_rules_compile_to_what_was_fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    bias, rules = quality.fit_rules(x, y, ["a", "b", "c"], trees=8)
    z = bias + sum(w * np.logical_and.reduce([(x[:, "abc".index(n)] > c) == above for n, above, c in r]) for r, w in rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(quality.compile_rules(bias, rules)).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(z, -30, 30)))) and ((got > 0.5) == (y > 0)).mean() > 0.98


def test_mixing(spark, docs, empty):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"))
    got = mixing.mix(df, {"hot": 3.0, "s1": 1.0, "gone": 5.0}, total=2000.0)
    sizes = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    shares = {"hot": 2000 * 3 / 4, "s1": 2000 * 1 / 4}
    assert set(sizes) == set(shares) and all(abs(sizes[s] - shares[s]) < 5 * shares[s] ** 0.5 for s in shares)
    assert got.select("doc_id", "copy").distinct().count() == got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df.repartition(5), {"hot": 3.0, "s1": 1.0, "gone": 5.0}, total=2000.0).collect()))
    out = mixing.mix(docs)
    assert set(out.columns) == {*docs.columns, "shuffle_key"} - {"Copy"} | {"copy"} and out.count() > 0
    assert mixing.mix(empty).count() == 0


def test_poisson_steps(spark):
    import math

    for rate in (0.1, 1.0, 30.0, 900.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate))).first()[0]
        k = int(rate)
        assert steps[k] == pytest.approx(sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1)), abs=1e-9) and steps[-1] == pytest.approx(1, abs=1e-9)


def test_poisson_tables_of_large_rates(spark):
    import math

    rates = [(f"r{r}", float(r)) for r in (3, 1001, 50_000, 3_000_000)]
    got = {r["__source"]: r for r in mixing.poisson_tables(spark.createDataFrame(rates, "__source string, __rate double")).collect()}
    for name, rate in rates:
        base, steps = got[name]["__base"], got[name]["__steps"]
        assert len(steps) <= 24 * math.sqrt(rate) + 60 and steps == sorted(steps) and steps[-1] == pytest.approx(1, abs=1e-8)
        pmf = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(base, base + len(steps))]
        assert np.allclose(np.cumsum(pmf), steps, atol=1e-7)
    df = spark.range(40_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("hot").alias("source"))
    sizes = {r["source"]: r["count"] for r in mixing.mix(df).groupBy("source").count().collect()}
    assert all(abs(n - 20_000) < 6 * 20_000**0.5 for n in sizes.values()) and len(sizes) == 2


def test_licenses(spark, docs, empty):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "some words\nmore words"), ("a/b/c/y.txt", "Licensed under CC BY-NC 4.0.\nmore"), ("a/b/c/z.txt", "nothing"), ("q/r.txt", "nothing"), (None, "nothing"), ("top.txt", None)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.license_scan(df, F.col("path")).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("CC-BY-NC-4.0", "own", None), 3: ("CC-BY-NC-4.0", "inherited", "a/b/c"), 4: (None, "none", None), 5: (None, "none", None), 6: (None, "none", None)}
    assert licenses.license_scan(docs, licenses.document_path()).count() == docs.count()
    assert licenses.license_scan(empty, licenses.document_path()).count() == 0


def test_license_verdict_is_the_same_on_a_larger_table(spark):
    notice = spark.createDataFrame([(0, "This document is released under the MIT License.")], "doc_id long, text string")
    for n in (200, 20_000):
        line = F.concat(F.lit("this document is number "), F.col("id").cast("string"), F.when(F.col("id") % 20 == 0, "\nreleased under the MIT license").otherwise(""))
        found = licenses.license_lines(notice.unionByName(spark.range(1, n).select(F.col("id").alias("doc_id"), line.alias("text")))).filter("__id = 0").collect()
        assert [r["license"] for r in found] == ["MIT"]


def test_license_files_and_wrapped_headers(spark):
    body = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "MERCHANTABILITY" in t)
    wrapped = body.replace("\n", "\n\n").replace(", to deal", ",\n to deal").replace("LIABLE FOR", "LIABLE\nFOR")
    header = "\n".join("# " + h for h in ("Copyright 2020 The Somebody Authors", 'Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at",
                                          "    http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software", 'distributed under the License is distributed on an "AS IS" BASIS,', "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."))
    gnu = "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nint main"
    rows = [("p/LICENSE", f"MIT License\n\nCopyright (c) 2021 Some Person\n\n{wrapped}"), ("p/src/a.py", "import os\n\nprint(os.name)"), ("q/b.py", header + "\n\nimport sys\nprint(sys.path)"),
            ("q/c.c", "This program is free software: you can redistribute it and/or modify\n" + gnu), ("r/d.rs", "// SPDX-License-Identifier: BSD-3-Clause\nfn main() {}"), ("r/e.txt", "plain words\nand other words\n\nmore of them")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)] + [(100 + i, f"x/{i}.txt", f"common filler text number {i} with the software and the use of it") for i in range(60)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.license_scan(df, F.col("path")).filter("doc_id < 100").collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "p"), 2: ("Apache-2.0", "own", None), 3: ("GPL-3.0", "own", None), 4: ("BSD-3-Clause", "own", None), 5: ("BSD-3-Clause", "inherited", "r")}


def test_license_units_against_brute_force(spark):
    """Every unit scored against every template, without the filters."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r["__id"], r["kind"], r["pos"]): (r["license"], r["score"]) for r in licenses.license_units(rows).collect()}
    terms = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    units, lines = {}, []
    for i, t in rows.collect():
        if t is None:
            continue
        own = t.lower().split("\n")
        units |= {(i, 0, p): terms(x) for p, x in enumerate(own)}
        blocks = re.split("\n[^a-z0-9]*\n", t.lower())
        units |= {(i, 1, p): terms(x) for p, x in enumerate(blocks) if "\n" in x}
        units |= {(i, 2, 0): terms(t)} if len(blocks) > 1 else {}
        lines += [set(terms(x)) for x in own if terms(x)]
    df = Counter(w for x in lines for w in x)
    idf = lambda w: math.log((len(lines) + 1) / (df[w] + 1)) + 1
    vector = lambda x: {w: c * idf(w) for w, c in Counter(x).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    temps = [(n, v, length(v)) for n, v in ((n, vector(terms(t))) for n, t in licenses.TEMPLATES)]
    want = {}
    for k, x in units.items():
        v = vector(x)
        if v:
            scores = [round(sum(w * v.get(t, 0.0) for t, w in tv.items()) / (length(v) * n), 6) for _, tv, n in temps]
            if max(scores) >= 0.7:
                want[k] = (temps[scores.index(max(scores))][0], max(scores))
    assert set(got) == set(want) and len(want) > 5 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_pipeline_stages(spark, docs, tmp_path):
    from vigilake.llm.scratch import materialise

    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, held, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == held.columns and dict(out.dtypes)["text"] == "string"
        if name == "language_id":
            assert out.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
        held = out
    assert held.count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
    assert nothing.count() == 0


def test_least_fit_is_of_all_labelled_rows(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(20 + i % 7)) + ("zqxj" * (i % 3) if i % 400 == 1 else ""), "en") for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langs, logp = language_id.train(docs, None)
    fits = sorted(r["fit"] for r in language_id.predict(docs, langs, logp, [], fit_col="fit").collect())
    assert language_id.least_fit(docs, langs, logp) == pytest.approx(fits[2] - 1, abs=1e-12)


def test_license_units_split_each_unit_once(spark):
    docs = spark.createDataFrame([(1, "MIT License\nfoo bar\n\nReleased under the MIT License")], "doc_id long, text string")
    found = licenses.units(docs, "doc_id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1  # above the union of lines, blocks and whole texts
    got = sorted((r["kind"], r["pos"], r["edge"], tuple(r["terms"])) for r in found.collect())
    first, last = ("mit", "license", "foo", "bar"), ("released", "under", "the", "mit", "license")
    assert got == [(0, 0, True, first[:2]), (0, 1, False, first[2:]), (0, 3, True, last), (1, 0, True, first), (2, 0, True, first + last)]
