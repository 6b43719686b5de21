"""Statistics, n-grams, order and stages against plain definitions of their own."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigilake.llm import language_id, packing, quality, scratch

TEXTS = ["One line, two words!\nTwo | lines; 42 $ 100%\n\nTwo | lines; 42 $ 100%", "", "ÄÖ schön été 日本", "a a a\ta\n", "...!!!", "word", " \n ", "He said: 'it's (fine)'. OK? [x] {y} #z @w ~"]


def plain_statistics(t):
    n = max(len(t), 1)
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    lines, marks = t.split("\n"), [c for c in t if c.isascii() and not c.isalnum() and c > " " and c != "\x7f"]
    return {
        "chars": math.log1p(len(t)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines)), "word_length": n / max(len(words), 1), "line_length": math.log1p(n / len(lines)),
        "upper": sum(c.isupper() for c in t) / n, "digits": sum(c in "0123456789" for c in t) / n, "marks": len(marks) / n, "symbols": sum(c not in ".,;:'\"!?()-" for c in marks) / n, "shouts": t.count("!") / n,
        "bars": t.count("|") / n, "stops": t.count(".") / n, "distinct_words": len(set(words)) / max(len(words), 1), "distinct_lines": len(set(lines)) / len(lines),
    }


def test_quality_statistics(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "i int, t string")
    stats = quality.statistics(F.col("t"))
    for r in df.select("i", *[c.alias(n) for n, c in stats.items()]).collect():
        want = plain_statistics(TEXTS[r["i"]] if r["i"] != 99 else "")
        assert {n: r[n] for n in stats} == pytest.approx(want), r["i"]


def plain_bucket(gram):
    """The bucket of an n-gram, one character at a time."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % 2**32
    h = (h ^ (len(gram) * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
    return ((h ^ (h >> 15)) * 0xC2B2AE35 % 2**32) >> 16


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    return [plain_bucket(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]


def test_naive_bayes_by_definition(spark):
    rng = random.Random(9)
    sound = {"aa": "kapoé", "bb": "wrzsch y", "cc": "ñoíau-e"}
    rows = [(i, "".join(rng.choice(sound[g]) for _ in range(rng.randint(1, 60))), g) for i, g in enumerate(rng.choice(list(sound)) for _ in range(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = language_id.train(df)
    counts = {g: Counter(b for _, t, own in rows if own == g for b in plain_grams(t)) for g in langs}
    weight = {g: {b: math.log(c[b] + 0.5) - math.log(c.total() + 0.5 * language_id.BUCKETS) for b in {x for k in counts.values() for x in k}} for g, c in counts.items()}
    none = {g: math.log(0.5) - math.log(counts[g].total() + 0.5 * language_id.BUCKETS) for g in langs}
    asked = [*[t for _, t, _ in rows[:30]], "Kap-Ox 12 wrz", "ñ"]
    new = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in language_id.predict(new, langs, logp).collect():
        total = {g: sum(weight[g].get(b, none[g]) for b in plain_grams(asked[r["doc_id"]])) for g in langs}
        best = max(total, key=total.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), rel=1e-3)


def test_packing_follows_the_curve(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["red", "blue", "one", "tree", "stone", "river"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    first = packing.pack(df).filter("start = 0").orderBy("sequence_id", "offset").collect()
    ids = {}
    for r in packing.pack(df).orderBy("doc_id", "start").collect():
        ids[r["doc_id"]] = [*ids.get(r["doc_id"], []), *np.frombuffer(r["ids"], "<u4").tolist()]
    keys = []
    for r in first:
        counts = np.zeros((1, 512))
        for t in ids[r["doc_id"]]:
            counts[0, (t * 0x9E3779B1 % 2**32) >> 23] += 1
        keys.append(int(packing._key(counts)[0]))
    assert len(first) == 150 and keys == sorted(keys) and len(set(keys)) > 50


def test_line_stage_keeps_first_occurrences(spark):
    line = lambda n: " ".join(f"w{n}x{i}" for i in range(12))
    rows = [(1, f"{line(1)}\n{line(2)}", "en", "s", 0), (2, f"{line(2).upper()}\n{line(3)}", "en", "s", 0), (3, line(1).replace("w1x3 ", "other "), "en", "s", 0), (4, "", "en", "s", 0), (5, None, "en", "s", 0), (6, line(4), "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: rows[0][1], 2: line(3), 4: "", 5: None, 6: line(4)}
    assert got[2]["n_chars"] == len(line(3)) and got[1]["n_chars"] == len(rows[0][1])


def test_mixing_stage_weighs_sources_alike(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 2600, "big").when(F.col("id") < 2900, "mid").otherwise("small").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    out = corpus_pipeline.mix_sources(spark, docs, "")
    sizes = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert out.columns == docs.columns and set(sizes) == {"big", "mid", "small"} and all(abs(n - 1000) < 6 * 1000**0.5 for n in sizes.values())


def test_scopes_delete_what_nothing_reads(spark):
    exists = lambda t: spark._jvm.org.apache.hadoop.fs.Path(t._scratch).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(t._scratch))
    with scratch.scope() as outer:
        with scratch.scope() as kept:
            a, b = (scratch.materialise(spark.range(3), n) for n in "ab")
            kept.append(a)
        assert exists(a) and not exists(b)
        outer.append(scratch.materialise(spark.range(1), "c"))
    assert not exists(a) and exists(outer[0])
    scratch.release(*outer)
