"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.language_id import held_out, least_fit, predict, train
from vigilake.llm.line_dedup import dedup_lines
from vigilake.llm.mixing import mix
from vigilake.llm.near_dedup import drop_near_duplicates
from vigilake.llm.packing import pack
from vigilake.llm.scratch import materialise, release, scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: what has no letter, no language that is likelier than all others together, or n-grams far less likely than those of labelled rows, as text of an unlearned language and letter noise have."""
    known = docs.filter(~held_out()).select("doc_id", "text", "lang")
    langs, logp = train(known, None)
    bound = least_fit(known, langs, logp)
    renamed = docs.toDF(*[f"__in_{i}" for i in range(len(docs.columns))])
    at = {c.lower(): f"__in_{i}" for i, c in enumerate(docs.columns)}
    found = predict(renamed, langs, logp, renamed.columns, at["text"], "__fit")
    kept = found.filter("lang_pred <> 'und' AND score >= 0.5")
    if bound is not None:
        kept = kept.filter(F.col("__fit") >= bound)
    return kept.select(*renamed.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and the documents that had no others; ``n_chars`` follows the text."""
    names = [f"__in_{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    left = dedup_lines(docs.toDF(*names), at["doc_id"], at["text"])
    left = left.filter(f"n_removed = 0 OR length(trim({at['text']})) > 0")
    if "n_chars" in at:
        left = left.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return left.select(*names).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: at most 6 bits apart, or 5-word shingles at a Jaccard similarity of 0.8 or more."""
    return drop_near_duplicates(docs, jaccard=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal weights; a document is repeated by its count."""
    names = [f"__in_{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    return mix(docs.toDF(*names), source_col=at["source"], id_col=at["doc_id"]).select(*names).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, edit distances and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's input and its other tables go once it is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope() as kept:
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
