"""Language identification: multinomial naive Bayes over hashed character n-grams, scored sparsely in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise, scope

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHUNK = 1 << 19
BLOCK = 1 << 12


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters; one longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > CHUNK:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts of the texts in their concatenation, which have a letter, and each order's bucket at each character (BUCKETS: none)."""
    lower = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) for t in lower])
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = ends - [len(t) for t in lower]
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    seen = np.concatenate(([0], np.cumsum(letter)))
    has = seen[ends] > seen[starts]
    left = np.repeat(ends, ends - starts) - np.arange(len(c))  # characters from here to the text's end
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(c):
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
        mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        if n in ORDERS:
            full = np.full(len(c), BUCKETS, np.int64)
            full[: len(mixed)] = np.where(left[: len(mixed)] >= n, mixed, BUCKETS)
            out.append(full)
    return starts, has, out


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """A text in pieces of CHUNK characters, each with what its last n-grams reach into, and its own length; so memory doesn't grow with a text."""
    more = max(ORDERS) - 1
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK + more], min(CHUNK, len(text) - at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
        by: dict[str, list[str | None]] = {}
        for t, lang in zip(texts, langs, strict=True):
            by.setdefault(lang, []).append(t)
        for lang, own in by.items():
            total = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for i, j in _chunks(own):
                if j - i == 1 and own[i] and len(own[i]) > CHUNK:
                    for piece, n in _pieces(own[i].lower()):
                        for h in _grams([piece])[2]:
                            total += np.bincount(h[:n], minlength=BUCKETS + 1)
                    continue
                for h in _grams(own[i:j])[2]:
                    total += np.bincount(h, minlength=BUCKETS + 1)
    for lang, total in found.items():
        parts = total[:BUCKETS].reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["lang", "block", "counts"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = np.zeros(BLOCK, np.int64), None
    for b in batches:
        for lang, block, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            first = first or (lang, block)
            total += np.frombuffer(counts, np.int64)
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lang", "block", "counts"])


def train(rows: DataFrame, per_language: int | None = 20_000, smoothing: float = 0.5, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bucket, from rows (id_col, text, lang).

    Each language gives about ``per_language`` rows, chosen by a hash of the id
    (all, where it has fewer or ``per_language`` is None), whole texts. The driver receives one number a
    bucket and language. Null texts and languages take no part.
    """
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (per_language or n) / n))])
    chosen = rows.filter(F.pmod(F.xxhash64(id_col, F.lit("language")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)) if per_language and max(sizes.values()) > per_language else rows
    counts = chosen.select("text", "lang").mapInArrow(_count, "lang string, block int, counts binary")
    merged = counts.groupBy("lang", "block").applyInArrow(_merge, "lang string, block int, counts binary").collect()
    langs = sorted({r["lang"] for r in merged})
    total = np.zeros((BUCKETS, len(langs)))
    for r in merged:
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK, langs.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    logp = np.log(total + smoothing) - np.log(total.sum(axis=0) + smoothing * BUCKETS)
    return langs, np.vstack([logp, np.zeros((1, len(langs)))])


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, carry: list[str] | None = None, text_col: str = "text", fit_col: str | None = None) -> DataFrame:
    """``carry`` (default: doc_id) with lang_pred and score of each row; ``und`` with score 0 if the text is null or has no letter, or nothing was learned.

    ``fit_col`` names one more column: the mean log-probability of the n-grams
    in the predicted language, null for ``und``. Unlike score, it is low for
    text of no learned language.

    Every n-gram of the whole text counts; a long text is read in pieces. Rows repeat as in the input; equal
    scores go to the first language in order; carried columns of those two
    names are replaced, and other columns are not read. An empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))
    names = [c for c in (["doc_id"] if carry is None else carry) if c.lower() not in ("lang_pred", "score")]
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(fit_col, T.DoubleType())] if fit_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            best, scores, fits = [], [], []
            for i, j in _chunks(texts):
                total = np.zeros((j - i, len(langs)))
                if j - i == 1 and texts[i] and len(texts[i]) > CHUNK:
                    low = texts[i].lower()
                    long, has = np.array([len(low)]), np.zeros(1, bool)
                    for piece, n in _pieces(low):
                        _, some, grams = _grams([piece])
                        has |= some
                        for h in grams if langs else []:
                            total[0] += table.value[h[:n]].sum(axis=0, dtype=np.float64)
                else:
                    starts, has, grams = _grams(texts[i:j])
                    long = np.diff(np.append(starts, len(grams[0]) if grams else 0))
                    full = np.flatnonzero(long)
                    if len(full) and langs:
                        for h in grams:
                            total[full] += np.add.reduceat(table.value[h], starts[full], axis=0, dtype=np.float64)
                for k in range(j - i):
                    if not has[k] or not langs:
                        best.append("und")
                        scores.append(0.0)
                        fits.append(None)
                        continue
                    w = int(total[k].argmax())
                    best.append(langs[w])
                    scores.append(float(1 / np.exp(np.clip(total[k] - total[k, w], -700, 0)).sum()))
                    fits.append(float(total[k, w] / sum(max(int(long[k]) - n + 1, 0) for n in ORDERS)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string()), pa.array(scores, pa.float64()), *([pa.array(fits, pa.float64())] if fit_col else [])], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)


def least_fit(rows: DataFrame, langs: list[str], logp: np.ndarray, least_rows: int = 200, slack: float = 1.0) -> float | None:
    """The fit below which a text is of no learned language: ``slack`` under the 0.1 % quantile of all labelled rows, exactly; None with fewer than ``least_rows`` labelled rows, too few to tell."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    with scope():
        fits = materialise(predict(rows, langs, logp, [], fit_col="fit").select("fit"), "fits")
        n = fits.agg(F.count(F.lit(1)).alias("rows"), F.count("fit").alias("fits")).first()
        if n["rows"] < least_rows or not n["fits"]:
            return None
        lowest = fits.filter("fit is not null").orderBy("fit").limit(-(-n["fits"] // 1000))  # a thousandth, one number each
        return lowest.agg(F.max("fit")).first()[0] - slack


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text leaves remainder 0; true for a null id, so that it is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, per_language: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, applied to all rows."""
    langs, logp = train(docs.filter(~held_out()).select("doc_id", "text", "lang"), per_language)
    return predict(docs, langs, logp).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
