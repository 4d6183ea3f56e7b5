"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over
hashed byte trigrams says which side a text is on (log-odds of pooled n-gram
frequencies, with a fitted slope).  A text gets the language whose codeword has
the least weighted logistic loss; the weights are the bits' accuracies.  Where
the runner-up is about as near, the text is flagged as ambiguous.

Fitting uses a documented, bounded sample: at most ROWS_PER_LANGUAGE labelled
rows of each language, those with the smallest hashes of doc_id and text, and of each text the
first FIT_CHARS characters.  Prediction covers whole texts and sees nothing but the text.

Defined results: null texts and texts without a letter are ``und`` with score 0
and not ambiguous; without any labelled row every text is ``und``; with one
language all texts with letters get it; of languages with equal loss the first by code point
is chosen.  Rows are independent, also those that share a doc_id; rows without a
doc_id are never learnt from.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import ship
from lakeseek.llm.kernels import slices

ROWS_PER_LANGUAGE, FOLDS, BUCKET_BITS, SEED = 1500, 5, 15, 20_301
#: Mean loss over the bits by which the runner-up must be worse; under it a text is ambiguous.
MARGIN = 0.02
UNKNOWN = "und"
FIT_CHARS = 1 << 20

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def codewords(languages: int, seed: int = SEED) -> np.ndarray:
    """A row of -1 and 1 for each language: all distinct splits for up to 5 languages, random balanced columns with distinct rows beyond."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= 5:
        splits = range(1, 2 ** (languages - 1))
        return np.array([[1 if (s >> (languages - 1 - i)) & 1 else -1 for s in splits] for i in range(languages)], float)
    rng = np.random.default_rng(seed)
    bits = 6 * int(np.ceil(np.log2(languages)))
    while True:
        columns = [rng.permutation(np.where(np.arange(languages) < languages // 2, 1.0, -1.0)) for _ in range(bits)]
        code = np.stack(columns, 1)
        distance = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(languages, dtype=int) * bits
        if distance.min() >= bits // 5:
            return code


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams with a letter in the middle, inside one text each, and how many there are before each text."""
    x = _FOLD[data]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    key = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    keep = x[1:-1] != 32
    for edge in (bounds[1:-1] - 1, bounds[1:-1] - 2):
        keep[edge[(edge >= 0) & (edge < len(keep))]] = False
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(keep)])[np.minimum(bounds, len(keep))]
    return bucket[keep], before


def _slice(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    n = int(offsets[-1] - offsets[0])
    return (np.frombuffer(raw, np.uint8, n, int(offsets[0])) if n else np.zeros(0, np.uint8)), offsets - offsets[0]


def _sums(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The mean weight over the trigrams of each text, for each bit."""
    data, bounds = _slice(texts)
    bucket, before = _trigrams(data, bounds)
    out = np.zeros((len(texts), weights.shape[1]))
    full = np.flatnonzero(np.diff(before) > 0)
    if len(full):
        out[full] = np.add.reduceat(weights[bucket], before[full], axis=0) / np.diff(before)[full][:, None]
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    slopes: np.ndarray
    trust: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score from 0 to 1, and the runner-up's distance, for large_string texts."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.ones(len(texts))
        z = _sums(self.weights, texts) * self.slopes
        loss = (np.logaddexp(0, -z[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = np.take_along_axis(loss, order[:, :1], 1)[:, 0], np.take_along_axis(loss, order[:, 1:2], 1)[:, 0]
        score = 1 / np.exp(best[:, None] - loss).sum(1)
        return order[:, 0], np.clip(score, 0, 1), (second - best) / self.trust.sum()


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows of docs(doc_id, text, lang) outside the held-out fold; lang values sort by code point."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (rest != 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(counts))
    if not names:
        return Model((), np.zeros((0, 0)), np.zeros((1, 0)), np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, float(min(1.0, rows_per_language / counts[k])))])
    # About twice the number by the hash's share; the exact cut comes inside each task, before rows of a language meet. Equal rows have equal hashes.
    lot = labelled.select("lang", F.substring("text", 1, FIT_CHARS).alias("text"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("lot"))
    drawn = lot.where(F.pmod("lot", F.lit(1_000_003)) / 1_000_003.0 < 2 * F.try_element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("lot", F.lit(1_000_003)), "lot", "text"))
    cut = drawn.withColumn("rank", rank).where(F.col("rank") <= rows_per_language)
    sample = cut.select("lang", "text", "lot").orderBy("lang", "lot", "text").select("lang", "text").toArrow()
    code, size = codewords(len(names)), 1 << BUCKET_BITS
    texts = sample.column("text").cast(pa.large_string()).combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    side = np.array([names.index(x) for x in sample.column("lang").to_pylist()], int)
    grams, per = np.zeros((len(names), size)), []
    for i, text_ in enumerate(side.tolist()):
        bucket, _ = _trigrams(*_slice(texts.slice(i, 1)))
        grams[text_] += np.bincount(bucket, minlength=size) / max(1, len(bucket))
    for b in range(code.shape[1]):
        odds = [grams[code[:, b] == s].sum(0) for s in (1, -1)]
        odds = [np.log((o + 1e-3) / (o.sum() + 1e-3 * size)) for o in odds]
        per.append(odds[0] - odds[1])
    weights = np.stack(per, 1).astype(np.float32) if per else np.zeros((size, 0), np.float32)
    slopes, trust = np.ones(code.shape[1]), np.ones(code.shape[1])
    if code.shape[1] and len(side):
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        z, y = np.concatenate([_sums(weights, texts.slice(a, b - a)) for a, b in slices(sizes)]), code[side]
        for b in range(code.shape[1]):
            for _ in range(25):  # Newton steps for the slope, with a weak pull to 1
                p = 1 / (1 + np.exp(y[:, b] * z[:, b] * slopes[b]))
                step = ((y[:, b] * z[:, b] * p).sum() - 1e-3 * (slopes[b] - 1)) / ((z[:, b] ** 2 * p * (1 - p)).sum() + 1e-3)
                slopes[b] = np.clip(slopes[b] + np.clip(step, -1, 1), 0.1, 20)
            trust[b] = max(0.05, 2 * (np.sign(z[:, b]) == y[:, b]).mean() - 1)
    return Model(names, code, weights, slopes, trust)


def _predictor(model, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        names = pa.array([*fitted.languages, UNKNOWN])
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            known = batch.column("letters").to_numpy(zero_copy_only=False) & bool(fitted.languages)
            best, score, gap = np.full(len(texts), len(fitted.languages)), np.zeros(len(texts)), np.ones(len(texts))
            if fitted.languages:
                for a, b in slices(sizes):
                    best[a:b], score[a:b], gap[a:b] = fitted.predict(texts.slice(a, b - a))
            best, score, gap = np.where(known, best, len(fitted.languages)), np.where(known, score, 0.0), np.where(known, gap, 1.0)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("letters",)}
            columns |= {"lang_pred": names.take(pa.array(best)), "score": pa.array(score), "ambiguous": pa.array(gap < margin)}
            yield pa.record_batch(list(columns.values()), list(columns))

    return run


def predict(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """docs(text, ...) with lang_pred, score and ambiguous added."""
    spark = docs.sparkSession
    ship(spark)
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType(docs.schema.fields).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("*", letters).mapInArrow(_predictor(spark.sparkContext.broadcast(model), margin), schema)


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row of docs(doc_id, text, lang)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    found = predict(plain.select("doc_id", "text"), fit(plain, rows_per_language))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows of documents whose language is recognised: neither ``und`` nor ambiguous; the columns stay."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # The rows travel as one struct, so that no column of theirs can clash with a result.
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    found = predict(packed, fit(plain, rows_per_language))
    return found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")
