"""Language identification by string kernels.

A text is the set of its character n-grams for n = 1, 2, 3 (presence, not counts), each
n in bins of its own; the blended-spectrum kernel is the mean over n of the cosine of two
such sets. Landmark texts give the Nyström map, kernel ridge regression one weight vector
per language against the rest, and a batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.llm.common import slices
from popgraph.plans.stage import small_enough, stage

#: Bins for n-grams of n = 1, 2, 3.
BINS = (512, 4096, 16384)
WIDTH = sum(BINS)
#: Bounds of the sample that the classifier is fitted on: texts per language, texts in all.
PER_LANGUAGE = 400
AT_MOST = 4096
LANDMARKS = 128
#: Languages whose counts are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
RIDGE = 1e-3
SHARPNESS = 6.0
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Presence of each bin for the whole text."""
    flags = np.zeros(WIDTH, bool)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h, at = np.zeros(len(c), np.uint32), 0
    for n, bins in enumerate(BINS, 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        flags[at + (mixed >> np.uint32(32 - bins.bit_length() + 1))] = True
        at += bins
    return flags


def scaled(flags: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the kernel."""
    out, at = flags.astype(np.float32), 0
    for bins in BINS:
        part = out[:, at : at + bins]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(BINS))
        at += bins
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            rows = [(lang, np.packbits(grams(t)).tobytes()) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["lang", "bits"])


class Model:
    """Landmarks (packed presence bits), coefficients and language names."""

    def __init__(self, languages: list[str], bits: np.ndarray, coef: np.ndarray):
        self.languages, self.bits, self.coef = languages, bits, coef

    def score(self, flags: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_landmarks"):
            self._landmarks = scaled(np.unpackbits(self.bits, axis=1)[:, :WIDTH]).T.copy()
        f = (scaled(flags) @ self._landmarks) @ self.coef * SHARPNESS
        e = np.exp(f - f.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __getstate__(self):
        return {"languages": self.languages, "bits": self.bits, "coef": self.coef}


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    at_most: int = AT_MOST,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> Model:
    """Learns from labelled rows that are not held out.

    The sample is bounded: of each language ``per_language`` rows, those whose ids hash
    lowest, ``at_most`` in all, languages in turn. Rows that repeat an id are told apart
    by the hash of their texts; rows that repeat both count once. Only packed n-gram sets
    reach the driver. With more languages than ``at_most`` the last ones by name are not
    learned. Without a labelled row the model has no language. Columns but the three named
    ones are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.withColumn("_of", F.xxhash64("_text"))
    labelled = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    # a draw below four times the share that is wanted: few rows reach the ranking, however many tasks read
    counts = stage(labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_lang").alias("_l"), "_n"), "language-counts")
    counts = F.broadcast(counts) if small_enough(counts, BROADCAST_LANGUAGES) else counts
    drawn = labelled.select("_id", "_of", "_lang", F.xxhash64("_id").alias("_draw")).join(counts, F.col("_lang") == F.col("_l"))
    drawn = drawn.where(F.col("_draw") / 2.0**64 + 0.5 < 4.0 * per_language / F.col("_n")).select("_id", "_of", "_lang", "_draw").distinct()
    rank = F.row_number().over(W.partitionBy("_lang").orderBy("_draw", "_id", "_of"))
    chosen = drawn.withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    chosen = chosen.orderBy("_rank", "_lang").limit(at_most).select("_id", "_of", "_lang")
    sample = labelled.join(F.broadcast(chosen), ["_id", "_of", "_lang"], "left_semi").select("_lang", "_text")  # at most ``at_most`` keys
    # a row repeated in full gives one set of n-grams
    got = sorted(tuple(r) for r in sample.mapInArrow(_features, "lang string, bits binary").distinct().collect())
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return Model([], np.zeros((0, WIDTH // 8), np.uint8), np.zeros((0, 0), np.float32))
    bits = np.stack([np.frombuffer(b, np.uint8) for _, b in got])
    labels = np.array([languages.index(lang) for lang, _ in got])
    each = max(landmarks // len(languages), 1)
    order = np.random.default_rng(7).permutation(len(got))
    chosen = np.concatenate([order[labels[order] == k][:each] for k in range(len(languages))])
    x = scaled(np.unpackbits(bits, axis=1)[:, :WIDTH])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = (x @ marks.T).astype(np.float64) @ root
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weigh = 1 / np.bincount(labels)[labels]  # languages count alike
    gram = phi.T @ (phi * weigh[:, None]) + ridge * np.eye(len(chosen))
    coef = root @ np.linalg.solve(gram, phi.T @ (target * weigh[:, None]))
    return Model(languages, bits[chosen], coef.astype(np.float32))


def predictions(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 for null texts and texts without a letter."""
    known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    langs, score = ["und"] * len(texts), np.zeros(len(texts))
    if known:
        p = model.score(np.stack([grams(texts[i]) for i in known]))
        best = p.argmax(axis=1)
        for k, i in enumerate(known):
            langs[i], score[i] = model.languages[best[k]], float(p[k, best[k]])
    return langs, score


def _predict(model: Model, text_at: int, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 64):
                langs, score = predictions(model, b.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score)], [*b.schema.names, *added])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "_lang_pred", score_col: str = "_score") -> DataFrame:
    """``docs``, all columns, with ``pred_col`` and ``score_col`` (0 to 1) of the whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if
    nothing was learned. Ties go to the language that sorts first. Repeated rows are
    rows of their own; no column but the text is an input. The two names must not be
    among those of ``docs``.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(_predict(model, docs.columns.index(text_col), [pred_col, score_col]), schema)
