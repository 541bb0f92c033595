"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's lower-cased letters, with one space for whatever lies
between them, hashed into ``BUCKETS``; values are ``(1 + log tf) * idf``, scaled to length 1. The
document frequencies behind ``idf`` are counted over all documents that may be learnt from. The
classifier is trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties; the first penalty leaves most weights at exactly zero. A temperature, fitted on rows
that the weights have not seen, turns the scores into probabilities.

What is learnt from: documents with a language whose ``crc32(doc_id) mod 4`` is not 2. Every
language is learnt, however many there are. Weights and temperature use at most ``PER_LANGUAGE``
documents of each, and about ``TRAIN_ROWS`` in all (one of each language at least), those of smallest
hash of id and text; every fifth serves the temperature. The driver holds two numbers for each
bucket and language while it learns (half a MB a language).

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing can be learnt; rows without ``doc_id`` are not held out and not learnt from; ties go to
the first language by code point; extra columns are ignored.

The pipeline's stage asks two things of a document, both judged by the rows set aside for the
temperature. Its score must lie above a guess's 1/K by a share of the way to 1, so that the rule
means the same for any number K of languages. And enough of the weight of its n-grams must fall on
n-grams that the model knows (with a weight; with one language, seen in training): at least half
way from what falls there by chance to what 99 % of the rows set aside reach (less than half way
if they are few, as ``FEW`` says).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, pieces, table

BUCKETS, PER_LANGUAGE, TRAIN_ROWS, UNKNOWN = 1 << 15, 600, 24_000, "und"
ALPHA, BETA, L1, L2, EPOCHS, SEED = 1.0, 1.0, 0.02, 1e-3, 3, 3
#: The pipeline rejects what is less sure than this share of the way from a guess to certainty, or than 99 % of the rows set aside.
REJECT_BELOW, LOWEST_SHARE, FEW = 0.1, 0.01, 10
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text's n-grams, or None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))
    p = np.where(is_letter, points, 32)[keep].astype(np.uint32)
    p = np.concatenate((np.array([32], np.uint32), p, np.array([32], np.uint32)))
    one = p * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
    mixed = np.concatenate((one, two, three))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[ids]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def known_share(ids: np.ndarray, values: np.ndarray, known: np.ndarray) -> float:
    """The share of a text's squared n-gram values that falls on known buckets."""
    return float((values * values)[known[ids]].sum() / max(float(values @ values), 1e-12))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    idf: np.ndarray
    temperature: float
    known: np.ndarray | None = None  # buckets that the model has learnt something about
    least_known: float = 0.0
    least_margin: float = REJECT_BELOW

    def margin(self, score: float) -> float:
        """Where a score lies between a guess (0) and certainty (1)."""
        k = len(self.languages)
        return 1.0 if k == 1 else (score - 1 / k) / (1 - 1 / k)

    def sure(self, text: str | None) -> bool:
        found = gram_counts(text)
        if found is None or not self.languages:
            return False
        return known_share(found[0], weighted(*found, self.idf), self.known) >= self.least_known and self.margin(self.predict(text)[1]) >= self.least_margin

    def probabilities(self, text: str | None) -> np.ndarray | None:
        found = gram_counts(text)
        if found is None or not self.languages:
            return None
        z = weighted(*found, self.idf) @ self.weights[found[0]] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        p = self.probabilities(text)
        return (UNKNOWN, 0.0) if p is None else (self.languages[int(p.argmax())], float(p.max()))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """FTRL-proximal weights (buckets x classes) for rows of (ids, values, class)."""
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            w = solved(z[ids], n[ids])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    return solved(z, n)


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    may = own.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_seen = np.zeros(BUCKETS + 1, np.int64), 0
        for _, texts in pieces(batches, "text"):
            for text in texts:
                found = gram_counts(text)
                if found is not None:
                    total[found[0]] += 1
                    docs_seen += 1
        total[BUCKETS] = docs_seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["bucket", "n"])

    df = map_batches(may.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    seen = np.zeros(BUCKETS + 1)
    for r in df:
        seen[r.bucket] = r.n
    idf = np.log((1 + seen[BUCKETS]) / (1 + seen[:BUCKETS])) + 1

    named = may.withColumn("h", F.xxhash64("doc_id", "text", "lang"))
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    names = sorted(sizes)
    most = max(min(per_language, train_rows // max(len(names), 1)), 1)
    # no task gets a language's every row: first those below a hash that a few more than enough are below
    n_of = F.broadcast(may.sparkSession.createDataFrame([(k, float(n)) for k, n in sizes.items()], "lang string, n_lang double"))
    below = F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.lit(2.0 * most + 64) / F.col("n_lang")
    few = named.select("doc_id", "lang", "h").join(n_of, "lang").filter(below).select("doc_id", "lang", "h").distinct()
    chosen = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id"))).filter(F.col("i") <= most)
    sample = named.join(F.broadcast(chosen.drop("i")), ["doc_id", "lang", "h"]).groupBy("doc_id", "lang", "h").agg(F.first("text").alias("text")).select("doc_id", "lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = [gram_counts(t) for t in texts]
            ids = [None if f is None else f[0].astype(np.uint16).tobytes() for f in found]
            counts = [None if f is None else f[1].astype(np.uint32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "ids", "counts"])

    rows = map_batches(sample, counted, "doc_id long, lang string, ids binary, counts binary").filter("ids is not null").collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.ids)))
    data = []
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint16).astype(np.int64)
        if r.lang in names:
            data.append((ids, weighted(ids, np.frombuffer(r.counts, np.uint32), idf), names.index(r.lang)))
    names_kept = sorted({names[y] for _, _, y in data})
    at = {names.index(x): i for i, x in enumerate(names_kept)}
    data = [(ids, x, at[y]) for ids, x, y in data]
    train, rest = [d for i, d in enumerate(data) if i % 5], [d for i, d in enumerate(data) if i % 5 == 0]
    weights = ftrl(train, max(len(names_kept), 1))
    logits = np.array([x @ weights[ids] for ids, x, _ in rest]).reshape(len(rest), weights.shape[1])
    y = np.array([y for _, _, y in rest], np.int64)
    model = LanguageModel(names_kept, weights.astype(np.float32), idf.astype(np.float32), fitted_temperature(logits, y))
    return with_limits(model, train, rest, logits)


def with_limits(model: LanguageModel, train: list, rest: list, logits: np.ndarray) -> LanguageModel:
    """``model`` with what the pipeline asks of a document, by the rows ``rest`` that the weights have not seen."""
    model.known = (model.weights != 0).any(axis=1)
    if len(model.languages) < 2:
        for ids, _, _ in train:
            model.known[ids] = True
    if rest and model.languages:
        by_chance = float(model.known.mean())
        usual = float(np.quantile([known_share(ids, x, model.known) for ids, x, _ in rest], LOWEST_SHARE))
        trust = len(rest) / (len(rest) + FEW)
        model.least_known = min(by_chance + trust * (usual - by_chance) / 2, usual)
        p = np.exp((logits - logits.max(axis=1, keepdims=True)) / model.temperature)
        margins = [model.margin(float(s)) for s in p.max(axis=1) / p.sum(axis=1)]
        model.least_margin = max(min(REJECT_BELOW, float(np.quantile(margins, LOWEST_SHARE))), 1e-6)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score. The prediction reads the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    names = [*own.columns, "lang_pred", "score"]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            found = [shared.value.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    return map_batches(own, predicted, T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject_unsure(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, of no sure language or of none that was learnt, go."""
    model = fit(docs)
    shared = spark.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            yield part.filter(pa.array([shared.value.sure(t) for t in texts], pa.bool_()))

    own = docs.withColumn("text", F.col("text").cast("string"))
    return map_batches(own, good, own.schema)
