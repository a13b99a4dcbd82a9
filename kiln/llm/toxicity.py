"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated models with absolute discounting, one of toxic and one of ordinary documents, give each
word a likelihood from its characters. Only n-grams of the full order, and shorter ones at the beginning of a word, are counted
by class; both models back off to the same continuation counts (after how many different characters of either class
a shorter n-gram was seen), so an expression that neither class knows says nothing. N-grams do not reach over the
borders of words. The difference of the
log-likelihoods is compared per word and normalised by length: the share of words beyond some differences, the mean, and
the strongest run of words. A logistic curve over these, fitted on documents that the models in question did not
see (cross-fitting), gives the score.

An n-gram counts once per document that has it in a word, so a document that repeats itself weighs no more than others.

Labels are fitted on a bounded sample: at most ``per_class`` labelled documents of each class, those with the
smallest hashes of their ids; of very long documents fewer, so that about ``MAX_LETTERS`` letters of a class are learned from. All
n-grams in them are counted by Spark; their number, and so the model that every worker gets, is bounded by the letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.char_grams import CharModels, gram_counts, kneser_ney, plain, share_of
from kiln.llm.common import held_out, materialise, table
from kiln.llm.scoring import WordTable, add_scores, texts_of
from kiln.llm.words import sums_by_doc

ORDER = 4
FOLDS = 3
PER_CLASS = 4000
#: Letters of a class to learn from (expected); with ORDER n-grams for each at most, the size of the model is bounded.
MAX_LETTERS = 32_000_000
#: Differences of log-likelihood (nats) beyond which a word counts, and the words in a run.
STEPS = (1.5, 2.0, 2.5, 3.0, 4.0)
RUN = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of the documents to learn from (doc_id, text, toxic, fold), and how many labels each class has.

    Only labels of documents whose crc32 of the id modulo 5 is not 0 are used. Of an id with several labels the toxic one counts.
    """
    usable = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("_id")
    first = [usable.where(F.col("toxic") == k).orderBy(order, "_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * per_class rows
    sample = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    sample = materialise(sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold), "toxic-sample")
    sizes = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("letters")).collect()
    shares = {r["toxic"]: share_of(r["rows"], r["letters"] or 0, per_class, MAX_LETTERS) for r in sizes}
    chance = F.pmod(F.xxhash64("doc_id", F.lit("letters")), F.lit(1 << 20)) / (1 << 20)
    return sample.where(chance < F.when(F.col("toxic") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))), counts


def features(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-normalised evidence of texts from the differences of their words (``first``: where each text's words begin)."""
    n = np.diff(first)
    some = np.maximum(n, 1)
    rates = [sums_by_doc((values > s).astype(np.float64), first) for s in STEPS]
    clipped = np.clip(values, -1, 6).astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(clipped)])
    end = np.minimum(np.arange(len(values)) + RUN, np.repeat(first[1:], n))
    run = (sums[end] - sums[:-1]) / RUN
    best = np.zeros(len(n))
    if len(run):
        best[n > 0] = np.maximum.reduceat(run, first[:-1][n > 0])
    return np.stack(
        [
            *[np.sqrt(r / some) for r in rates],
            *[np.log1p(r) for r in rates],
            best,
            sums_by_doc(clipped, first) / some,
            np.log1p(n),
        ],
        axis=1,
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps: (mean, scale, coefficients with the constant last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    weight = weight / weight.sum()
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + np.diag(penalty + 1e-9), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


class Scorer:
    """Scores slices of texts; built in each task from the broadcast model."""

    def __init__(self, models: CharModels, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        def differences(words: list[bytes]) -> np.ndarray:
            both = models.log_likelihoods([plain(w) for w in words])
            return both[:, 1] - both[:, 0]

        self.words = WordTable(1, differences)
        self.curve = curve

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, first = self.words.of(texts_of(data, offsets))
        return features(rows[:, 0], first)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        mean, scale, beta = self.curve
        z = ((self.features(data, offsets) - mean) / scale) @ beta[:-1] + beta[-1]
        return [1 / (1 + np.exp(-np.clip(z, -30, 30)))]


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Add ``toxic_score`` (0 to 1) to ``docs`` (doc_id, text and any other columns).

    Learns from ``labels`` (doc_id, toxic) as described above. Labels other than 0 and 1, labels without a document and
    documents without a label are not learned from. Empty and null texts get the score of a text without evidence;
    without labels of both classes every score is the smoothed share of toxic labels; repeated rows score
    alike; an empty table stays empty; other columns pass through.
    """
    spark = docs.sparkSession
    sample, counts = labelled_sample(docs, labels, per_class)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        ordinary, toxic = counts.get(0, 0), counts.get(1, 0)
        return docs.withColumn("toxic_score", F.lit((toxic + 0.5) / (ordinary + toxic + 2)))
    group = (F.col("toxic") * FOLDS + F.col("fold")).alias("group")
    without = [[], *[[fold, FOLDS + fold] for fold in range(FOLDS)]]
    k, gram, context, counts_by, start, left = gram_counts(sample.select("text", group), 2 * FOLDS, ORDER, without)
    c = counts_by.reshape(-1, 2, FOLDS)
    width = len(features(np.zeros(0), np.zeros(2, np.int64))[0])
    fitted = []
    for fold in range(FOLDS):  # documents of a fold are judged by models that have not counted them
        others = kneser_ney(k, c.sum(axis=2) - c[:, :, fold], start, left[:, 1 + fold])
        rest = spark.sparkContext.broadcast(CharModels(k, gram, context, others))
        seen = add_scores(
            sample.where(F.col("fold") == fold).select("toxic", "text"),
            "text",
            ", ".join(f"f{i} double" for i in range(width)),
            lambda rest=rest: (lambda s: lambda data, offsets: list(s.features(data, offsets).T))(Scorer(rest.value)),
        )
        fitted.append(seen.drop("text").toArrow())  # at most 2 * per_class rows of numbers in all folds
        rest.unpersist()
    got = pa.concat_tables(fitted)
    x = np.stack([got[f"f{i}"].to_numpy() for i in range(width)], axis=1)
    y = got["toxic"].to_numpy().astype(float)
    weight = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    models = CharModels(k, gram, context, kneser_ney(k, c.sum(axis=2), start, left[:, 0]))
    ready = spark.sparkContext.broadcast((models, fit_logistic(x, y, weight)))
    return add_scores(docs, "text", "toxic_score double", lambda: Scorer(*ready.value))


def op1_kneser_ney_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
