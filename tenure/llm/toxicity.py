"""Toxicity by multiple-instance learning (operator 6).

A document is a bag of sentences (split at . ! ? and line ends). A sentence's score is a logistic function of
the sum of the weights of its words and of their first 4 and 5 bytes (hashed to 2^18 cells); the document's is the noisy-or of its sentences, 1 - prod(1 - p).
Only document labels are known: their likelihood's gradient flows through the noisy-or to the sentences, so
the training finds which sentences offend. Training takes at most ``SAMPLE`` labelled documents (documented bound) in one
task; scoring runs over all documents and also tells the worst sentence and all that offend.

The decay and the least number of documents of a cell were chosen by a split of training rows alone (README); held-out rows had no
part in it. Training is bounded by rows and by bytes (``labels.py``), and holds a cell number per word and part, some 12 bytes a byte.

Null and empty texts have no sentence: score 0, worst sentence null. Without labels every score is near 0.
Rows with equal ids are scored each for itself. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import LOWER, U, mix, span_hashes, text_blocks, word_spans
from tenure.llm.labels import held_out, in_bound, training_sample

SAMPLE, CELLS, STEPS, RATE, DECAY, LEAST_DOCS, PARTS = 8000, 1 << 18, 80, 0.1, 2e-4, 20, 3

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
_SEPARATOR[ord("a") : ord("z") + 1] = False
_SEPARATOR[ord("0") : ord("9") + 1] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Least score of a sentence that is located as offending.
LOCATED = 0.25


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, PARTS for each word, first cell of each sentence, row of each sentence, number of each sentence in its row)."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, _SEPARATOR)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    cell = np.empty((len(starts), PARTS), np.int32)
    for k, size in enumerate((0, 4, 5)):  # the word, and stems that inflected forms share
        part = span_hashes(low, starts, np.minimum(starts + size, ends) if size else ends)
        cell[:, k] = mix(part + U(k)) >> U(46)
    stops = np.flatnonzero(_STOP[data])
    sentence = np.searchsorted(stops, starts) + row
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    of = row[first]
    new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    number = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
    return cell.ravel(), first * PARTS, of, number


def sentence_scores(weights: np.ndarray, cell: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities; the last weight is the bias."""
    if not len(first):
        return np.zeros(0)
    z = np.add.reduceat(weights[cell].astype(np.float64), first) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    return -np.expm1(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows))


def loss(weights: np.ndarray, cell: np.ndarray, first: np.ndarray, of: np.ndarray, label: np.ndarray) -> float:
    """Mean negative log likelihood of the documents' labels."""
    doc = np.clip(noisy_or(sentence_scores(weights, cell, first), of, len(label)), 1e-9, 1 - 1e-12)
    return float(-np.where(label == 1, np.log(doc), np.log1p(-doc)).mean())


def gradient(weights: np.ndarray, cell: np.ndarray, first: np.ndarray, of: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of ``loss``: through the noisy-or a sentence of a toxic document pulls by its share in the document's score."""
    sentence = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(cell))))
    p = sentence_scores(weights, cell, first)
    doc = np.clip(noisy_or(p, of, len(label)), 1e-9, 1 - 1e-12)
    pull = p * np.where(label[of] == 1, -(1 - doc[of]) / doc[of], 1.0) / len(label)
    return np.append(np.bincount(cell, pull[sentence], minlength=CELLS), pull.sum())


def fit(cell: np.ndarray, first: np.ndarray, of: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, least_docs: int = LEAST_DOCS) -> np.ndarray:
    """Weights of cells and the bias, by Adam on the documents' likelihood; rare cells stay 0."""
    weights = np.zeros(CELLS + 1)
    weights[-1] = -4.0
    if not len(first):
        return weights
    sentence = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(cell))))
    pairs = np.unique(of[sentence] * np.int64(CELLS) + cell) % CELLS
    usual = np.append(np.bincount(pairs, minlength=CELLS) >= least_docs, True)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights, cell, first, of, label) * usual
        g[:-1] += decay * weights[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, label, base = [], [], [0, 0]
    for rows, data, offsets in text_blocks(in_bound(batches)):
        cell, first, of, _ = bags(data, offsets)
        parts.append((cell, first + base[0], of + base[1]))
        base = [base[0] + len(cell), base[1] + rows.num_rows]
        label += rows.column("label").to_pylist()
    if parts:
        cell, first, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fit(cell, first, of, np.array(label)).astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def _score(weights_of, located: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(weights_of.value, np.float32)
        for rows, data, offsets in text_blocks(batches):
            n = rows.num_rows
            cell, first, of, number = bags(data, offsets)
            p = sentence_scores(weights, cell, first)
            best = np.full(n, -1.0)
            np.maximum.at(best, of, p)
            worst = np.full(n, -1)
            hit = np.flatnonzero(p == best[of])[::-1]
            worst[of[hit]] = number[hit]  # the first of equals
            none = best < 0
            over = np.flatnonzero(p >= located)
            over = over[np.lexsort((number[over], of[over]))]
            each = pa.StructArray.from_arrays([pa.array(number[over].astype(np.int64)), pa.array(p[over].astype(np.float64))], ["sentence", "score"])
            offending = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[over], minlength=n))]).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.clip(noisy_or(p, of, n), 0, 1)), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(worst, mask=none), pa.array(best, mask=none), offending],
                names=["doc_id", "held_out", "score", "n_sentences", "worst_sentence", "worst_score", "offending"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bound: float = 0.5, located: float = LOCATED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, worst_sentence, worst_score, offending) of every row of ``docs``. ``offending``: number and score of
    every sentence that scores ``located`` or more, in order; the worst one is given whatever its score."""
    spark = docs.sparkSession
    fitted = training_sample(docs, labels, "toxic", sample).repartition(1).sortWithinPartitions("doc_id").mapInArrow(_train, "weights binary").first()
    start = np.zeros(CELLS + 1, np.float32)
    start[-1] = -10
    weights = spark.sparkContext.broadcast(bytes(fitted["weights"]) if fitted else start.tobytes())  # 1 MB, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    rows = rows.mapInArrow(_score(weights, located), "doc_id long, held_out boolean, score double, n_sentences long, worst_sentence long, worst_score double, offending array<struct<sentence:long,score:double>>")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= bound).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score", "offending")
