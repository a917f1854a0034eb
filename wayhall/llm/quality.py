"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 4).

P(grade > k) = sigmoid(x.w - t_k): one weight vector over hashed text features, shared by all grades, and ordered
thresholds t_0 < t_1 < ... Expected grade and tail probability follow; documents are selected by the tail probability.

Features are rates per word of hashed words, word beginnings and word endings (their case kept, so that shouting,
separators and symbols show), and of the length class. The model is fitted on the driver on a sample of at most
``max_rows`` labelled rows, of which only hashed features are gathered. Scoring reads each text once and moves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayhall.llm.samples import labelled_sample
from wayhall.llm.textkit import U, Chunk, Hasher, chunks, mix, not_white

BITS = 18
MAX_ROWS = 6000


class Featuriser:
    """Hashed features of each word: three numbers below 2**BITS."""

    def __init__(self) -> None:
        self.lower, self.exact, self.table = Hasher(True, 11), Hasher(False, 12), not_white()

    def word_features(self, chunk: Chunk) -> np.ndarray:
        d, s, e = chunk.data, chunk.starts, chunk.ends
        word = self.lower.spans(d, s, e)
        first = mix(self.exact.spans(d, s, np.minimum(e, s + 2)) + U(1))
        last = mix(self.exact.spans(d, np.maximum(s, e - 2), e) + U(2))
        return (np.stack([word, first, last], 1) >> U(64 - BITS)).astype(np.int32)

    @staticmethod
    def length_feature(counts: np.ndarray) -> np.ndarray:
        return (mix(np.log2(counts + 1.0).astype(np.int64).astype(U) + U(99)) >> U(64 - BITS)).astype(np.int32)


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(tails), float(self.grades[0]))


def fit_ordinal(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-6) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood of sparse rows."""
    grades = sorted(set(label.tolist()))
    k = max(1, len(grades) - 1)
    if len(grades) < 2:
        return OrdinalModel(grades or [0.0], np.zeros(1 << BITS, np.float32), np.full(k, -50.0))
    y = np.searchsorted(grades, label)
    above = (y[:, None] > np.arange(k)[None, :]).mean(0)
    cut = np.log((1 - above) / above)
    theta = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    w, owner = np.zeros(1 << BITS), np.repeat(np.arange(len(y)), np.diff(indptr))
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        margin = np.bincount(owner, weights=w[index] * value, minlength=len(y))
        s = 1 / (1 + np.exp(-np.clip(cuts[None, :] - margin[:, None], -30, 30)))
        full = np.concatenate([np.zeros((len(y), 1)), s, np.ones((len(y), 1))], 1)
        slope = full * (1 - full)
        p = np.maximum(np.take_along_axis(full, y[:, None] + 1, 1) - np.take_along_axis(full, y[:, None], 1), 1e-12)[:, 0]
        up, low = np.take_along_axis(slope, y[:, None] + 1, 1)[:, 0], np.take_along_axis(slope, y[:, None], 1)[:, 0]
        g_margin = (up - low) / p / len(y)
        g = np.bincount(index, weights=g_margin[owner] * value, minlength=len(w)) + decay * w
        g_cut = np.array([(np.where(y == j + 1, low, 0) - np.where(y == j, up, 0)).__truediv__(p).sum() for j in range(k)]) / len(y)
        g_theta = np.concatenate([[g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(theta[1:])])
        for x, gx, a, b in ((w, g, m, v), (theta, g_theta, mt, vt)):
            a += 0.1 * (gx - a)
            b += 0.001 * (gx * gx - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(grades, w.astype(np.float32), np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit_quality(docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on at most max_rows labelled rows. Without labelled rows every document gets grade 0 and tail probability 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featuriser()
        for batch in batches:
            for c in chunks(batch.column(0), f.table):
                words, at, size = f.word_features(c), c.offsets, f.length_feature(c.counts)
                index, value = [], []
                for i in range(c.docs):
                    ids, n = np.unique(words[at[i] : at[i + 1]], return_counts=True)
                    index.append(np.append(ids, size[i]).astype(np.int32))
                    value.append(np.append(n / max(1, c.counts[i]), 1.0).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.first, c.docs), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["label", "index", "value"])

    sample = labelled_sample(docs, labels, grade, max_rows)
    rows = sample.mapInArrow(run, "label double, index array<int>, value array<float>").toArrow()
    index, value = (rows.column(k).combine_chunks() for k in (1, 2))
    if isinstance(index, pa.ChunkedArray):
        index, value = (pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.list_(pa.int32())) for x in (index, value))
    sizes = np.array([len(x) for x in index], np.int64)
    indptr = np.concatenate(([0], np.cumsum(sizes)))
    return fit_ordinal(indptr, index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False).astype(float), rows.column(0).to_numpy())


def score_quality(docs: DataFrame, model: OrdinalModel, keep: list[str], at_least: float, threshold: float, text_col: str = "text") -> DataFrame:
    """The columns keep of docs with expected_grade, tail_probability (of grade at_least or more) and selected.

    Null, empty and blank texts have no words; their length class alone decides. Each row is scored on its own, so
    repeated rows get equal scores. An empty table gives an empty result. keep may not hold the added names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    tail = int(np.searchsorted(model.grades, at_least)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Featuriser(), sent.value
        for batch in batches:
            margins = [np.zeros(0)]
            for c in chunks(batch.column(0), f.table):
                total = np.bincount(c.owner, weights=m.weights[f.word_features(c)].sum(1), minlength=c.docs)
                margins.append(total / np.maximum(1, c.counts) + m.weights[f.length_feature(c.counts)])
            tails = m.tails(np.concatenate(margins))
            p = tails[:, min(tail, tails.shape[1] - 1)] if tail >= 0 else np.ones(len(tails))
            own = [batch.column(k + 1) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(m.expected(tails)), pa.array(p), pa.array(p >= threshold)], [*keep, "expected_grade", "tail_probability", "selected"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, kinds + "expected_grade double, tail_probability double, selected boolean")


def select_quality(docs: DataFrame, labels: DataFrame, grade: Column, at_least: float, threshold: float, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose probability of grade at_least or more reaches threshold."""
    names = docs.columns
    model = fit_quality(docs, labels, grade, max_rows)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    scored = score_quality(plain, model, plain.columns, at_least, threshold, f"c{names.index('text')}")
    return scored.where("selected").select(*plain.columns).toDF(*names)
