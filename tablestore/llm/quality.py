"""Quality grades by ordinal regression on hashed text.

Ratings become grades in order: 0 toxic, 1 poor, 2 good. One weight vector over hashed features is shared by all grades, and
ordered thresholds cut the score: P(grade <= g) = sigmoid(threshold[g] - weights . features). The weights are fitted on the driver
to a bounded sample of the labelled rows, chosen by a hash of their id; all documents are scored in place, each from
its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestore.llm import blocks

#: Labelled rows that the model is fitted to, at most.
SAMPLE_ROWS = 8_000
#: Hashed features, as a power of two.
WIDTH = 18
STEPS, RATE, DECAY = 200, 0.05, 1e-4
#: Documents stay if P(grade >= 2) is at least this.
KEEP = 0.65
SLICE_BYTES = 8 << 20
#: Letters and digits of a word as classes, for its shape; other signs stand for themselves.
SHAPE = bytes((65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b) for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """The word's classes of signs, runs as one: `Ab12!!` has the shape `Aa0!`."""
    return RUNS.sub(rb"\1", word.translate(SHAPE))


def features(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values, and where each text's features start.

    Features are the lower-cased words without outer punctuation (each once, for a value that falls with the number of
    distinct words), the shapes of words (their share of the words, times 8), and buckets of the text's length and of
    its share of distinct words. A text without words has only the buckets.
    """
    w = blocks.Words(texts)
    mask = (1 << width) - 1
    digest = xxhash.xxh64_intdigest
    raw = [x.as_buffer().to_pybytes() for x in w.vocabulary.cast(pa.large_binary())]
    words = np.fromiter((digest(x.lower().strip(b".,;:!?\"'()*#%$&|") or x, 1) & mask for x in raw), np.int64, len(raw))
    shapes = np.fromiter((digest(shape(x), 2) & mask for x in raw), np.int64, len(raw))
    sizes = w.lengths()
    text = np.repeat(np.arange(len(w)), sizes)
    span = 1 << width

    def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, count = np.unique(text * span + numbers, return_counts=True)
        return pairs // span, pairs % span, count

    of_word, word, _ = counted(words[w.ids])
    of_shape, form, n = counted(shapes[w.ids])
    distinct = np.bincount(of_word, minlength=len(w))
    lengths = [digest(b"%d" % b, 3) & mask for b in np.log2(sizes + 1).astype(int).tolist()]
    shares = [digest(b"%d" % b, 4) & mask for b in (10 * distinct / np.maximum(sizes, 1)).astype(int).tolist()]
    every = np.arange(len(w))
    owner = np.concatenate([of_word, of_shape, every, every])
    number = np.concatenate([word, form, np.array(lengths, np.int64), np.array(shares, np.int64)])
    damped = (100 / (100 + distinct)) ** 0.75
    value = np.concatenate([damped[of_word], 8 * n / sizes[of_shape], np.ones(2 * len(w))])
    order = np.argsort(owner, kind="stable")
    starts = np.append(0, np.cumsum(np.bincount(owner, minlength=len(w))))
    return number[order], value[order].astype(np.float32), starts


class Ordinal:
    """Shared weights and rising thresholds of a cumulative-link model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, number: np.ndarray, value: np.ndarray, starts: np.ndarray, grades: np.ndarray, top: int, width: int = WIDTH) -> "Ordinal":
        """Full-batch Adam on the mean log-likelihood with weight decay; no randomness.

        Features in no more than one of a thousand texts get no weight.
        """
        n = len(grades)
        often = np.bincount(number, minlength=1 << width)[number] > n // 1000
        starts = np.append(0, np.cumsum(often))[starts]
        number, value = number[often], value[often]
        rows = np.repeat(np.arange(n), np.diff(starts))
        share = np.array([(np.sum(grades <= g) + 1) / (n + 2) for g in range(top)])
        cuts = np.log(share / (1 - share))
        # thresholds are the first and the logs of the gaps above it
        free = np.append(cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2)))
        p = np.append(np.zeros(1 << width), free)
        m, v = np.zeros_like(p), np.zeros_like(p)
        size = len(p) - top
        for step in range(1, STEPS + 1):
            _, gradient = cls.loss(p, size, number, value, rows, grades)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
            p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return cls(p[:size].astype(np.float32), cls.rising(p[size:]))

    @classmethod
    def loss(cls, p: np.ndarray, size: int, number: np.ndarray, value: np.ndarray, rows: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood with weight decay, and its gradient.

        p holds `size` weights, then the first threshold and the logs of the gaps above it. Feature `number` of row
        `rows` has `value`.
        """
        n, top = len(grades), len(p) - size
        model = cls(p[:size], cls.rising(p[size:]))
        below = model.below(np.bincount(rows, model.weights[number] * value, n))
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))], 1)
        at = np.arange(n)
        chance = np.maximum(padded[at, grades + 1] - padded[at, grades], 1e-9)
        up, low = slope[at, grades + 1] / chance, slope[at, grades] / chance
        score = (up - low) / n
        gradient = np.bincount(number, value * score[rows], size) + DECAY * p[:size]
        cut = -np.array([np.sum(up[grades == g]) - np.sum(low[grades == g + 1]) for g in range(top)]) / n
        gaps = np.append(cut.sum(), [cut[g:].sum() * np.exp(p[size + g]) for g in range(1, top)])
        return -np.log(chance).mean() + DECAY / 2 * np.sum(p[:size] ** 2), np.append(gradient, gaps)

    @staticmethod
    def rising(free: np.ndarray) -> np.ndarray:
        return free[0] + np.append(0.0, np.cumsum(np.exp(free[1:])))

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= g) for each score and each grade but the last."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))

    def scores(self, number: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return np.bincount(rows, self.weights[number].astype(np.float64) * value, len(starts) - 1)


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if neither rating says."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, rows: int) -> DataFrame:
    """(text, grade) of at most `rows` labelled documents, those of the smallest hash of their id.

    Of several ratings of one id the lowest grade counts. Ratings without document, and null ids, are left out.
    """
    chosen = labels.where(F.col("grade").isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.min("grade").alias("grade"))
    found = chosen.join(docs.select(F.col(id), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")), id).orderBy(F.xxhash64(F.lit("sample"), F.col(id)), id, "digest").limit(rows)
    # a bounded number of ids
    return docs.select(id, text).join(F.broadcast(found.select(id, "grade").dropDuplicates([id])), id).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "grade")


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, width: int = WIDTH) -> Ordinal:
    """Fit the model to labelled documents; `labels` has the id and `grade` (0, 1, 2). Without labels all grades are equal chances."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                number, value, starts = features(b.column("text"), width)
                cut = pa.array(starts, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("grade"), pa.ListArray.from_arrays(cut, pa.array(number, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32()))], names=["grade", "number", "value"])

    got = sample(docs, labels, id, text, rows).mapInArrow(run, "grade int, number array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return Ordinal(np.zeros(1 << width, np.float32), np.log(np.array([0.5, 2.0])))
    number, value = (np.asarray(got[c].combine_chunks().flatten()) for c in ("number", "value"))
    starts = np.append(0, np.cumsum(pc.list_value_length(got["number"]).to_numpy()))
    return Ordinal.fit(number, value, starts, np.asarray(got["grade"]).astype(np.int64), 2, width)


def score(docs: DataFrame, model: Ordinal, id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """One row for each row of docs: id, expected_grade, p_poor_or_better, p_good, kept.

    Null and empty texts have no words and are scored by their length alone. Repeated rows get equal scores.
    """
    width = int(np.log2(len(model.weights)))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        model = Ordinal(*shared.value)
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)) if b.num_rows else []
            start = 0
            while start < b.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
                part = b.slice(start, stop - start)
                tail = 1 - model.below(model.scores(*features(part.column("text"), width)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(tail[:, 1] >= keep)],
                                                 names=["id", "expected_grade", "p_poor_or_better", "p_good", "kept"])
                start = stop

    kind = f"id {dict(rows.dtypes)['id']}, expected_grade double, p_poor_or_better double, p_good double, kept boolean"
    return rows.mapInArrow(run, kind).withColumnRenamed("id", id)
