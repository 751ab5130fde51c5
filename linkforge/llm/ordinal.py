"""Ordinal regression of graded quality: one weight a hashed word, shared by all grades, and ordered thresholds.

P(grade > k) = sigmoid(score - threshold_k). The score is a sum of weights over the distinct
words of a text, looked up in a hashed table; the thresholds are kept in order by writing them
as a first one and positive steps. The expected grade is the sum of the tail probabilities.

Nulls count as empty texts: their score is that of no words. Whole texts are scored, and whole
texts are learned from, however long. Rows that repeat get equal scores; rows with a null key are
scored, never learned from. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.sampling import least_hashes
from linkforge.llm.text import raw, shingles, slices, words

#: The hashed table's size, the labelled rows and their words that the fit may take at most together, and the least rows a feature must be in.
BITS, SAMPLE_ROWS, SAMPLE_WORDS, LEAST = 18, 20_000, 12_000_000, 4


def features(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct hashed words; words split at ASCII white space, with and without signs at their ends."""
    h, _, first = words(buf, off)
    plain = buf.copy()
    plain[~_LETTER[buf]] = 32
    g, _, first_g = words(plain, off)
    mask = np.uint64((1 << BITS) - 1)
    one = shingles(h, first, 1)
    two = shingles(g, first_g, 1)
    return [np.unique(np.concatenate((a, b)) & mask).astype(np.int64) for a, b in zip(one, two)]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))

    def score(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in feats], float)


def features_of(texts: list[str | None]) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["t"])
    return [f.astype(np.int32) for part in slices(batch, "t") for f in features(*raw(part.column(0)))]


def fit(feats: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 60, l2: float = 0.02, seed: int = 0) -> Model:
    """Fit by gradient steps with per-weight rates (Adagrad), all rows at once. feats: of features(); grades: 0 to levels - 1."""
    size = 1 << BITS
    seen = np.zeros(size, np.int64)
    for f in feats:
        seen[f] += 1
    feats = [f[seen[f] >= LEAST] for f in feats]
    n = len(feats)
    w, cut = np.zeros(size), np.linspace(-1, 1, levels - 1) if levels > 1 else np.zeros(0)
    if not n or levels < 2:
        return Model(w, cut)
    first, steps = cut[0], np.log(np.maximum(np.diff(cut), 1e-3))
    cols = np.concatenate(feats)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in feats])
    above = (grades[:, None] > np.arange(levels - 1)[None, :]).astype(float)
    # Rare grades weigh as much as common ones.
    count = np.bincount(grades, minlength=levels)
    weight = (n / (levels * np.maximum(count, 1)))[grades]
    g_w, g_first, g_steps = np.full(size, 1e-8), 1e-8, np.full(len(steps), 1e-8)
    for _ in range(epochs):
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
        score = np.bincount(rows, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -60, 60)))
        err = (p - above) * weight[:, None]
        d_score = err.sum(1) / n
        d_w = np.bincount(cols, d_score[rows], size) + l2 * w / n
        d_theta = -err.sum(0) / n
        d_first = d_theta.sum()
        d_steps = np.array([d_theta[k + 1 :].sum() for k in range(len(steps))]) * np.exp(steps)
        g_w += d_w**2
        g_first += d_first**2
        g_steps += d_steps**2
        w -= 0.3 * d_w / np.sqrt(g_w)
        first -= 0.3 * d_first / np.sqrt(g_first)
        steps -= 0.3 * d_steps / np.sqrt(g_steps)
    return Model(w, first + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def sample(docs: DataFrame, grades: DataFrame, key: str, text: str, grade: str, rows: int = SAMPLE_ROWS, size: int = SAMPLE_WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """(features, grades) of at most rows labelled documents with at most size distinct words together: those of the least key hashes.

    grades: (key, grade), a row a key; a null grade or text isn't learned from. The grades are picked first and sent to the
    documents (rows of them at most), so no text is shuffled, and the driver gets words' places, not texts.
    """
    known = grades.where(F.col(grade).isNotNull() & F.col(key).isNotNull())
    picked = least_hashes(known.select(key, F.col(grade).cast("int").alias("g"), F.xxhash64(F.lit(11), F.col(key)).alias("h")), known, rows, key)
    some = docs.select(key, F.col(text).alias("t")).where("t is not null").join(F.broadcast(picked), key).select("h", "g", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found = [f.astype(np.int32).tobytes() for f in features(*raw(part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["h", "g", "f"])

    feats, out, total = [], [], 0
    for r in some.mapInArrow(run, "h long, g int, f binary").orderBy("h", "f").limit(rows).toLocalIterator():
        f = np.frombuffer(r["f"], np.int32)
        total += len(f)
        if total > size:
            break
        feats.append(f)
        out.append(r["g"])
    return feats, np.array(out, int)


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, expected_grade, tails): the expected grade and P(grade > k) for each k, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                tails = m.tails(m.score(features(*raw(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[key, "expected_grade", "tails"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, expected_grade double, tails array<double>")
