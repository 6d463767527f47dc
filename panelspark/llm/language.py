"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, characters that are not letters become single spaces, and
n-grams of 1 to 3 characters are hashed into a fixed number of bins. Weights are
trained with follow-the-regularised-leader (proximal, per-coordinate rates, elastic
net), so most of them stay zero; a temperature fitted on rows kept from the training
turns scores into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import checkpoint

BINS = 1 << 15
ORDERS = (1, 2, 3)
#: Expected training documents per language, a bound on the fit whatever the corpus; statistics cover all documents.
PER_LANGUAGE = 1500
#: Characters of the longest piece processed at once (longer texts are summed piece by piece).
PIECE = 1 << 20
UNKNOWN = "und"

_SPACES = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _SPACES
    if _SPACES is None:
        _SPACES = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _SPACES


def ngram_counts(text: str, bins: int) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    points = np.where(letter, points, 32)[keep]
    counts = np.zeros(bins, dtype=np.int64)
    for at in range(0, len(points), PIECE):
        piece = points[at : at + PIECE + max(ORDERS) - 1].astype(np.uint64)
        hashed, width = np.zeros(len(piece), dtype=np.uint64), len(piece)
        for n in ORDERS:
            width = len(piece) - n + 1
            if width <= 0:
                break
            hashed = hashed[:width] * np.uint64(0x9E3779B97F4A7C15) + (piece[n - 1 :] + np.uint64(n))
            own = hashed[: min(width, PIECE)]
            mixed = (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((mixed >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64), minlength=bins)
    return counts


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(bins, weights) of the unit-length TF-IDF vector of a text."""
    counts = ngram_counts(text or "", len(idf))
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    weight = np.log1p(counts[at]) * idf[at]
    return at, weight / max(np.sqrt((weight * weight).sum()), 1e-12)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text, self.idf)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((found[1] @ self.weights[found[0]] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, bins: int, *, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal: z and n per coordinate, w = -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2)."""
    z, n = np.zeros((bins + 1, classes)), np.zeros((bins + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], bins), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    final = weights(np.arange(bins + 1))
    return final[:-1], final[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))
        return -float(np.log(p[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.2), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame, bins: int = BINS) -> tuple[np.ndarray, int]:
    """How many of all texts have each bin, and how many have any; one count per bin and task reaches the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text or "", bins)
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    out = np.zeros(bins + 1, dtype=np.int64)
    for row in texts.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bin] = row.n  # one number per bin
    return out[:-1], int(out[-1])


def fit(labelled: DataFrame, key: Column, *, per_language: int = PER_LANGUAGE, bins: int = BINS) -> Model:
    """Learn from (text, lang) rows; null languages and texts without letters teach nothing.

    Document frequencies cover every labelled row. The classifier is fitted on about
    `per_language` rows of each language, drawn by the hash of `key`, on whole texts; a
    fifth of these rows only calibrates the temperature. No rows at all give a model that
    answers `und`.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, total = document_frequencies(rows.select("text"), bins)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    draw = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.lit(float(per_language)) / F.col("n"))
    shares = {r.lang: r.share for r in share.collect()}  # one row per language
    languages = sorted(shares)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v)]), F.col("lang")) if shares else F.lit(0.0)
    sample = rows.where(draw < limit).select("text", "lang", (F.pmod(F.xxhash64(key, F.lit(12)), F.lit(5)) == 0).alias("calibrate"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(features(t, idf), l, c) for t, l, c in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            found = [x for x in found if x[0] is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0][0] for x in found], pa.list_(pa.int32())), pa.array([x[0][1] for x in found], pa.list_(pa.float32())), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.bool_())],
                ["at", "x", "lang", "calibrate"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [r for b in batches for r in zip(*(b.column(k) for k in range(4)))]
        xs = [(np.array(r[0].values), np.array(r[1].values, dtype=np.float64)) for r in table]
        ys, late = np.array([languages.index(r[2].as_py()) for r in table], dtype=np.int64), np.array([r[3].as_py() for r in table], dtype=bool)
        early = [i for i in range(len(xs)) if not late[i]]
        w, b = train([xs[i] for i in early], ys[early], len(languages), bins)
        held = [i for i in range(len(xs)) if late[i]]
        scores = np.array([xs[i][1] @ w[xs[i][0]] + b for i in held]).reshape(-1, len(languages))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([b.tobytes()]), pa.array([temperature(scores, ys[held])])], ["w", "b", "t"])

    if not languages:
        return Model([], np.zeros((bins, 0)), np.zeros(0), idf, 1.0)
    # The bounded sample meets in one task in a fixed order, so that reruns agree.
    ready = checkpoint(sample.mapInArrow(vectors, "at array<int>, x array<float>, lang string, calibrate boolean"))
    found = ready.coalesce(1).sortWithinPartitions(F.xxhash64("at", "x")).mapInArrow(learn, "w binary, b binary, t double").first()
    if found is None:
        return Model([], np.zeros((bins, 0)), np.zeros(0), idf, 1.0)
    weights = np.frombuffer(bytes(found.w), dtype=np.float32).reshape(bins, len(languages)).astype(np.float64)
    return Model(languages, weights, np.frombuffer(bytes(found.b), dtype=np.float64), idf, found.t)


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `keep` of every document with the predicted language and its probability (0 to 1), named by `names`.

    Only the text is read: a null text or one without any letter is `und` with score 0.
    Ties between languages go to the first in code-point order. Repeated rows and
    nulls in other columns are passed on; `keep` must not contain `names`.
    """
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = slim.drop("__text").schema
    box = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [box.value.predict(t) for t in batch.column("__text").to_pylist()]
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, *names])

    out = schema.add(names[0], "string").add(names[1], "double")
    return slim.mapInArrow(run, out)


def held_out() -> Column:
    """Every fifth document by the checksum of its id never teaches (nor does one without an id)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learned_from(docs: DataFrame) -> Model:
    """The model of a table of documents, from its rows that are not held out."""
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), F.col("doc_id"))
