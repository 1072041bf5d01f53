"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

N-grams of one to three characters of the lower-case text are hashed into a fixed number of features, weighted by
relative frequency times inverse document frequency. Document frequencies are counted over all labelled documents.
The weights are fitted by follow-the-regularised-leader with an elastic net on a bounded sample, and a temperature is
then fitted on a part of the sample kept aside. Prediction is one pass of Arrow batches over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.llm.common import slices

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: Most labelled rows that the weights are fitted on, over all languages together.
SAMPLE_ROWS = 2000
#: Part of the sample kept aside for the temperature.
ASIDE = 0.2
EPOCHS = 4
SCALE = 20.0
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

# Follow-the-regularised-leader: step size, smoothing, elastic net.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _codes(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Where texts begin, and for each order the feature and the validity of the n-gram at every position.

    Every text gets a space at both ends, so none is without positions.
    """
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    features, valid = [], []
    for n in ORDERS:
        mixed = np.full(len(points), np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        for k in range(n):
            ahead = np.zeros_like(points)
            ahead[: len(points) - k] = points[k:]
            mixed = (mixed ^ (ahead * _MULTIPLIERS[k])) * np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(15)
        ok = np.ones(len(points), bool)
        for k in range(1, n):
            ok[ends - k] = False
        features.append((mixed * np.uint32(0x9E3779B1)) >> shift)
        valid.append(ok)
    return ends - sizes, features, valid


def _totals(starts: np.ndarray, total: int) -> np.ndarray:
    """N-grams of each text."""
    sizes = np.diff(np.append(starts, total))
    return sum(np.maximum(sizes - n + 1, 0) for n in ORDERS)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter("lang IS NOT NULL AND text IS NOT NULL")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows, and the number of rows.

    Tasks send sums over their rows: at most ``FEATURES`` short rows each, added up on the map side again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for part in slices(batches, "text", SLICE_BYTES):
            starts, features, valid = _codes(part.column("text").to_pylist())
            ends = np.append(starts[1:], len(features[0]))
            n += len(starts)
            for a, b in zip(starts.tolist(), ends.tolist()):
                one = np.zeros(FEATURES, bool)
                for f, ok in zip(features, valid):
                    one[f[a:b][ok[a:b]]] = True
                seen += one
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], ["feature", "n"]
        )

    sums = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r["feature"]: r["n"] for r in sums.collect()}  # at most FEATURES + 1 rows
    n = found.pop(-1, 0)
    df = np.zeros(FEATURES, np.int64)
    df[list(found)] = list(found.values())
    return df, n


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` labelled rows, as many of each language, chosen by hash; never more than twice that many.

    With more than ``rows`` languages only the most frequent ``rows`` have a share and can be learned.
    """
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows)
    langs = counts.collect()  # at most one short row per sampled row
    each = rows / max(len(langs), 1)
    shares = [(r["lang"], min(1.0, each / r["count"])) for r in langs]
    table = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.join(F.broadcast(table), "lang").withColumn("chance", chance).filter("chance < share")
    return picked.select("lang", "text", "chance").limit(2 * rows)


def _vectors(rows: DataFrame) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
    """(language, chance, features, relative frequencies) of sampled rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            starts, features, valid = _codes(part.column("text").to_pylist())
            ends = np.append(starts[1:], len(features[0]))
            at, of = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                found = np.concatenate([f[a:b][ok[a:b]] for f, ok in zip(features, valid)])
                ids, n = np.unique(found, return_counts=True)
                at.append(ids.astype("<i4").tobytes())
                of.append((n / max(len(found), 1)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("chance"), pa.array(at, pa.binary()), pa.array(of, pa.binary())],
                ["lang", "chance", "at", "tf"],
            )

    out = rows.mapInArrow(extract, "lang string, chance double, at binary, tf binary").collect()
    found = [(r["lang"], r["chance"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["tf"], "<f8")) for r in out]
    return sorted(found, key=lambda r: (r[1], r[0], len(r[2])))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages, inverse document frequencies and scale included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        starts, features, valid = _codes(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for f, ok in zip(features, valid):
            each = self.weights[f]
            each[~ok] = 0
            total += np.add.reduceat(each, starts, axis=0, dtype=np.float64)
        return total / np.maximum(_totals(starts, len(features[0])), 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


class _Leader:
    """Per-coordinate follow-the-regularised-leader with an elastic net; weights are made when asked for."""

    def __init__(self, rows: int, columns: int, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((rows, columns)), np.zeros((rows, columns))
        self.l1, self.l2 = l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + self.l2)

    def learn(self, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        n = self.n[at]
        after = n + gradient**2
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = after


def fit(rows: DataFrame) -> LanguageModel | None:
    """A model from labelled rows (``doc_id, text, lang``); None if there are none."""
    rows = labelled(rows)
    df, n = document_frequencies(rows)
    vectors = _vectors(sample(rows)) if n else []
    if not vectors:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted({v[0] for v in vectors})
    place = {lang: k for k, lang in enumerate(languages)}
    aside = vectors[:: int(1 / ASIDE)] if len(vectors) >= 10 * len(languages) else []
    learned = [v for k, v in enumerate(vectors) if not aside or k % int(1 / ASIDE)]
    order = np.random.default_rng(7)
    leader, bias = _Leader(FEATURES, len(languages)), _Leader(1, len(languages), 0.0, 0.0)
    for _ in range(EPOCHS):
        for k in order.permutation(len(learned)):
            lang, _, at, tf = learned[k]
            x = SCALE * tf * idf[at]
            w, b = leader.weights(at), bias.weights()
            wrong = _softmax(x @ w + b[0])
            wrong[place[lang]] -= 1
            leader.learn(at, np.outer(x, wrong), w)
            bias.learn(slice(None), wrong[None, :], b)
    weights, b = leader.weights(), bias.weights()[0]
    model = LanguageModel(languages, (weights * SCALE * idf[:, None]).astype(np.float32), b)
    if aside:
        logits = np.array([(SCALE * tf * idf[at]) @ weights[at] + b for _, _, at, tf in aside])
        truth = np.array([place[v[0]] for v in aside])

        def loss(t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean()

        model.temperature = float(min(np.geomspace(0.05, 5, 200), key=loss))
    return model


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``lang_pred`` and ``score`` of every row.

    The prediction reads the text alone. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if there is no model. Ties go to the language that sorts first. Equal rows are predicted one by one,
    null ids stay null, other columns are not read, and an empty table gives an empty result.
    """
    keep = keep or {}
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *[c.alias(name) for name, c in keep.items()],
        F.when(text.rlike(r"\p{L}"), text).alias("text"),
    )
    names = ["doc_id", *keep]

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").to_pylist()
            with_letters = [k for k, t in enumerate(texts) if t is not None]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model and with_letters:
                p = model.probabilities([texts[k] for k in with_letters])
                for k, best, score in zip(with_letters, p.argmax(axis=1), p.max(axis=1).tolist()):
                    langs[k], scores[k] = model.languages[best], score
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(guess, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; null ids are learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
