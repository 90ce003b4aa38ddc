"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Every word has a sparse random index vector from its hash; its word vector is the sum of the index vectors around
it in the training texts. A word's shape (letters, digits and marks in short) is a word of a second stream. A document
is the mean vector of each stream. The network and the vectors are small and go to all tasks.
"""

from __future__ import annotations

import itertools
import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import texts_of, trained
from heatloom.llm.pretokens import Bounded

#: The sample that the model is fitted on: labelled rows, and characters of their texts, at most; and the words of that sample that get a vector, at most.
FIT_ROWS, FIT_CHARS, FIT_WORDS = 6_000, 60_000_000, 30_000
DIM, PARTS, WINDOW = 96, 6, 2
AGAIN = "=again"
SHAPE_OF = {c: "x" for c in map(chr, range(0x250)) if c.islower()} | {c: "X" for c in map(chr, range(0x250)) if c.isupper()} | {c: "9" for c in "0123456789"}


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, other characters as they are; each run of the whole word in short."""
    return "".join(c for c, _ in itertools.groupby(SHAPE_OF.get(c) or ("x" if c.isalpha() else c) for c in word))


def streams(text: str) -> tuple[list[str], list[str]]:
    """A text's words in lower case; their shapes, with a mark after each word that repeats the one before."""
    words = text.split()
    shapes: list[str] = []
    short = Bounded(shape)
    for before, word in zip(["", *words], words):
        shapes += [short[word], AGAIN] if word == before else [short[word]]
    return [w.lower() for w in words], shapes


def index_parts(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a word's index vector."""
    draws = np.array([xxhash.xxh32_intdigest(word.encode(), k) for k in range(PARTS)])
    return draws % DIM, np.where(draws >> 16 & 1, 1.0, -1.0)


def word_vectors(texts: list[list[str]], least: int) -> dict[str, np.ndarray]:
    """Unit context vectors of the most frequent words that occur `least` times."""
    counts = Counter(w for t in texts for w in t)
    kept = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FIT_WORDS] if n >= least]
    if not kept:
        return {}
    number = {w: i for i, w in enumerate(kept)}
    places, signs = (np.array(x) for x in zip(*map(index_parts, kept), strict=True))
    total = np.zeros(len(kept) * DIM)
    for k in range(0, len(texts), 3000):
        ids = np.concatenate([np.array([number.get(w, -1) for w in t] + [-1] * WINDOW, np.int64) for t in texts[k : k + 3000]])
        for off in range(1, WINDOW + 1):
            a, b = ids[:-off], ids[off:]
            both = (a >= 0) & (b >= 0)
            for x, y in ((a[both], b[both]), (b[both], a[both])):
                for p in range(PARTS):
                    total += np.bincount(x * DIM + places[y, p], weights=signs[y, p], minlength=len(total))
    vectors = total.reshape(-1, DIM)
    np.add.at(vectors, (np.arange(len(kept))[:, None], places), signs)  # a word's own index, so that words without known neighbours differ
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return dict(zip(kept, vectors.astype(np.float32), strict=True))


@dataclass
class QualityModel:
    words: tuple[list[str], np.ndarray]
    shapes: tuple[list[str], np.ndarray]
    layers: list[np.ndarray]
    scale: tuple[np.ndarray, np.ndarray]
    temperature: float
    constant: float | None = None

    def __post_init__(self):
        number = [{w: i for i, w in enumerate(names)} for names, _ in (self.words, self.shapes)]
        self.again = number[1].get(AGAIN, -1)
        self.numbers = Bounded(lambda w: (number[0].get(w.lower(), -1), number[1].get(shape(w), -1)))

    def __reduce__(self):
        return QualityModel, (self.words, self.shapes, self.layers, self.scale, self.temperature, self.constant)

    def features(self, text: str) -> np.ndarray:
        """Mean word vector and mean shape vector of the whole text."""
        words = text.split()
        counts = Counter(words)
        repeats = sum(map(operator.eq, words, words[1:]))
        found = np.array([*map(self.numbers.__getitem__, counts), (-1, self.again)])
        n = np.array([*counts.values(), repeats], np.float32)
        out = []
        for k, (_, vectors) in enumerate((self.words, self.shapes)):
            known = found[:, k] >= 0
            out.append((n[known] @ vectors[found[known, k]]) / max(1, len(words) + k * repeats))
        return np.concatenate(out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.scale[0]) / self.scale[1] @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        z = self.logits(np.array([self.features(t) for t in texts], np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> list[np.ndarray]:
    """Weights of a two-layer network: logistic loss, whole batches, Adam; both classes weigh alike in part."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    share = y.mean()
    weight = np.where(y == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(x @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40)))
        d = weight * (p - y) / len(y)
        dh = np.outer(d, w2) * (1 - h * h)
        for i, g in enumerate((x.T @ dh + decay * w1, dh.sum(0), h.T @ d + decay * w2, np.array([d.sum()]))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """A model from labelled texts; every fifth only sets the temperature. One class or none: its share as a constant."""
    y = np.array(labels, np.float64)
    nothing = ([], np.zeros((0, DIM), np.float32))
    if len(set(labels)) < 2 or min(np.bincount(y.astype(int))) < 5:
        return QualityModel(nothing, nothing, [], (np.zeros(1), np.ones(1)), 1.0, float(y.mean()) if len(y) else 0.5)
    parts = [streams(t) for t in texts]
    tables = []
    for k, least in ((0, 5), (1, 2)):
        found = word_vectors([p[k] for p in parts], least)
        tables.append((list(found), np.array(list(found.values()), np.float32).reshape(-1, DIM)))
    model = QualityModel(*tables, [], (np.zeros(1), np.ones(1)), 1.0)
    x = np.array([model.features(t) for t in texts], np.float64)
    held = np.arange(len(y)) % 5 == 4
    model.scale = (x.mean(0), x.std(0) + 1e-3)
    model.layers = train((x[~held] - model.scale[0]) / model.scale[1], y[~held])
    z = model.logits(x[held])

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, -z / t) * y[held] + np.logaddexp(0, z / t) * (1 - y[held])))

    model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> QualityModel:
    """A model from a bounded sample: at most `rows` labelled ids that aren't held out, by hash; an id whose texts don't fit in what is left of `chars` characters is passed over.

    A repeated id in labels counts with its mean label; rows with a null id or label are left out.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    # Lengths first, so that the one task that fits never holds more than `chars` characters.
    sizes = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.length("text").alias("size"))  # chosen: at most `rows` rows of two numbers
    sizes = sizes.groupBy("doc_id", "quality").agg(F.sum("size").alias("size"))
    held, left = [], chars
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most `rows` rows of three numbers
        if r["size"] <= left:
            held.append((r.doc_id, r.quality, len(held)))
            left -= r["size"]
    held = docs.sparkSession.createDataFrame(held, "doc_id bigint, quality int, at int")
    sample = texts.join(F.broadcast(held), "doc_id").select("at", "text", "quality").repartition(1)

    def learn(found) -> QualityModel:
        ordered = sorted(found, key=lambda r: (r["at"], r["text"]))
        return fit([r["text"] for r in ordered], [r["quality"] for r in ordered])

    return trained(sample, learn)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels has doc_id, quality.

    The score is the calibrated probability of label 1, from the whole text alone. A null text is the empty text, and gets the
    score of a document without known words. A row with a null or repeated doc_id is scored like others; a null id isn't held out.
    Without labels of both classes the score is the share of label 1, or 0.5. Other columns are ignored, so their names cannot clash. An
    empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            for k in range(0, len(texts), 1000):
                score = model.value.scores(texts[k : k + 1000])
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`. Else as quality_scores."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield part.filter(pa.array(model.value.scores(texts_of(part)) >= least))

    return docs.mapInArrow(run, docs.schema)
