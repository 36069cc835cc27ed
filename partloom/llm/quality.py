"""Quality classifier: random-indexing word vectors pooled for each document, then a two-layer network.

Each token slot has a sparse random index vector; a token's vector is its index vector plus the normalized sum of its
neighbours' index vectors over the labelled sample (random indexing). A document is the mean of its tokens' vectors and
a few pooled figures. Tokens are letter runs, other runs, and the shape of each letter run. A network with one hidden
layer is trained in numpy and its probabilities are calibrated by one temperature on rows kept out of the training.

The fit takes at most max_train labelled rows (chosen by a hash of the id, whole texts). Their contexts are summed and
their documents pooled on the executors; the driver holds the vectors' table, of a fixed size, and a row of figures for
each labelled document. Scoring runs over all documents in partitions, with no shuffle.

Nulls: a null text counts as empty and gets the network's score for a document without tokens; null labels and labels
without a document are not used; of repeated labels of an id the larger counts. Without two classes to learn from,
every score is the (smoothed) share of label 1. Repeated rows are each scored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, received, share, small_batches, stash

SLOTS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 16, 48, 4, 2, 32
CHUNK, BLOCK = 1 << 12, 1 << 13  # slots in a row of sums; words whose contexts are summed at once
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int | None) -> DataFrame:
    """(doc_id, y, text, lang) of at most limit labelled ids (None: of all) for which learn holds, stored. Ids are chosen before any text is read.

    An id whose document occurs more than once gives one row, that with the least text.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    if limit is not None:
        ids = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(ids, "doc_id")
    return stash(rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("least")).select("doc_id", "y", "least.text", "least.lang"))


def _shape(token: str) -> str:
    if token.isalpha():
        return "\x01lower" if token.islower() else "\x01upper" if token.isupper() and len(token) > 1 else "\x01title"
    return "\x01digits" if token.isdigit() else "\x01mark"


class Slots(dict):
    """token -> (its slot, its shape's slot)."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 100_000:
            self.clear()
        found = self[token] = (zlib.crc32(token.encode("utf-8", "surrogatepass")) % SLOTS, zlib.crc32(_shape(token).encode()) % SLOTS)
        return found

    def of(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, _TOKEN.findall(text))), np.int64).reshape(-1, 2)


def index_vectors(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, DIM), np.float32)
    np.put_along_axis(out, rng.integers(0, DIM, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO)).astype(np.float32), 1)
    return out


def context_sums(words: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to out, by slot, the index vectors of the WINDOW words on each side of every word of one document."""
    for at in range(0, len(words), BLOCK):
        own = words[at : at + BLOCK]
        near = np.zeros((len(own), DIM), np.int32)
        for k in range(-WINDOW, WINDOW + 1):
            low, high = max(0, at + k), min(len(words), at + len(own) + k)
            if k and low < high:
                near[low - at - k : high - at - k] += index[words[low:high]]
        np.add.at(out, own, near)


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Index vectors plus normalized context vectors of the tokens in rows (text).

    Contexts are summed where the texts are, in SLOTS x DIM whole numbers a task; SLOTS / CHUNK rows of sums reach the driver.
    """
    whole = index_vectors()

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, index, sums = Slots(), index_vectors().astype(np.int32), np.zeros((SLOTS, DIM), np.int32)
        for frame in frames:
            for text in frame["text"]:
                context_sums(slots.of(text)[:, 0], index, sums)
        for k in range(0, SLOTS, CHUNK):
            if sums[k : k + CHUNK].any():
                yield pd.DataFrame({"chunk": [k // CHUNK], "sums": [sums[k : k + CHUNK].astype("<i8").tobytes()]})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, raw in zip(frame["chunk"], frame["sums"]):
                part = np.frombuffer(raw, "<i8")
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, values in sums.items():
            values = values.reshape(-1, DIM)
            norm = np.linalg.norm(values, axis=1, keepdims=True)
            yield pd.DataFrame({"chunk": [chunk], "sums": [(2 * values / np.maximum(norm, 1e-9)).astype("<f4").tobytes()]})

    parts = rows.select("text").mapInPandas(add, "chunk int, sums binary").repartition("chunk").mapInPandas(total, "chunk int, sums binary")
    for r in parts.toLocalIterator():  # SLOTS / CHUNK rows
        whole[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.sums, "<f4").reshape(-1, DIM)
    return whole


def pooled(documents: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(documents), 2 * DIM + 4))
    for i, d in enumerate(documents):
        if len(d):
            (words, n), (shapes, m) = np.unique(d[:, 0], return_counts=True), np.unique(d[:, 1], return_counts=True)
            out[i, :DIM] = n @ vectors[words] / len(d)
            out[i, DIM : 2 * DIM] = m @ vectors[shapes] / len(d)
            out[i, 2 * DIM :] = np.log1p(len(d)), len(words) / len(d), n.max() / len(d), np.linalg.norm(out[i, :DIM])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Inputs, HIDDEN tanh units, one logit; Adam on the log loss with weight decay."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        own = rng.permutation(len(y))
        check, own = own[: len(y) // 5], own[len(y) // 5 :]
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [0 * w for w in self.w], [0 * w for w in self.w], 0
        for _ in range(epochs):
            rng.shuffle(own)
            for at in range(0, len(own), 128):
                i = own[at : at + 128]
                h = np.tanh(z[i] @ self.w[0] + self.w[1])
                g = (sigmoid(h @ self.w[2] + self.w[3]) - y[i]) / len(i)
                back = np.outer(g, self.w[2]) * (1 - h * h)
                grads = [z[i].T @ back + decay * self.w[0], back.sum(0), h.T @ g + decay * self.w[2], g.sum(keepdims=True)]
                step += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(check):
            logit = self.logit(x[check])
            loss = lambda t: np.logaddexp(0, np.where(y[check] > 0, -logit, logit) / t).mean()
            self.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def fit(rows: DataFrame):
    """(word vectors, network) from labelled rows, or the share of label 1 where there is one class only.

    Vectors are summed and documents pooled on the executors; the driver gets 2 * DIM + 4 figures a labelled row.
    """
    ones, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < ones < n:
        return float((ones + 0.5) / (n + 1))
    vectors = word_vectors(rows)
    shared = share(rows.sparkSession, vectors)

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, own = Slots(), received(shared)
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [x.tobytes() for x in pooled([slots.of(t) for t in part["text"]], own)]})

    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text").mapInPandas(pool, "doc_id string, y int, x binary").toPandas().sort_values("doc_id")
    return vectors, Network(np.stack([np.frombuffer(x) for x in found["x"]]), found["y"].to_numpy(np.float64))


def quality_score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_train: int = 5000) -> Column:
    """A column over `text`, from a model fitted on labelled rows outside the held-out fold. Only the text goes to Python."""
    small_batches(docs.sparkSession)
    learn = id_remainder(F.col("doc_id"), folds) != held
    model = share(docs.sparkSession, fit(labelled_rows(docs, labels, "quality", learn, max_train)))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots, fitted = Slots(), received(model)
        for texts in batches:
            values = np.full(len(texts), fitted if isinstance(fitted, float) else np.nan)
            if not isinstance(fitted, float):
                vectors, network = fitted
                for at in range(0, len(texts), 500):
                    values[at : at + 500] = network(pooled([slots.of(t or "") for t in texts.iloc[at : at + 500]], vectors))
            yield pd.Series(values)

    return F.pandas_udf(score, "double")(F.coalesce("text", F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_train: int = 5000, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    score = quality_score(docs, labels, folds, held, max_train)
    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **options) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns."""
    return docs.filter(quality_score(docs, labels, **options) >= cut)
