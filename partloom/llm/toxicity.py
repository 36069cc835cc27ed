"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters, lower case) embeds as the sum of the hashed rows of the word and of its prefixes of 4 to 6 letters.
Filters of widths 1, 2 and 3 slide over the words, each is pooled by its maximum, and a logistic layer follows. Since a
filter's value is a sum of products of one word each, words are multiplied once and looked up afterwards. Embeddings
start from how far a row's share of toxic documents exceeds what chance allows, then everything is trained by Adam.

All labelled rows outside the held-out fold are used. They are dealt by a hash of the id to shards of about SHARD rows, whose words
are numbered once; in each of ROUNDS rounds every shard trains EPOCHS passes on from the shared parameters, and these and Adam's
moments are then averaged in chunks on the executors (local SGD). One shard is plain Adam. The driver holds one model, of a fixed size.

A temperature and thresholds for each language are calibrated on the quarter of the rows that is kept out of the training, by sums
over grids; language decides the `flagged` column only and is no input of the score. Scoring runs over all documents in partitions,
with no shuffle.

Nulls: a null text counts as empty and gets the score of a document without words; null labels, and labels without a
document, are not used; of repeated labels the larger counts; a null or unseen language takes the general threshold.
Without two classes every score is the smoothed share of label 1. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, id_remainder, received, share, stash
from .quality import labelled_rows, sigmoid

ROWS, DIM, WIDTHS, FILTERS, PARTS = 1 << 16, 8, (1, 2, 3), 8, (4, 5, 6)
ROUNDS, EPOCHS = 3, 2  # six passes over every shard
SHARD, TEXT, CHUNK = 10_000, 32 << 20, 1 << 16  # rows and characters of a shard, about; figures in a row of sums
VALUES = ("e", "w", "b", "out")
COLUMNS = sum(WIDTHS) * FILTERS
_FILTER = np.concatenate([np.tile(np.arange(n * FILTERS, (n + 1) * FILTERS), width) for n, width in enumerate(WIDTHS)])  # the filter of each column
PAD = max(WIDTHS)  # padding words after each document, so that no window reaches into the next
_WORD = re.compile(r"[^\W\d_]+")


_WHOLE, _PREFIX = zlib.crc32(b"="), zlib.crc32(b"^")


def rows_of(word: str) -> list[int]:
    """Rows of a word and its prefixes; a prefix that isn't shorter than the word repeats the last row."""
    raw = word.encode("utf-8", "surrogatepass")
    if len(raw) == len(word):  # a character a byte, so that each prefix goes on from the one before
        first = zlib.crc32(raw[: PARTS[0]], _PREFIX)
        second = zlib.crc32(raw[PARTS[0] : PARTS[1]], first)
        return [zlib.crc32(raw, _WHOLE) % ROWS, first % ROWS, second % ROWS, zlib.crc32(raw[PARTS[1] : PARTS[2]], second) % ROWS]
    return [zlib.crc32(raw, _WHOLE) % ROWS, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), _PREFIX) % ROWS for n in PARTS)]


class Convolution:
    def __init__(self, with_row: np.ndarray, toxic: np.ndarray, share_toxic: float, seed: int = 5):
        """with_row, toxic: for each row the training documents, and the toxic ones, that have it."""
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (ROWS, DIM))
        expected = with_row * share_toxic
        self.e[:, 0] = np.clip((toxic - expected) / np.sqrt(expected + 1), -1, 6) / 4  # surplus of toxic documents, in standard errors, bounded
        self.w = rng.normal(0, 0.3, (DIM, COLUMNS))
        self.w[0] = np.abs(self.w[0]) + 0.3
        self.b, self.out, self.bias = np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, len(WIDTHS) * FILTERS) + 0.2, -2.0
        self.m, self.v, self.step = {k: 0 * getattr(self, k) for k in VALUES}, {k: 0 * getattr(self, k) for k in VALUES}, 0.0
        self.temperature = 1.0

    def flat(self) -> np.ndarray:
        """Parameters, moments and the number of steps as one vector."""
        return np.concatenate([[self.bias, self.step], *(x[k].ravel() for x in (vars(self), self.m, self.v) for k in VALUES)])

    def put(self, flat: np.ndarray) -> None:
        self.bias, self.step, at = float(flat[0]), float(flat[1]), 2
        for x in (vars(self), self.m, self.v):
            for k in VALUES:
                x[k] = flat[at : at + x[k].size].reshape(x[k].shape)
                at += x[k].size

    def train(self, docs: list[np.ndarray], words: np.ndarray, y: np.ndarray, rng: np.random.Generator, rate: float = 0.01) -> None:
        """EPOCHS passes over docs (numbers of words; words: the rows of each)."""
        own = np.arange(len(y))
        present, number = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        for _ in range(EPOCHS):
            rng.shuffle(own)
            for at in range(0, len(own), 200):
                i = own[at : at + 200]
                flow = np.concatenate([docs[k] for k in i])
                present[flow] = True
                used = np.flatnonzero(present)
                number[used], present[used] = np.arange(len(used)), False
                vectors = np.vstack([self.e[words[used]].sum(1), np.zeros((1, DIM))])  # the last is the padding word
                pools, hits = self.pool(vectors @ self.w, number[flow], np.array([len(docs[k]) for k in i]))
                act = np.maximum(pools + self.b, 0)
                g = (sigmoid(act @ self.out + self.bias) - y[i]) / len(i)
                back = np.outer(g, self.out) * (act > 0)
                d = back[:, _FILTER]  # of each document, by column
                hit, at_hit = np.unique(hits, return_inverse=True)
                onto = d[:, :, None] * self.w.T
                dv = np.stack([np.bincount(at_hit.ravel(), onto[:, :, x].ravel(), len(hit)) for x in range(DIM)], 1)
                dv, hit = dv[hit < len(used)], hit[hit < len(used)]
                to = words[used[hit]]
                spread = np.repeat(dv, to.shape[1], axis=0)
                grad = {"out": act.T @ g, "b": back.sum(0), "w": (vectors[hits] * d[:, :, None]).sum(0).T}
                grad["e"] = np.stack([np.bincount(to.ravel(), spread[:, x], ROWS) for x in range(DIM)], 1)
                self.step += 1
                self.bias -= rate * 10 * g.sum()
                for k in VALUES:
                    m, v = self.m[k], self.v[k]
                    m *= 0.9
                    m += 0.1 * grad[k]
                    v *= 0.99
                    v += 0.01 * np.square(grad[k])
                    down = np.sqrt(v / (1 - 0.99**self.step))
                    down += 1e-6
                    np.divide(m, down, out=down)
                    down *= rate / (1 - 0.9**self.step)
                    setattr(self, k, getattr(self, k) - down)

    @staticmethod
    def pool(table: np.ndarray, ids: np.ndarray, size: np.ndarray):
        """Maxima of every filter over the documents' windows, and the word under each column there; table's last row is the padding word."""
        tables = np.ascontiguousarray(table.astype(np.float32).reshape(len(table), -1, FILTERS).swapaxes(0, 1))
        at = np.cumsum(size) - size + PAD * np.arange(len(size))
        padded = np.full(len(ids) + PAD * len(size) + PAD, len(table) - 1)
        padded[np.arange(len(ids)) + PAD * np.repeat(np.arange(len(size)), size)] = ids
        pools = np.empty((len(size), len(WIDTHS) * FILTERS))
        hits = np.empty((len(size), COLUMNS), np.int64)
        place, n = 0, len(padded) - PAD
        spans = np.stack([at, at + np.maximum(size, 1)], 1).ravel()  # windows that start at a word
        of = np.repeat(np.arange(len(size)), size + PAD)
        where = np.empty((len(size), FILTERS), np.int64)
        for k, width in enumerate(WIDTHS):
            z = tables[place].take(padded[:n], 0)
            for j in range(1, width):
                z += tables[place + j].take(padded[j : j + n], 0)
            top = np.maximum.reduceat(z, spans, axis=0)[::2]
            pools[:, k * FILTERS : (k + 1) * FILTERS] = top
            first, f = np.nonzero(z == top.take(of, 0))
            where[of[first][::-1], f[::-1]] = first[::-1]
            for j in range(width):
                hits[:, (place + j) * FILTERS : (place + j + 1) * FILTERS] = padded[where + j]
            place += width
        return pools, hits


class Memo(dict):
    """word -> its products with all filters; lives as long as a partition's task."""

    def __init__(self, model: Convolution):
        super().__init__()
        self.e, self.w = model.e.astype(np.float32), model.w.astype(np.float32)
        self.new: list[str] = []
        self.model, self.table = model, np.zeros((COLUMNS // FILTERS, 1 << 12, FILTERS), np.float32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def fill(self) -> None:
        """Computes the products of the words that were met since the last time."""
        low, high = len(self) - len(self.new), len(self)
        while high > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        if self.new:
            rows = np.array([rows_of(w) for w in self.new])
            self.table[:, low:high] = (self.e[rows].sum(1) @ self.w).reshape(high - low, -1, FILTERS).swapaxes(0, 1)
            self.new = []

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        ids = [np.array(list(map(self.__getitem__, _WORD.findall(t.lower()))), np.int64) for t in texts]
        pad = self[""]
        self.fill()
        self.table[:, pad] = 0
        z, n = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(x) + PAD for x in ids])
        flow = np.full(n.sum() + PAD, pad)
        flow[np.arange(len(z)) + PAD * np.repeat(np.arange(len(ids)), n - PAD)] = z
        at, length = np.concatenate([[0], np.cumsum(n)[:-1]]), n.sum()
        pools, place = [], 0
        spans = np.stack([at, at + np.maximum(n - PAD, 1)], 1).ravel()
        for width in WIDTHS:
            value = self.table[place].take(flow[:length], 0)
            for j in range(1, width):
                value += self.table[place + j].take(flow[j : j + length], 0)
            pools.append(np.maximum.reduceat(value, spans, axis=0)[::2])
            place += width
        return np.maximum(np.concatenate(pools, 1) + self.model.b, 0) @ self.model.out + self.model.bias


def _numbered(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's texts in one row: the numbers of their words one after another, each text's size, the rows of each word, labels."""
    frame = frame.sort_values("doc_id")
    vocabulary: dict[str, int] = {}
    docs = [[vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.lower())] for t in frame["text"]]
    words = np.array([rows_of(w) for w in vocabulary], np.int32).reshape(-1, 1 + len(PARTS))
    ids = np.concatenate([np.array(d, np.int32) for d in docs])
    raw = (ids, np.array([len(d) for d in docs], np.int32), words, frame["y"].to_numpy(np.int8))
    return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), **{n: [x.tobytes()] for n, x in zip(("ids", "sizes", "words", "y"), raw)}})


def _shard(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    ids, sizes = np.frombuffer(row["ids"], np.int32).astype(np.int64), np.frombuffer(row["sizes"], np.int32)
    words = np.frombuffer(row["words"], np.int32).reshape(-1, 1 + len(PARTS)).astype(np.int64)
    return np.split(ids, np.cumsum(sizes)[:-1]), words, np.frombuffer(row["y"], np.int8).astype(np.float64)


def _chunks(flat: np.ndarray) -> pd.DataFrame:
    parts = [flat[at : at + CHUNK] for at in range(0, len(flat), CHUNK)]
    return pd.DataFrame({"chunk": range(len(parts)), "part": [p.astype("<f8").tobytes() for p in parts]})


def _total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for chunk, raw in zip(frame["chunk"], frame["part"]):
            part = np.frombuffer(raw, "<f8")
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    yield pd.DataFrame({"chunk": list(sums), "part": [x.tobytes() for x in sums.values()]})


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors that come in chunks; size / CHUNK rows reach the driver."""
    out = np.zeros(size)
    for r in parts.repartition("chunk").mapInPandas(_total, "chunk int, part binary").toLocalIterator():
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(r.part) // 8] = np.frombuffer(r.part, "<f8")
    return out


def fit(rows: DataFrame):
    """The network from labelled rows (doc_id, y, text, held), or the share of label 1 where there is one class only, or under 8 rows."""
    spark = rows.sparkSession
    ones, n, size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    own = rows.filter("not held")
    learnt, toxic = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n or n < 8 or not learnt:
        return float((ones + 0.5) / (n + 1))
    shards = max(1, -(-learnt // SHARD), -(-size // TEXT))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("string").alias("doc_id"), "text", "y")
    kept = stash(dealt.groupBy("shard").applyInPandas(_numbered, "shard int, ids binary, sizes binary, words binary, y binary"))

    def surplus(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                docs, words, y = _shard(row)
                counts = np.zeros((2, ROWS))
                for d, t in zip(docs, y):
                    have = np.unique(words[d])
                    counts[0, have] += 1
                    counts[1, have] += t
                yield _chunks(counts.ravel())

    counts = _summed(kept.mapInPandas(surplus, "chunk int, part binary"), 2 * ROWS).reshape(2, ROWS)
    model = Convolution(*counts, toxic / learnt)
    for turn in range(ROUNDS):
        shared = share(spark, model)

        def train(frames: Iterator[pd.DataFrame], turn=turn, shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for _, row in frame.iterrows():
                    own, (docs, words, y) = received(shared), _shard(row)
                    own.train(docs, words, y, np.random.default_rng([turn, row["shard"]]))
                    yield _chunks(own.flat() * (len(y) / learnt))

        model.put(_summed(kept.mapInPandas(train, "chunk int, part binary"), len(model.flat())))
        shared.destroy()
    drop_stash(kept)
    model.m = model.v = None
    return model


def calibrated(rows: DataFrame, model: Convolution, general: float) -> dict[str, float]:
    """Sets the model's temperature by rows (text, lang, y), and gives for each language the cut of best F1; languages with under 10 toxic rows take the general cut."""
    shared = share(rows.sparkSession, model)

    def logits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(received(shared))
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                yield pd.DataFrame({"lang": part["lang"], "y": part["y"], "logit": memo.logits(part["text"].tolist()).astype(float)})

    scored = stash(rows.select("lang", "y", "text").mapInPandas(logits, "lang string, y int, logit double"))
    grid, cuts = np.geomspace(0.3, 10, 60).tolist(), np.linspace(0.1, 0.9, 33).tolist()
    x = F.when(F.col("y") > 0, -F.col("logit")).otherwise(F.col("logit"))
    loss = scored.agg(*(F.avg(F.greatest(x / t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x / t)))) for t in grid)).first()
    if loss[0] is None:  # no rows were kept out
        return {}
    model.temperature = min(zip(loss, grid))[1]
    s = F.lit(0.5) * (1 + F.tanh(F.col("logit") * (0.5 / model.temperature)))
    counts = scored.filter("lang <> ''").groupBy("lang").agg(F.sum("y"), *(f(s >= c) for c in cuts for f in (F.count_if, lambda q: F.count_if(q & (F.col("y") > 0))))).collect()
    drop_stash(scored)
    out = {}
    for lang, toxic, *hits in counts:
        if toxic >= 10:
            f1 = {c: 2 * hits[2 * k + 1] / max(1, hits[2 * k] + toxic) for k, c in enumerate(cuts)}
            out[lang] = max(cuts, key=lambda c: (round(f1[c], 6), -abs(c - general)))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (at cut), threshold and flagged (at the language's threshold)."""
    spark = docs.sparkSession
    learn = id_remainder(F.col("doc_id"), folds) != held
    found = labelled_rows(docs, labels, "toxic", learn, None).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    fitted = fit(found)
    cuts = {} if isinstance(fitted, float) else calibrated(found.filter("held"), fitted, cut)
    drop_stash(found)
    model = share(spark, fitted)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = received(model)
        memo = None if isinstance(fitted, float) else Memo(fitted)
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                value = np.full(len(part), fitted) if memo is None else sigmoid(memo.logits([t or "" for t in part["text"]]) / fitted.temperature)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang": part["lang"], "score": value.astype(float)})

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    scored = docs.select(F.col("doc_id").cast("long"), (id_remainder(F.col("doc_id"), folds) == held).alias("held_out"), lang, "text").mapInPandas(score, "doc_id long, held_out boolean, lang string, score double")
    threshold = F.coalesce(F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))[F.col("lang")] if cuts else F.lit(None), F.lit(cut)).cast("double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
