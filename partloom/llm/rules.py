"""Quality rules: an isolation forest over rule statistics, its thresholds calibrated on labelled documents.

Rule statistics of whole texts come first. Forests then isolate documents by random splits: one over all statistics and
one for each family of them (symbols, repetition, letter case, shape), so that an oddity in one family is not drowned by
the others. A document's score in a forest is 2 ** (-mean path length / expected path length). Each forest's threshold
is the one that rejects most low-quality labelled rows while at most `spare` of the good ones go; a document is kept if
no forest isolates it beyond its threshold.

As the method asks, each tree is grown on SAMPLE rows only; the trees draw these from TREES times as many, taken by a hash from all
labelled rows, mostly good ones with a share of the rest (`contamination`). The thresholds use all labelled rows, statistics and
verdicts cover all rows.

Nulls: a null text has no words, so all statistics are 0 and the base rule fails. Without labels of both classes the
forests are fitted on any documents and each threshold is the top `spare` of their scores. Repeated rows each get their
verdict. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, received, share, stash

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct", "n_upper", "n_marks", "n_lines", "top_word"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)
TREES, SAMPLE, SPAN, BINS = 60, 256, 8, 1000
_WORDS, _SYMBOLS, _MARKS = re.compile(WORD), re.compile(r"[#*$%&|<>]"), re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-Z\xC0-\xD6\xD8-\xDE]")
#: Families of the features below, by their places.
FAMILIES = {"all": tuple(range(10)), "symbols": (2,), "repetition": (3, 4, 5, 9), "case": (7,), "shape": (1, 6, 8)}


def repeated_words(ids: np.ndarray, span: int = SPAN) -> int:
    """Words in windows of span words that occur twice or more, the first included. Equal hashes are compared in full."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    code = np.zeros(n, np.uint64)
    for k in range(span):
        code = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[k : k + n].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order][1:] == code[order][:-1])
    if not len(same):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, span)
    a, b = order[same], order[same + 1]
    equal = (windows[a] == windows[b]).all(1)
    starts = np.zeros(len(ids) + 1, np.int64)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(starts, hit, 1)
    np.add.at(starts, hit + span, -1)
    return int((np.cumsum(starts)[:-1] > 0).sum())


def statistics(text: str | None) -> list[int]:
    text = text or ""
    words = _WORDS.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif _WORDS.search(line):
            seen.add(line)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return [
        len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), again, repeated_words(ids),
        len(number), len(_UPPER.findall(text)), len(_MARKS.findall(text)), len(lines), int(np.bincount(ids).max()) if words else 0,
    ]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's whole text."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([statistics(t) for t in frame["text"]], columns=BASE + MORE, dtype="int64")
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(count, SCHEMA)


def features(s: np.ndarray) -> np.ndarray:
    """Ratios of the statistics (columns BASE + MORE) that don't depend on the document's length, and its length."""
    n, chars = np.maximum(s[:, 0], 1.0), np.maximum(s[:, 1], 1.0)
    length = np.log1p(s[:, 0])
    variety = np.log1p(s[:, 5]) - 0.9 * length
    cols = [length, s[:, 1] / n, s[:, 2] / n, s[:, 3] / np.maximum(s[:, 8], 1), s[:, 4] / n, variety, s[:, 7] / n, s[:, 6] / chars, np.log1p(s[:, 8]) - 0.8 * length, s[:, 9] / (n + 20)]
    return np.stack(cols, 1)


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    def __init__(self, x: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(self.size, 2)))) + 2
        self.trees = [self.grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def grow(x: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            for store in (feature, cut, left, right):
                store.append(-1)
            length.append(level + usual_path(len(rows)))
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            wide = np.flatnonzero(high > low)
            if level < depth and len(rows) > 1 and len(wide):
                f = int(rng.choice(wide))
                c = rng.uniform(low[f], high[f])
                feature[me], cut[me] = f, c
                left[me] = node(rows[rows[:, f] < c], level + 1)
                right[me] = node(rows[rows[:, f] >= c], level + 1)
            return me

        node(x, 0)
        return np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            going = np.flatnonzero(feature[at] >= 0)
            while len(going):
                here = at[going]
                at[going] = np.where(x[going, feature[here]] < cut[here], left[here], right[here])
                going = going[feature[at[going]] >= 0]
            total += length[at]
        return 2 ** (-total / len(self.trees) / max(usual_path(self.size), 1e-9))


class Rules:
    """Forests by family."""

    def __init__(self, fit_on: np.ndarray):
        self.forests = [(places, IsolationForest(fit_on[:, places], seed)) for seed, places in enumerate(FAMILIES.values())]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row for each of x, a score for each family."""
        return np.stack([forest.score(x[:, places]) for places, forest in self.forests], 1)


def ranked_largest(values: DataFrame, families: int, n: int) -> list[float]:
    """The n-th largest of each family's values (family, score), by counts of BINS bins whose range narrows to one value; it is exact."""
    low_high = values.groupBy("family").agg(F.min("score"), F.max("score")).collect()  # a row for each family
    at = {r[0]: (n, r[1], r[2]) for r in low_high}
    while any(low < high for _, low, high in at.values()):
        pick = lambda i: F.element_at(F.array(*(F.lit(float(at[k][i])) for k in range(families))), F.col("family") + 1)  # noqa: E731, B023
        low, high = pick(1), pick(2)
        place = F.least(F.floor(F.try_divide(F.col("score") - low, high - low) * BINS), F.lit(BINS - 1))
        inside = values.filter((F.col("score") >= low) & (F.col("score") <= high)).withColumn("bin", F.when(high > low, place).otherwise(0))
        bins = inside.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()  # families * BINS rows at most
        for family, (rank, _, _) in list(at.items()):
            for b in sorted((b for b in bins if b.family == family), key=lambda b: -b.bin):
                if rank <= b.n:
                    at[family] = (rank, b.low, b.high)
                    break
                rank -= b.n
    return [at[k][1] for k in range(families)]


def thresholds(labelled: DataFrame, spare: float) -> list[float]:
    """For each family of labelled (good, scores) the smallest threshold beyond which at most spare of all good rows lie, halfway to
    the next bad score."""
    values = labelled.select("good", F.posexplode("scores").alias("family", "score"))
    allowed = int(np.floor(spare * labelled.filter("good").count()))
    top = ranked_largest(values.filter("good"), len(FAMILIES), 1 + allowed)
    beyond = F.col("score") > F.element_at(F.array(*map(F.lit, top)), F.col("family") + 1)
    worse = dict(values.filter(~F.col("good") & beyond).groupBy("family").agg(F.min("score")).collect())  # a row for each family
    return [(t + worse.get(k, t)) / 2 for k, t in enumerate(top)]


def apply_rules(docs: DataFrame, labels: DataFrame, min_words: int = 20, repeat_percent: int = 30, contamination: float = 0.1, spare: float = 0.004) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and excess (how far the most isolating forest is beyond its threshold)."""
    stats = stash(rule_statistics(docs))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("__y")).filter("__y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("__y").alias("__y"))
    marked = lambda rows: rows.filter(~failed).join(marks, "doc_id").withColumn("good", F.col("__y") > 0)
    drawn = lambda rows, n: [tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), *BASE, *MORE).limit(n).select(*BASE, *MORE).collect()]  # noqa: E731  at most TREES * SAMPLE rows
    known, points = marked(stats), TREES * SAMPLE
    fine = drawn(known.filter("good"), int(points * (1 - contamination)))
    bad = drawn(known.filter("not good"), int(len(fine) * contamination) if fine else points)
    learnt = fine + bad
    rows = np.array(sorted(learnt or drawn(stats.filter(~failed), points)), float).reshape(-1, len(BASE + MORE))
    if not len(rows):
        return stats.select("doc_id", *BASE, failed.alias("base_failed"), (~failed).alias("kept"), F.lit(0.0).alias("excess"))
    rules = share(docs.sparkSession, Rules(features(rows)))

    def scores(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(received(rules).scores(features(np.stack([c.to_numpy(float) for c in columns], 1)))))

    scored = stash(stats.withColumn("scores", F.pandas_udf(scores, "array<double>")(*BASE, *MORE)))
    labelled = stash(marked(scored).select("good", "scores"))
    usable = labelled.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not all(usable):
        labelled = (labelled if learnt else scored.filter(~failed)).select(F.lit(True).alias("good"), "scores")
    cuts = thresholds(labelled, spare / len(FAMILIES))
    excess = F.greatest(*(F.col("scores")[k] - F.lit(cut) for k, cut in enumerate(cuts)))
    judged = scored.withColumn("excess", excess)
    return judged.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("excess") <= 0)).alias("kept"), "excess")
