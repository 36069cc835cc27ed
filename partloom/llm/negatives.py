"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Rows are range-partitioned by label, dimension and length and stored as blocks of at most BLOCK vectors of one label, each
with a sorted list of its rows for every dimension. An anchor goes down all lists of a block at once, from the top where
its own component is positive and from the bottom where it is negative; every row met is scored exactly (random access);
the products of its components with what the lists show next are a threshold that no row not yet met can exceed. It stops
once the threshold is strictly below the k-th score of each of its windows, or below the window's lower end.

First the positives: an anchor's k best rows of its own label, in the blocks of that label. Each positive of score p
opens a window [low% of p, p]; the second pass finds every window's best k rows in the blocks of other labels. A block
travels to an anchor only if its longest vector may reach the least score that the anchor asks for. Labels that hold many
rows simply have many blocks. No pair of rows leaves a block unless it is among the best k there.

Components are integers (floor(scale * x), x as double). Scores are exact: float64 where |a| * |v| < 2**52, else Python's
integers; a score beyond 64 bits is compared in full and reported as the nearest value that a long holds.

Left out: null ids (nothing could be reported), null labels, null vectors, vectors with null or non-finite components
(also after scaling). Rows meet rows of their own dimension only, and none of their own id; rows that repeat an id are
rows of their own, as anchors and as candidates. An anchor without positives, or whose positives all score below 0 (their
windows are empty), has no rows. Ties go to the smaller id. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, drop_stash, numbered, stash

BLOCK, ANCHORS, GROUP = 2048, 256, 1 << 16
_PACKED = "part int, label long, dim int, longest double, ids binary, data binary, lists binary"
_ASKING = "aid long, label long, dim int, need double, keys binary, ids binary, data binary, windows string"
_BIG = 1 << 62


def _pack(size: int, give):
    """Runs of rows of one label and dimension, at most `size` each, as what give() makes of them."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if waiting and (len(waiting) == size or (r.label, len(r.v)) != (waiting[0].label, len(waiting[0].v))):
                    out.append(give(waiting))
                    waiting = []
                waiting.append(r)
            if out:
                yield pd.DataFrame(out)
        if waiting:
            yield pd.DataFrame([give(waiting)])

    return pack


def _matrix(rows: list) -> np.ndarray:
    return np.array([r.v for r in rows], np.float64).reshape(len(rows), len(rows[0].v))


def _block(rows: list) -> dict:
    v = _matrix(rows)
    lists = np.argsort(v, axis=0, kind="stable").T.astype(np.uint16)  # a list of rows, by value, for each dimension
    return {"part": rows[0].part, "label": rows[0].label, "dim": v.shape[1], "longest": max(r.length for r in rows), "ids": np.array([r.vec_id for r in rows], np.int64).tobytes(), "data": v.tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}


def _asking(rows: list) -> dict:
    own = lambda n: np.array([getattr(r, n) for r in rows], np.int64).tobytes()
    return {"aid": rows[0].row, "label": rows[0].label, "dim": len(rows[0].v), "need": min(r.need for r in rows), "keys": own("row"), "ids": own("vec_id"), "data": _matrix(rows).tobytes(), "windows": "[" + ",".join(r.windows for r in rows) + "]"}


def threshold_search(a: np.ndarray, own: int, v: np.ndarray, ids: np.ndarray, lists: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Per window (low, high) the best k (id, score) of the rows whose score lies in it, and how many rows were scored.

    lists[d] holds the rows of v by ascending v[:, d]. Arrays of float64 where products are exact, else of objects.
    """
    n, exact = len(v), a.dtype != object
    use = np.flatnonzero(a)
    if not len(use) and v.shape[1]:
        use = np.arange(1)  # a zero anchor: every row scores 0
    weight, lists = a[use], lists[use].astype(np.int64)
    up = np.array(weight > 0, bool)
    met, depth, step = np.zeros(n, bool), 0, 4
    at, score = np.zeros(0, np.int64), a[:0]
    while depth < n:
        to = min(n, depth + step)
        now = np.zeros(n, bool)
        if len(use):
            now[np.where(up[:, None], lists[:, n - to : n - depth], lists[:, depth:to])] = True
        else:
            now[:], to = True, n
        now &= ~met
        met |= now
        fresh = np.flatnonzero(now)
        value = v[fresh] @ a if exact else np.array([sum(x * y for x, y in zip(a, row)) for row in v[fresh]], object)
        other = ids[fresh] != own
        at, score = np.append(at, fresh[other]), np.append(score, value[other])
        depth, step = to, 2 * step
        if depth < n:
            edge = np.where(up, lists[:, n - depth], lists[:, depth - 1])
            threshold = (weight * v[edge, use]).sum()
            low = []
            for least, most in windows:
                inside = score[(score >= least) & (score <= most)]
                low.append(np.sort(inside)[len(inside) - k] if len(inside) >= k else least)
            if all(threshold < x for x in low):
                break
    found = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        if len(inside) > 4 * k:
            kth = np.sort(score[inside])[len(inside) - k]
            inside = inside[score[inside] >= kth]
        best = sorted((-int(score[i]), int(ids[at[i]])) for i in inside)[:k]
        found.append([(i, -s) for s, i in best])
    return found, int(met.sum())


def _told(score: int) -> tuple[int, str | None]:
    """A score as a long and, near or beyond its ends, as a text that sorts like it."""
    return (score, None) if abs(score) < _BIG else (max(-(1 << 63), min((1 << 63) - 1, score)), f"{score + 10**699:0700d}")


def _searcher(k: int, low: int):
    """Anchors' windows against a block: JSON lists of [rank, positive_id, score]; none: one window without ends."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples(index=False):
                ids, keys, own = (np.frombuffer(x, np.int64) for x in (b.ids, b.keys, b.own))
                v, asked = np.frombuffer(b.data).reshape(len(ids), b.dim), np.frombuffer(b.asked).reshape(len(keys), b.dim)
                lists = np.frombuffer(b.lists, np.uint16).reshape(b.dim, len(ids))
                big, out, whole = None, [], json.loads(b.windows)
                for i, a in enumerate(asked):
                    far = np.sqrt((a**2).sum()) * b.longest * (1 + 1e-9)
                    wanted = [(rank, i_, p, -(-low * p // 100)) for rank, i_, p in whole[i]] or [(0, None, None, None)]
                    if whole[i] and far < min(w[3] for w in wanted):
                        continue
                    if far < 2**52:
                        rows, anchor = v, a
                    else:
                        big = np.array([[int(x) for x in row] for row in v.tolist()], object).reshape(v.shape) if big is None else big
                        rows, anchor = big, np.array([int(x) for x in a.tolist()], object)
                    ends = [(w[3], w[2]) if w[2] is not None else (-np.inf, np.inf) for w in wanted]
                    for w, best in zip(wanted, threshold_search(anchor, own[i], rows, ids, lists, ends, k)[0]):
                        out += [(int(keys[i]), int(own[i]), w[0], w[1], j, *_told(s), _told(w[2])[0] if w[2] is not None else None) for j, s in best]
                if out:
                    yield pd.DataFrame(out, columns=["row", "anchor_id", "positive_rank", "positive_id", "vec_id", "score", "whole_score", "positive_score"]).astype({"positive_id": "Int64", "positive_score": "Int64"})

    return search


_HIT = "row long, anchor_id long, positive_rank int, positive_id long, vec_id long, score long, whole_score string, positive_score long"


def _best(anchors: DataFrame, blocks: DataFrame, parts: int, k: int, low: int, same_label: bool) -> DataFrame:
    """The best k of every window over all blocks, ranked, stored."""
    on = lambda b: (F.col("a.dim") == F.col(f"{b}.dim")) & (F.col("need") <= F.col(f"{b}.longest")) & ((F.col("a.label") == F.col(f"{b}.label")) if same_label else (F.col("a.label") != F.col(f"{b}.label")))
    # Which block of anchors goes to which partition of blocks: ids and lengths only.
    tops = blocks.groupBy("part", "label", "dim").agg(F.max("longest").alias("longest"))
    heads = anchors.select("aid", "label", "dim", "need", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    meets = heads.alias("a").join(tops.alias("t"), (F.col("a.part") == F.col("t.part")) & on("t")).select("aid", "a.part").distinct()
    sent = meets.join(anchors, "aid")
    pairs = sent.alias("a").join(blocks.alias("b"), (F.col("a.part") == F.col("b.part")) & on("b"))
    pairs = pairs.select("a.dim", "keys", F.col("a.ids").alias("own"), F.col("a.data").alias("asked"), "windows", "longest", "b.ids", "b.data", "lists")
    hits = pairs.mapInPandas(_searcher(k, low), _HIT)
    rank = F.row_number().over(Window.partitionBy("row", "positive_rank").orderBy(F.desc("score"), F.desc("whole_score"), "vec_id"))
    with batches_of(anchors.sparkSession, rows=16):
        return stash(hits.withColumn("rank", rank).filter(F.col("rank") <= k))


def mine_negatives(rows: DataFrame, anchors: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, embedding, label) for which
    anchors holds. Of each of an anchor's k_positive best rows of its label, the k_negative best rows of other labels that
    score at least low percent of the positive's score and no more than it."""
    spark = rows.sparkSession
    x = F.transform("embedding", lambda c: F.coalesce(c.cast("double"), F.lit(float("nan"))) * scale)
    fine = F.forall(x, lambda c: F.abs(c) < float("inf"))
    v = F.transform(x, lambda c: c - F.pmod(c, F.lit(1.0)))  # floor, as a double
    known = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    known = numbered(known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("length", length), "row")
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-known.count() // GROUP))
    order = ("label", F.size("v"), F.desc("length"), "row")
    dealt = known.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    asking = lambda df: df.select("row", "vec_id", "label", "v", "need", "windows").repartitionByRange("label", F.size("v"), "need", "row").sortWithinPartitions("label", F.size("v"), "need", "row").mapInPandas(_pack(ANCHORS, _asking), _ASKING)
    with batches_of(spark):
        blocks = stash(dealt.select("part", "vec_id", "label", "v", "length").mapInPandas(_pack(BLOCK, _block), _PACKED))
        first = stash(asking(known.filter(anchors).withColumns({"need": F.lit(0.0), "windows": F.lit("[]")})))
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    positives = _best(first, blocks, parts, k_positive, low, True)
    score = F.coalesce(F.regexp_replace(F.expr("substring(whole_score, 2)"), "^0+", ""), F.col("score").cast("string"))  # whole_score: only of scores >= 0 here
    window = F.concat(F.lit("["), F.concat_ws(",", F.col("rank").cast("string"), F.col("vec_id").cast("string"), score), F.lit("]"))
    asked = positives.filter("score >= 0").groupBy("row").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(window)), ","), F.lit("]")).alias("windows"), F.min(score.cast("double")).alias("least"))
    need = F.when(F.col("length").between(1e-9, 1e150), F.col("least") * (low / 100) / F.col("length") * (1 - 1e-9)).otherwise(0.0)
    with batches_of(spark):
        second = stash(asking(known.join(asked, "row").withColumn("need", need)))
    found = _best(second, blocks, parts, k_negative, low, False)
    out = stash(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    for done in (known, blocks, first, positives, second, found):
        drop_stash(done)
    return out


ORACLE = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE alike QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.r, k ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
