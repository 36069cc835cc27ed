"""Benchmark decontamination by suffix arrays over the training texts.

Every task makes suffix arrays over shards of its documents' words (at most SHARD words each); every suffix of every
benchmark item is binary-searched in each, one word deeper at a time, until no training suffix is left. The range at a
window's depth holds all places where the window occurs; the last range that isn't empty is the suffix's longest verbatim
match, with its places.

A word is a run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; words are compared by 64-bit
hashes. A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Words of a
document inside any occurrence of a window are hit. A document longer than a shard is cut into pieces that overlap by
window - 1 words, so no occurrence is lost; a longest match ends at the piece's end.

Items come in blocks of at most BLOCK words, one at a time through a broadcast of that bound; each block takes one pass
over the documents. Tasks hold one shard (some 60 bytes a word) and the batch that is read, whatever the documents.

Nulls: a null text has no words and is not hit; null doc_ids pass through. Windows of an item with a null id count as
hits, but such an item isn't counted or listed. Rows that repeat an item_id are one item. Repeated documents each have
their row. Empty tables give no rows, or rows without hits. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batches_of, drop_stash, numbered, received, share, stash

WINDOW, SHARD, BLOCK = 10, 1 << 20, 1 << 19

#: Bytes that belong to words as they are, A-Z in lower case, all else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, suffix struct<item_id:string,item_at:long,length:long,doc_at:long>"


def hashed_words(hashes: WordHashes, text: str | None) -> np.ndarray:
    return hashes((text or "").encode("utf-8", "surrogatepass").translate(_WORDS))[0]


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The suffix array of ids (below 2**21 - 1), by prefix tripling; after the first sort only ties are sorted again."""
    n, m = len(ids), 21
    if not n:
        return np.zeros(0, np.int64)
    ahead = np.concatenate([ids + 1, np.zeros(2, np.int64)])
    key = ahead[:-2] << 2 * m | ahead[1:-1] << m | ahead[2:]
    order, slots, rank, depth = np.argsort(key), np.arange(n), np.empty(n, np.int64), 3
    key = key[order]
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(key)))
        rank[order[slots]] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        at = order[slots]
        far = [np.where(at + k * depth < n, rank[np.minimum(at + k * depth, n - 1)] + 1, 0) for k in (1, 2)]
        key = rank[at] << 2 * m | far[0] << m | far[1]
        by = np.argsort(key)
        order[slots], key, depth = at[by], key[by], 3 * depth


class Suffixes:
    """The suffixes of a block of items, as hashes of words, with the depth of the window that begins there (0: none)."""

    def __init__(self, pieces: list[tuple[str | None, int, bool, np.ndarray]], window: int):
        """pieces: (item_id, place of its first word in the item, whether the item goes on, words)."""
        self.names = [p[0] for p in pieces]
        self.words = np.concatenate([np.zeros(0, np.uint64), *(p[3] for p in pieces)])
        size = np.array([len(p[3]) for p in pieces], np.int64)
        self.piece = np.repeat(np.arange(len(pieces)), size)
        first = np.concatenate([np.zeros(0, np.int64), np.cumsum(size) - size])
        inside = np.arange(len(self.words)) - first[self.piece] if len(pieces) else np.zeros(0, np.int64)
        self.end = np.repeat(first + size, size)
        self.at = inside + np.repeat(np.array([p[1] for p in pieces], np.int64), size)
        rest = self.end - np.arange(len(self.words))
        whole = np.repeat(np.array([p[1] == 0 and not p[2] and len(p[3]) < window for p in pieces], bool), size)
        self.depth = np.where(rest >= window, window, np.where(whole & (self.at == 0), rest, 0))

    def search(self, codes: np.ndarray, order: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(lo, hi) of the window's range in the suffix array for every suffix (empty where it has none or doesn't occur), and
        (length, place) of the longest match of each suffix. codes: the suffixes' words as ids of the shard, or -1."""
        n, where = len(codes), np.arange(len(codes))
        window = np.zeros((2, n), np.int64)
        length, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo, hi, j = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(where):
            want = codes[where + j]
            if j == 0:
                lo, hi = counts[want], counts[want + 1]
            else:
                lo, hi = self._bound(order, ids, lo, hi, want, j, False), self._bound(order, ids, lo, hi, want, j, True)
            stays = (lo < hi) & (want >= 0)
            where, lo, hi, j = where[stays], lo[stays], hi[stays], j + 1
            length[where], place[where] = j, order[lo]
            due = self.depth[where] == j
            window[0, where[due]], window[1, where[due]] = lo[due], hi[due]
            goes = where + j < self.end[where]
            where, lo, hi = where[goes], lo[goes], hi[goes]
        return window[0], window[1], (length, place)

    @staticmethod
    def _bound(order, ids, lo, hi, want, j, right: bool) -> np.ndarray:
        """Binary search, for all at once, of the first suffix in [lo, hi) whose word at j is not below (right: is above) want."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid] + j
            word = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1)
            up = word <= want[open_] if right else word < want[open_]
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


class Shard:
    """Pieces of documents that fill up to a suffix array."""

    def __init__(self, suffixes: Suffixes, window: int):
        self.suffixes, self.window, self.pieces, self.size, self.docs = suffixes, window, [], 0, {}

    def add(self, key: int, row: int, doc_id: int | None, words: np.ndarray) -> Iterator[tuple]:
        self.docs[key] = [row, doc_id, len(words), None, set(), 0]
        step = SHARD - self.window
        for at in range(0, max(1, len(words)), step):
            piece = words[at : at + step + self.window - 1]
            if self.size + len(piece) + 1 > SHARD:
                yield from self.flush(key)
            self.pieces.append((key, at, piece))
            self.size += len(piece) + 1

    def flush(self, unfinished: int | None = None) -> Iterator[tuple]:
        """Searches what is gathered; gives the rows of all documents but the unfinished one."""
        s, n = self.suffixes, len(self.pieces)
        sizes = np.array([len(p[2]) + 1 for p in self.pieces], np.int64)
        ends = np.cumsum(sizes)
        words = np.concatenate([np.zeros(0, np.uint64), *(np.append(p[2], np.uint64(0)) for p in self.pieces)])
        if n and len(s.words) and len(words) > n:
            apart = np.zeros(len(words), bool)
            apart[ends - 1] = True
            real, names = pd.factorize(words[~apart])
            ids = np.empty(len(words), np.int64)
            ids[apart], ids[~apart] = np.arange(n), real + n  # each end of a piece is a word of its own
            codes = pd.Index(names).get_indexer(s.words)
            codes = np.where(codes >= 0, codes + n, -1)
            if (codes >= 0).any():
                order = suffix_order(ids)
                counts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n + len(names)))])
                yield from self._mark(*s.search(codes, order, ids, counts), order, ends, sizes, len(words))
        self.pieces, self.size = [], 0
        for key in [k for k in self.docs if k != unfinished]:
            row, doc_id, n_words, mask, items, _ = self.docs.pop(key)
            yield row, doc_id, n_words, [] if mask is None else _spans(mask), sorted(items), None

    def _mark(self, lo, hi, longest, order, ends, sizes, total) -> Iterator[tuple]:
        s = self.suffixes
        hits = np.flatnonzero(hi > lo)
        if len(hits):
            ranges, which = np.unique(np.stack([lo[hits], hi[hits], s.depth[hits]]), axis=1, return_inverse=True)
            which = which.ravel()
            held: list[set] = [set() for _ in range(ranges.shape[1])]  # the items of each distinct window
            for r, t in zip(which.tolist(), hits.tolist()):
                held[r].add(s.names[s.piece[t]])
            kinds: dict[frozenset, int] = {}
            kind = np.array([kinds.setdefault(frozenset(x), len(kinds)) for x in held])
            groups = list(kinds)
            size = ranges[1] - ranges[0]
            entry = np.repeat(np.arange(len(size)), size)
            at = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + ranges[0][entry]]
            covered = np.cumsum(np.bincount(at, minlength=total + 1) - np.bincount(at + ranges[2][entry], minlength=total + 1))[:-1] > 0
            piece = np.searchsorted(ends, at, side="right")
            for p, k in np.unique(np.stack([piece, kind[entry]]), axis=1).T.tolist():
                key, start, words = self.pieces[p]
                doc = self.docs[key]
                doc[4] |= {x for x in groups[k] if x is not None}
                if doc[3] is None:
                    doc[3] = np.zeros(doc[2], bool)
                first = ends[p] - sizes[p]
                doc[3][start : start + len(words)] |= covered[first : first + len(words)]
        length, place = longest
        for t in np.flatnonzero((s.depth > 0) & (length >= s.depth)).tolist():
            p = int(np.searchsorted(ends, place[t], side="right"))
            key, start, _ = self.pieces[p]
            row, doc_id = self.docs[key][:2]
            yield row, doc_id, None, None, None, (s.names[s.piece[t]], int(s.at[t]), int(length[t]), int(place[t] - ends[p] + sizes[p] + start))


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple]]:
    """Lists of pieces of items of at most BLOCK words."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, step = WordHashes(), BLOCK - window + 1
        for frame in frames:
            rows = []
            for i, text in zip(frame["item_id"], frame["text"]):
                words = hashed_words(hashes, text)
                rows += [(i, at, at + BLOCK < len(words), words[at : at + BLOCK].tobytes()) for at in range(0, max(1, len(words) - window + 1), step)]
            yield pd.DataFrame(rows, columns=["item_id", "at", "more", "words"])

    pieces = stash(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(cut, "item_id string, at long, more boolean, words binary"))
    block, size = [], 0
    for r in pieces.toLocalIterator():
        words = np.frombuffer(r["words"], np.uint64)
        if block and size + len(words) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["at"], r["more"], words))
        size += len(words)
    drop_stash(pieces)
    yield block


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What the suffix arrays find, stored: a row for each document and block (spans: words hit; items: items with an
    occurring window), and rows with `suffix`: the longest match of a suffix in a shard that reaches its window.

    docs: row (a number of the row, stored), doc_id, text.
    """
    spark, found = docs.sparkSession, None
    for pieces in _blocks(benchmark, window):
        shared = share(spark, Suffixes(pieces, window))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hashes, shard, key = WordHashes(), Shard(received(shared), window), 0
            give = lambda rows: pd.DataFrame(rows, columns=["row", "doc_id", "n_words", "spans", "items", "suffix"]).astype({"row": "Int64", "doc_id": "Int64", "n_words": "Int64"})
            for frame in frames:
                out = []
                for row, i, text in zip(frame["row"], frame["doc_id"], frame["text"]):
                    out += shard.add(key, row, None if pd.isna(i) else int(i), hashed_words(hashes, text))
                    key += 1
                if out:
                    yield give(out)
            yield give(list(shard.flush()))

        with batches_of(spark):
            one = stash(docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, FOUND))
        found = one if found is None else found.unionByName(one)
        shared.unpersist()
    return found


def _verdicts(found: DataFrame, several: bool) -> DataFrame:
    rows = found.filter("suffix is null")
    if several:  # a document's spans and items from each block of items
        rows = rows.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    n_hit = F.aggregate("spans", zero, step)["n"]
    return rows.select(
        "row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    several = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    several = several // 2 > BLOCK  # a word takes a character and a separator at least
    known = numbered(docs.select("doc_id", "text"), "row") if several else docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    found = _verdicts(search(known, benchmark), several)
    if several:
        found = stash(found)
        drop_stash(known)
    return found.drop("row")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per suffix of an item that occurs for its window at least: item_id, item_at, its longest verbatim match (length, in
    words) in any document and one place of it (doc_id, doc_at; the smallest of what the shards found)."""
    found = search(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), benchmark).filter("suffix is not null")
    best = F.min_by(F.struct("doc_id", "suffix.doc_at"), F.struct(-F.col("suffix.length"), "doc_id", "suffix.doc_at")).alias("place")
    return found.groupBy("suffix.item_id", "suffix.item_at").agg(F.max("suffix.length").alias("length"), best).select("item_id", "item_at", "length", "place.doc_id", "place.doc_at")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents in which a window occurs."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    known = numbered(docs, name)
    found = search(known.select(F.col(name).alias("row"), "doc_id", "text"), benchmark).filter("suffix is null and size(spans) > 0")
    return known.join(found.select(F.col("row").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
m AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS MATERIALIZED (SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM m) WHERE len(w) >= m)),
h AS MATERIALIZED (SELECT r, i, m, item_id FROM p JOIN m USING (m, win)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS k FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
