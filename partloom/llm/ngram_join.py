"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 0.8, and their groups.

1. Each document's words give its set of hashed shingles. Documents of equal sets (by a 128-bit digest) form one class,
   which is one node from here on, however many copies it has.
2. Shingle frequencies of all documents are counted in a table of BUCKETS counters. The counters, then the hash, give
   the one order of shingles, rarest first.
3. Prefix filter: a class is posted under its first n - ceil(t * n) + 1 shingles, with its size and the place of each.
   Two similar sets must share a posting. Shingles that the same classes hold give the same pairs: of these only the
   first in the order keeps its list.
4. Candidates: postings of one shingle pass the length filter and the positional filter, pairs are made distinct, then
   pass the suffix filter (both sets' counts over SPLIT ranges of the hash bound their overlap).
5. Each remaining pair is verified once, on both whole texts.

Only groups are asked for, so pairs inside a group that is already one need no check. The first turn pairs every posting
with HUBS hubs of its shingle (linear in the postings), verifies, and unites. The second turn pairs the holders of a
shingle that still lie in different groups: those outside the group of its first hub with all others. Each such pair
comes from its first common list only, where the positional filter is sharpest (exactly so among each class's EARLIER
first lists; beyond, a pair may come up again and is made distinct). That misses no link between groups: a pair left out
lies inside one group.

Nulls and texts without words have an empty set, link with nothing and are components of their own (null ids keep a null
component). Fewer words than the shingle length give one shingle, the whole sequence. Rows that repeat an id are members
of their classes as all others. Documents are told apart by digest and id, never by the place of a row in a scan. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, drop_stash, lower_bytes, numbered, small_batches, stash
from .components import smallest_reachable

SPAN, BUCKETS, CHUNK, SPLIT, HUBS, EARLIER, BITS = 5, 1 << 22, 1 << 14, 256, 3, 128, 1 << 26
HOT = 1000  # a class of at least one in HOT rows is sent to the rows' tasks: at most HOT classes (2 * HOT rows or fewer: all that repeat)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingles:
    """Sorted distinct shingle hashes of whole texts, in array operations only: a shingle mixes the hashes of its words."""

    def __init__(self):
        self.words = WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        h, _ = self.words(lower_bytes(text))
        if not len(h):
            return h
        span = min(SPAN, len(h))
        n = len(h) - span + 1
        code = np.full(n, span, np.uint64)
        for k in range(span):
            code = (code ^ h[k : k + n]) * _MIX[k]
            code ^= code >> np.uint64(31)
        code.sort()
        return code[np.concatenate([[True], code[1:] != code[:-1]])]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _packed(counts: np.ndarray) -> bytes:
    """The bytes of 32-bit counts, lowest bytes first, compressed: most are small."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def summaries(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, text): n and the digest of its set. Further rows carry counters: chunk and counts."""

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, counts = Shingles(), np.zeros(BUCKETS, np.int32)
        for frame in frames:
            sets = [shingles.of(t) for t in frame["text"]]
            for at in range(0, len(sets), 500):
                grams = np.concatenate([*sets[at : at + 500], np.zeros(0, np.uint64)])
                spots, n = np.unique((grams & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
                counts[spots] += n.astype(np.int32)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "digest": [_digest(s) for s in sets], "chunk": -1, "counts": None})
        for at in range(0, BUCKETS, CHUNK):
            part = counts[at : at + CHUNK]
            if part.any():
                yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n": [0], "digest": [None], "chunk": [at // CHUNK], "counts": [_packed(part)]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(summarize, "doc_id long, n int, digest binary, chunk int, counts binary")


def counters(rows: DataFrame) -> np.ndarray:
    """Rank of each counter's total, a byte each (16 steps for each doubling): BUCKETS bytes, whatever the input."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for chunk, raw in zip(frame["chunk"], frame["counts"]):
                have = sums.setdefault(int(chunk), np.zeros(CHUNK, np.int64))
                have += np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).astype(np.int64).T @ (1 << 8 * np.arange(4))
        for chunk, total in sums.items():
            ranks = np.minimum(255, 16 * np.log2(1 + total / 8)).astype(np.uint8)
            yield pd.DataFrame({"chunk": [chunk], "ranks": [ranks.tobytes()]})

    parts = rows.filter("chunk >= 0").select("chunk", "counts").repartition("chunk").mapInPandas(add, "chunk int, ranks binary")
    out = np.zeros(BUCKETS, np.uint8)
    for r in parts.collect():  # BUCKETS / CHUNK rows
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.ranks, np.uint8)
    return out


def prefixes(docs: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """(digest, n, prefix) of the set of every row with words; of equal sets met in one task only the first."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, rank = Shingles(), shared.value
        seen: set[bytes] = set()
        for frame in frames:
            for at in range(0, len(frame), 500):
                out = []
                for text in frame["text"].iloc[at : at + 500]:
                    s = shingles.of(text)
                    digest = _digest(s)
                    if len(s) and digest not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                        order = np.argsort(rank[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[: prefix_length(len(s), percent)]
                        out.append((digest, len(s), s[order].view(np.int64)))
                if out:
                    yield pd.DataFrame(out, columns=["digest", "n", "prefix"])

    return docs.select("text").mapInPandas(post, "digest binary, n int, prefix array<long>")


def shared_lists(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """(gram, node, n, place, holders): postings of shingles that two classes or more hold, one list for each set of holders.

    posted may hold a class once for each task that met it; such copies leave the lists at the end.
    """
    each = posted.select(F.col("uid").alias("node"), "n", F.posexplode("prefix").alias("place", "gram"))
    several = each.groupBy("gram").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    lists = stash(each.join(several, "gram"))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))  # noqa: E731  sums of 32 bits stay whole up to 2 ** 31 holders
    h = F.xxhash64("node")
    sets = lists.groupBy("gram", "holders").agg(F.sum(low(h)).alias("s1"), F.sum(low(F.shiftrightunsigned(h, 32))).alias("s2"), F.sum(low(F.hash("node").cast("long"))).alias("s3"), F.min("place").alias("at"))
    chosen = sets.groupBy("holders", "s1", "s2", "s3").agg(F.min_by("gram", "at").alias("gram"))  # places follow one order: the first shingle's are the least
    copies = posted.select("uid", "digest").join(classes, "digest").filter("uid <> node").select(F.col("uid").alias("node"))
    out = stash(lists.join(chosen.select("gram"), "gram").join(copies, "node", "left_anti"))
    drop_stash(lists)
    return out


def _possible(percent: int, first: Column | None = None):
    """The length filter and the positional filter on sizes x_n, y_n and places x_at, y_at of a common shingle.

    Where it is the first common one, the overlap lies behind it; else those before it may be common as well.
    """
    least = F.ceil(percent * (F.col("x_n") + F.col("y_n")) / (100.0 + percent) - 1e-9)
    length = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    before = F.least("x_at", "y_at") if first is None else F.when(first, 0).otherwise(F.least("x_at", "y_at"))
    return length & (before + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= least)


def _sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    names = {"node": "", "n": "_n", "place": "_at", **{m: f"_{m}" for m in more}}
    return tuple(rows.select("gram", *(F.col(k).alias(side + v) for k, v in names.items())) for side in ("x", "y"))


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (x, y): every posting with HUBS holders of its shingle: the one with fewest rarer shingles (in a group of near
    copies that is the least altered), and the first ones in the orders of hashes."""
    x, y = _sides(lists)
    hub = F.struct("y", "y_n", "y_at")
    hubs = y.groupBy("gram").agg(F.array_distinct(F.array(*(F.min_by(hub, F.struct(F.col("y_at") if h == 0 else F.lit(0), F.xxhash64("y", F.lit(h)), F.col("y"))) for h in range(HUBS)))).alias("hubs"))
    pairs = x.join(hubs, "gram").select("gram", "x", "x_n", "x_at", F.inline("hubs")).filter("x <> y").filter(_possible(percent))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def open_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (x, y) of holders of one shingle that lie in different groups."""
    own = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = own.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", F.struct("place", F.xxhash64("node", F.lit(0)))).alias("main")).filter("low <> high").select("gram", "main")
    in_order = Window.partitionBy("node").orderBy("place")  # a node has as many lists as shingles in its prefix at most
    placed = own.join(several, "gram").withColumn("seq", F.row_number().over(in_order))
    before = F.collect_list(F.when(F.col("seq") <= EARLIER, F.col("gram"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = stash(placed.withColumn("before", before))
    x, y = _sides(rows, "label", "main", "before", "seq")
    once = (F.col("y_label") == F.col("y_main")) | (F.col("x") < F.col("y"))
    first = F.greatest("x_seq", "y_seq") <= EARLIER + 1  # then the lists before are all known
    met = x.filter("x_label <> x_main").join(y, "gram").filter(F.col("x_label") != F.col("y_label")).filter(once & _possible(percent, first)).filter(~F.arrays_overlap("x_before", "y_before"))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def thinned(digests: DataFrame) -> np.ndarray:
    """BITS bits, set at the places of the digests (digest): what has no bit is not among them. A filter of fixed size before joins."""
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % BITS + 1
    maps = digests.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # BITS / 32768 rows of 4 KB at most
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _may_hold(bits: np.ndarray, digest: bytes) -> bool:
    at = int.from_bytes(digest[:4], "big") % BITS
    return bool(bits[at >> 3] >> (at & 7) & 1)


def texts_of(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, text, counts) of the classes that have a list: a text, compressed, and its set's counts over SPLIT ranges, up to 255."""
    wanted = stash(classes.join(lists.select("node").distinct(), "node", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(thinned(wanted))

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen, bits = Shingles(), set(), shared.value
        for frame in frames:
            out = []
            for text in frame["text"]:
                s = shingles.of(text)
                digest = _digest(s)
                if len(s) and digest not in seen and _may_hold(bits, digest):
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(digest)
                    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=SPLIT)
                    out.append((digest, zlib.compress(text.encode("utf-8", "surrogatepass"), 1), np.minimum(counts, 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["digest", "text", "counts"])

    found = docs.select("text").mapInPandas(digests, "digest binary, text binary, counts binary").join(wanted, "digest")
    return stash(found.dropDuplicates(["digest"]).select("node", "text", "counts"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that are similar. texts: (node, text, counts). Counts go first, so whole texts travel for few pairs."""

    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            p, q = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, SPLIT).astype(np.int64) for c in (a, b))
            full = (p == 255).any(1) | (q == 255).any(1)  # such sets may be larger than the counts say
            both = p.sum(1) + q.sum(1)
            yield pd.Series(full | (np.minimum(p, q).sum(1) >= -(-percent * both // (100 + percent))))

    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingles = Shingles()
        for a, b in batches:
            out = []
            for p, q in zip(a, b):
                p, q = (shingles.of(zlib.decompress(t).decode("utf-8", "surrogatepass")) for t in (p, q))
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pd.Series(out)

    side = lambda s, c: texts.select(F.col("node").alias(s), F.col(c).alias(f"{s}_{c}"))
    close = stash(pairs.join(side("x", "counts"), "x").join(side("y", "counts"), "y").filter(F.pandas_udf(near, "boolean")("x_counts", "y_counts")).select("x", "y"))
    return close.join(side("x", "text"), "x").join(side("y", "text"), "y").filter(F.pandas_udf(similar, "boolean")("x_text", "y_text")).select("x", "y")


def linked_classes(docs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(digest, label) of the classes that similarity joins with others; the label names the group."""
    posted = numbered(prefixes(docs, counters(found), percent), "uid")
    classes = stash(posted.groupBy("digest").agg(F.min("uid").alias("node")))
    lists = shared_lists(posted, classes)
    drop_stash(posted)
    texts = texts_of(docs, classes, lists)
    turns = stash(verified(hub_pairs(lists, percent), texts, percent))
    labels = smallest_reachable(turns.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("root", "label")
    rest = stash(verified(open_pairs(lists, labels, percent), texts, percent))
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    between = rest.join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("x_label", "x").alias("a"), F.coalesce("y_label", "y").alias("b"))
    joined = smallest_reachable(between).withColumnRenamed("node", "label")
    nodes = labels.unionByName(joined.select(F.col("label").alias("node"), "label")).dropDuplicates(["node"])
    named = nodes.join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    out = stash(classes.join(named, "node").select("digest", "label"))
    for done in (lists, texts):
        drop_stash(done)
    return out


def groups(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest) of docs, and classes: digest, members, least (its smallest id), linked, component_id
    (the smallest id of its group) and stays (whether its smallest id stands for the group)."""
    small_batches(docs.sparkSession)
    found = stash(summaries(docs))
    rows = found.filter("chunk < 0").select("doc_id", "n", "digest")
    linked = linked_classes(docs, found, percent)
    classes = stash(rows.filter("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least")).join(linked, "digest", "left"))
    first = F.min(F.struct(F.col("least").isNull().alias("last"), "least", "digest")).alias("first")
    heads = stash(classes.filter("label is not null").groupBy("label").agg(first, F.count(F.lit(1)).alias("size")).select("label", "size", F.col("first.least").alias("head"), F.col("first.digest").alias("head_digest")))
    columns = ["digest", "members", "least", "linked", "component_id", "stays"]
    joined = met(classes.filter("label is not null").withColumn("linked", F.lit(True)), heads, "label", "size")
    joined = joined.withColumn("component_id", F.col("head")).withColumn("stays", F.col("digest") == F.col("head_digest")).select(columns)
    alone = classes.filter("label is null").withColumn("linked", F.lit(False)).withColumn("component_id", F.col("least")).withColumn("stays", F.lit(True)).select(columns)
    return rows, stash(joined.unionByName(alone))


def met(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their groups, by key; the rows of groups with very many of them (size) meet these by broadcast."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    many = groups.filter(F.col(size) >= max(2, -(-total // HOT)))  # HOT groups at most
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(many), key).unionByName(rest)


def jaccard_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id of the row's group, for every row of docs."""
    rows, classes = groups(docs, **options)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    size = F.col("n").cast("long").alias("n_shingles")
    named = met(rows.filter("n > 0"), classes, "digest", "members").select("doc_id", size, component.alias("component_id"))
    return named.unionByName(rows.filter("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each group one row with the smallest id (of equal ids, a row of the smallest digest); rows without words all stay.

    Only rows that may belong to a group of several meet their class in a join; the rows of HOT classes are judged where they are.
    """
    _, classes = groups(docs, **options)
    several = stash(classes.filter("members > 1 or not stays or linked").select("digest", "members", "stays", "least"))
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = {bytes(r.digest): (r.stays, r.least) for r in several.filter(F.col("members") >= max(2, -(-total // HOT))).select("digest", "stays", "least").collect()}  # HOT at most
    shared = docs.sparkSession.sparkContext.broadcast((hot, thinned(several)))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Null: the row stays. Empty: it goes. Else the digest under which to look it up."""
        shingles, (many, bits) = Shingles(), shared.value
        for texts, ids in batches:
            out = []
            for text, i in zip(texts, ids):
                s = shingles.of(text)
                digest = _digest(s) if len(s) else None
                if digest in many:
                    stays, least = many[digest]
                    out.append(digest if stays and i == ("" if least is None else str(least)) else b"")
                else:
                    out.append(digest if digest is not None and _may_hold(bits, digest) else None)
            yield pd.Series(out, dtype=object)

    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    judged = rows.withColumn("digest", F.pandas_udf(judge, "binary")("doc.text", F.coalesce(F.col("doc.doc_id").cast("long").cast("string"), F.lit(""))))
    found = judged.filter("digest is not null and digest <> X''").join(several.select("digest", "stays", F.col("least").alias("head")), "digest", "left")
    own = found.filter(F.col("stays").isNull() | (F.col("stays") & F.col("doc.doc_id").cast("long").eqNullSafe(F.col("head"))))
    return judged.filter("digest is null").select("doc").unionByName(own.dropDuplicates(["digest"]).select("doc")).select("doc.*")
