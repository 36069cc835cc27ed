"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words; every document of a source the same number of expected copies, target / size of
the source. Documents stand in a fixed order within their source, expected copies are summed along it, one offset for
each source is added, and a document is emitted once for each integer that its interval crosses.

The order runs by size. A systematic sample over a list sorted by size misses the target by at most about one large
document; ties and classes of near sizes run by a hash of the id. Sums along the order have two levels: (source, size
class, salt) groups are counted, the counts of a source are summed (at most 25 * 8 * SALTS rows however large the
source), and rows are numbered inside their group only. No task ever holds a whole source.

Nulls: a null text has size 0 and is never worth words; a null source is a source of its own and comes last; a null id
hashes as the empty string. Repeated rows count each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, numbered, stash

#: The offset and the order depend on the data and on these only.
SALTS, OFFSETS, SEED = 256, 65536, "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long") * F.when(text.isNull(), 0).otherwise(1)


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_no, source_size, weight, target) from rows (source, size).

    Targets sum to share of all sizes. The excess of sources beyond most times their size is shared again by weight, in
    rounds, until none is above. A round is one aggregate over the table of sources; only sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    # Numbers along the code points: range partitions are numbered inside, then shifted by the rows of those before.
    placed = stash(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(inside) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = stash(placed.join(before, "part").withColumn("source_no", number.cast("long")).withColumn("weight", weight.cast("long")).drop("part", "before"))

    cap, w = F.col("source_size") * most, F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal, level, capped = total * share[0] / share[1], 0.0, -1
    while True:
        above = F.lit(False) if capped < 0 else cap < F.lit(level) * w
        kept, shared, n = sources.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(w)), F.count_if(above)).first()
        if n == capped or not shared:
            break
        capped, level = n, (goal - kept) / shared
    target = F.least(cap.cast("double"), F.lit(level) * w)
    return sources.withColumn("target", target)


def place(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes (source, size, doc_id and more) with source_size, target and copies."""
    bits = F.length(F.bin("size"))
    top = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")  # with bits: the four leading bits
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = (
        sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("bits", bits).withColumn("top", top).withColumn("h", F.md5(name))
        .withColumn("salt", _hex(name, 8) % SALTS)
    )
    group = ["source_no", "bits", "top", "salt"]
    along = Window.partitionBy("source_no").orderBy("bits", "top", "salt")
    before = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(along) - F.col("n")).drop("n")
    inside = Window.partitionBy(*group).orderBy("size", "h", "doc_id")
    place = F.col("before") + F.row_number().over(inside)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (_hex(F.concat(F.lit(SEED), F.coalesce("source", F.lit(""))), 8) % OFFSETS + 0.5) / OFFSETS
    return (
        keyed.join(before, group)
        .withColumn("place", place)
        .withColumn("copies", (F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)).cast("long"))
        .drop("bits", "top", "h", "salt", "before", "place", "source_no", "source_docs", "weight")
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sizes = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    placed = place(sizes, source_targets(sizes, **options))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit_mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row of docs as often as it was drawn, with its own columns."""
    rows = numbered(docs, "__row")
    sizes = stash(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), "__row"))
    drawn = place(sizes, source_targets(sizes.select("source", "size"), **options)).filter("copies > 0").select("__row", F.col("copies").cast("int").alias("__copies"))
    return rows.join(drawn, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__row", "__copies", "__copy")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w,
  sum(source_size) OVER () * 3 / 2 AS goal FROM t),
levels(lam) AS (
  SELECT max(goal)::DOUBLE / sum(w)::DOUBLE FROM s
  UNION
  SELECT (max(goal)::DOUBLE - sum(CASE WHEN cap < lam * w THEN cap ELSE 0 END)::DOUBLE)
       / nullif(sum(CASE WHEN cap < lam * w THEN 0 ELSE w END), 0)::DOUBLE FROM levels, s GROUP BY lam),
a AS (
  SELECT d.*, s.source_size, least(cap::DOUBLE, (SELECT max(lam) FROM levels) * w) AS target,
    md5(coalesce(d.doc_id::VARCHAR, '')) AS h, length(bin(d.size)) AS bits,
    (('0x' || substr(md5('{SEED}' || coalesce(d.source, '')), 1, 8))::BIGINT % {OFFSETS} + 0.5::DOUBLE) / {OFFSETS} AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY source ORDER BY bits, size >> greatest(bits - 4, 0), ('0x' || substr(h, 1, 8))::BIGINT % {SALTS}, size, h, doc_id) AS i
  FROM a)
SELECT doc_id, size, source_size, target,
  (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT * size AS taken,
  (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT AS copies FROM r
"""
