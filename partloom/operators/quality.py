"""Completeness, missing data and duplicates of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of the completeness score, and its buckets with both ends.
WEIGHTS = {"name": 10, "category": 10, "oe": 20, "cross": 10, "fitment": 10, "image": 15, "attributes": 10, "packaging": 5, "offer": 10}
BUCKETS = ((0, 39), (40, 69), (70, 89), (90, 100))
MISSING = ("name", "category", "oe", "cross", "fitment", "image", "description", "packaging", "offer")


def has_related(parts: DataFrame, child: DataFrame, name: str) -> DataFrame:
    """Parts with a flag that says whether child has a row of the part. The child is reduced to its ids first."""
    ids = child.select(F.col("part_id").alias("__id")).distinct()
    return parts.join(ids, parts["part_id"] == ids["__id"], "left").withColumn(name, F.col("__id").isNotNull()).drop("__id")


def with_flags(parts: DataFrame, numbers: DataFrame, fitments: DataFrame, images: DataFrame, offers: DataFrame) -> DataFrame:
    """What completeness and the missing-data filters ask of the related tables: one pass over numbers for both kinds."""
    kinds = numbers.groupBy("part_id").agg(F.bool_or(F.col("kind") == "OE").alias("has_oe"), F.bool_or(F.col("kind") == "CROSS").alias("has_cross"))
    out = parts.join(kinds, "part_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_oe", "has_cross")})
    for child, name in ((fitments, "has_fitment"), (images.filter("is_primary"), "has_image"), (offers, "has_offer")):
        out = has_related(out, child, name)
    return out


def present(item: str) -> Column:
    """Whether a scored item is there. Attributes count as there wherever a category is: the fixture requires none."""
    return {
        "name": F.length(F.trim("name_en")) >= 5, "category": F.col("category").isNotNull(), "oe": F.col("has_oe"), "cross": F.col("has_cross"),
        "fitment": F.col("has_fitment"), "image": F.col("has_image"), "attributes": F.col("category").isNotNull(),
        "packaging": F.col("pcs_per_carton").isNotNull() & F.col("gross_grams").isNotNull(), "offer": F.col("has_offer"),
    }[item]


def completeness(flagged: DataFrame) -> DataFrame:
    """F1: part_id, sku, score and the missing items in the order of the weights."""
    missing = F.array_compact(F.array(*(F.when(~present(i), F.lit(i)) for i in WEIGHTS)))
    score = sum(F.when(present(i), w).otherwise(0) for i, w in WEIGHTS.items())
    return flagged.select("*", score.cast("int").alias("score"), missing.alias("missing"))


def recompute(flagged: DataFrame, stored: DataFrame) -> DataFrame:
    """F2: (part_id, old, score) of the parts whose stored score (part_id, old) is another."""
    now = completeness(flagged).select("part_id", "score")
    return now.join(stored, "part_id").filter(~F.col("score").eqNullSafe(F.col("old"))).select("part_id", "old", "score")


def lacks(item: str) -> Column:
    """The missing-data filters; their name and packaging rules differ from the score's."""
    rules = {
        "name": F.col("name_en") == "", "category": F.col("category").isNull(), "oe": ~F.col("has_oe"), "cross": ~F.col("has_cross"), "fitment": ~F.col("has_fitment"),
        "image": ~F.col("has_image"), "description": F.col("description_en") == "", "packaging": F.col("pcs_per_carton").isNull() & F.col("gross_grams").isNull(), "offer": ~F.col("has_offer"),
    }
    if item not in rules:
        raise ValueError(f"unknown missing item {item!r}; one of {list(rules)}")
    return rules[item]


def parts_missing(flagged: DataFrame, item: str) -> DataFrame:
    """D1."""
    return flagged.filter(lacks(item))


def reviewed(parts: DataFrame) -> DataFrame:
    """Seen by a person, the published ones included."""
    return parts.filter(F.col("status").isin("reviewed", "published"))


def list_parts(flagged: DataFrame, item: str | None = None, low: int = 0, high: int = 100, status: str | None = None, category: str | None = None) -> DataFrame:
    """D3: all conditions hold, score ends inclusive."""
    out = completeness(flagged if item is None else parts_missing(flagged, item)).filter(F.col("score").between(low, high))
    out = out if status is None else out.filter(F.col("status") == status)
    return out if category is None else out.filter(F.col("category") == category)


def export_eligible(parts: DataFrame, images: DataFrame) -> DataFrame:
    """part_id, eligible and the reasons against."""
    marked = has_related(parts, images.filter("is_primary"), "has_image")
    reasons = F.array_compact(F.array(F.when(F.col("status") == "draft", "not reviewed"), F.when(~F.col("has_image"), "no main image")))
    return marked.select("part_id", "sku", (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, "; ").alias("reasons"))


def duplicate_groups(numbers: DataFrame) -> DataFrame:
    """number_norm on more than one part, with the parts in order."""
    return numbers.filter(F.col("kind").isin("OE", "CROSS")).groupBy("number_norm").agg(F.array_sort(F.collect_set("part_id")).alias("part_ids")).filter(F.size("part_ids") > 1).withColumn("n_parts", F.size("part_ids"))


def quality_summary(flagged: DataFrame, numbers: DataFrame) -> DataFrame:
    """one row of totals, buckets, missing counts and duplicate groups; one pass over the parts."""
    scored = completeness(flagged)
    buckets = [F.count_if(F.col("score").between(lo, hi)).alias(f"bucket_{i}") for i, (lo, hi) in enumerate(BUCKETS)]
    counts = [F.count_if(lacks(i)).alias(f"missing_{i}") for i in MISSING]
    row = scored.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.bround(F.avg("score")), F.lit(0)).cast("int").alias("average"), *buckets, *counts)
    share = F.when(F.col("total") > 0, F.bround(100 * F.col(f"bucket_{len(BUCKETS) - 1}") / F.col("total"))).otherwise(0).cast("int")
    groups = duplicate_groups(numbers).agg(F.count(F.lit(1)).alias("duplicate_groups"))
    return row.withColumn("complete_share", share).join(groups)  # one row each


def top_missing(summary: DataFrame, n: int = 4) -> DataFrame:
    """the n most frequent missing items with their percentage."""
    stacked = summary.select("total", F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"missing_{i}").alias("n")) for i in MISSING))).alias("m"))
    return stacked.select("m.item", "m.n", F.bround(100 * F.col("m.n") / F.col("total")).cast("int").alias("percent")).orderBy(F.desc("n"), "item").limit(n)


def alternatives(numbers: DataFrame, scored: DataFrame) -> DataFrame:
    """(part_id, other_id) sharing an OE or cross number of any kind, with the other's score and sku."""
    n = numbers.filter(F.col("kind").isin("OE", "CROSS")).select("part_id", "number_norm").distinct()
    pairs = n.alias("a").join(n.alias("b"), "number_norm").filter("a.part_id <> b.part_id").select(F.col("a.part_id").alias("part_id"), F.col("b.part_id").alias("other_id")).distinct()
    return pairs.join(scored.select(F.col("part_id").alias("other_id"), "score", "sku"), "other_id")


def part_cards(parts: DataFrame, numbers: DataFrame, fitments: DataFrame, images: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per part with its numbers, fitments, images and offers nested, each in its order."""
    nest = lambda df, name, *cols: df.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = parts.select("part_id", "sku")
    for table in (
        nest(numbers, "numbers", "kind", "number"), nest(fitments, "fitments", "make", "model", "year_from", "year_to"),
        nest(images.withColumn("later", ~F.col("is_primary")), "images", "later", "image_id"), nest(offers.withColumn("no_lead", F.col("lead_days").isNull()), "offers", "cost_cents", "no_lead", "lead_days", "offer_id"),
    ):
        out = out.join(table, "part_id", "left")
    return out
