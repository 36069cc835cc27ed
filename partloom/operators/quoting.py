"""Offers, prices, quotations and inquiries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_offer(offers: DataFrame) -> DataFrame:
    """G1: per part the cheapest offer, then the shortest lead time (none last), then the smallest id.

    A minimum over a struct: partial aggregates meet in one shuffle, no part's offers are ever sorted together.
    """
    order = F.struct("cost_cents", F.col("lead_days").isNull().alias("no_lead"), "lead_days", "offer_id", "supplier_id", "quoted_at", "moq")
    return offers.groupBy("part_id").agg(F.min(order).alias("best")).select("part_id", "best.offer_id", "best.supplier_id", "best.cost_cents", "best.lead_days", "best.quoted_at", "best.moq")


def suggested_price(cost_cents: Column, margin: str = "0.25") -> Column:
    """K3: cost * (1 + margin), half up to cents; decimals only; null cost gives null."""
    cost = cost_cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")
    return F.round(cost.cast("decimal(18,2)") * (F.lit(1).cast("decimal(3,0)") + F.lit(margin).cast("decimal(5,4)")), 2).cast("decimal(18,2)")


def min_cost(parts: DataFrame, offers: DataFrame) -> DataFrame:
    """every part with its cheapest cost, null without offers."""
    return parts.select("part_id").join(offers.groupBy("part_id").agg(F.min("cost_cents").alias("min_cost_cents")), "part_id", "left")


def supplier_offer_counts(suppliers: DataFrame, offers: DataFrame) -> DataFrame:
    """suppliers without offers count 0."""
    n = offers.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n_offers"))
    return suppliers.join(n, "supplier_id", "left").withColumn("n_offers", F.coalesce("n_offers", F.lit(0)))


def build_quotes(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """K4: requests (request_id, part_id, qty, margin_bp) to quote lines with snapshots, or a reason against.

    The quantity must be positive, the margin at least 0 and under 10 (in basis points: 100000), and an offer must exist.
    """
    best = best_offer(offers).select(F.col("part_id").alias("__part"), "cost_cents", "moq", "supplier_id")
    lines = requests.join(best, requests["part_id"] == best["__part"], "left").drop("__part")
    problem = F.when(F.col("qty") <= 0, "quantity must be positive").when((F.col("margin_bp") < 0) | (F.col("margin_bp") >= 100_000), "margin out of range").when(F.col("cost_cents").isNull(), "no offer")
    price = F.round(F.col("cost_cents").cast("decimal(18,0)") * (F.col("margin_bp") + 10_000).cast("decimal(10,0)") / F.lit(10_000).cast("decimal(10,0)"), 0).cast("long")
    ok = F.col("problem").isNull()
    return lines.withColumn("problem", problem).withColumn("price_cents", F.when(ok, price)).withColumn("amount_cents", F.when(ok, price * F.col("qty"))).withColumn("note", F.when(ok & (F.col("qty") < F.col("moq")), "below minimum order"))


def quote_totals(lines: DataFrame) -> DataFrame:
    """total of the accepted lines per inquiry."""
    return lines.filter("problem is null").groupBy("inquiry_id").agg(F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("n_lines"))


def settled(inquiries: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Inquiries with superseded: the same user's later text search, within the gap, goes on from this one's key.

    The window holds a user's next gap_seconds only. Searches without a user, and photos, are never superseded.
    """
    ahead = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, gap_seconds * 1_000_000)
    later = F.collect_list(F.when(F.col("is_text"), F.col("query_key"))).over(ahead)
    goes_on = F.exists(later, lambda k: F.startswith(k, F.col("query_key")))
    return inquiries.withColumn("superseded", F.col("user_id").isNotNull() & F.col("is_text") & goes_on)


def unmatched_top(inquiries: DataFrame, since: Column, limit: int = 20, gap_seconds: int = 60) -> DataFrame:
    """settled text searches without a match since a time, by key: count, greatest raw form, last time."""
    rows = settled(inquiries, gap_seconds).filter("is_text and not superseded and matched_part is null").filter((F.col("ts") >= since) & (F.col("query_key") != ""))
    grouped = rows.groupBy("query_key").agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw"), F.max("ts").alias("last_at"))
    return grouped.orderBy(F.desc("n"), F.desc("last_at"), "query_key").limit(limit)


def recent_settled(inquiries: DataFrame, limit: int = 6, gap_seconds: int = 60) -> DataFrame:
    """H2: the newest searches that stand."""
    return settled(inquiries, gap_seconds).filter("not superseded").orderBy(F.desc("ts"), F.desc("inquiry_id")).limit(limit)


def quotation_rows(lines: DataFrame, internal: bool = False) -> DataFrame:
    """What the customer sees; cost and supplier only for the permitted internal sheet."""
    shown = ["inquiry_id", "request_id", "part_id", "qty", "price_cents", "amount_cents", "note"]
    return lines.filter("problem is null").select(*shown, *(["cost_cents", "margin_bp", "supplier_id"] if internal else []))
