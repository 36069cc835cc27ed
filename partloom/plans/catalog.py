"""Registered queries over the derived catalog, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixture import Catalog, with_tables
from ..functions import columns as C
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import quoting as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


FLAGS = """SELECT p.*, EXISTS (SELECT 1 FROM numbers n WHERE n.part_id = p.part_id AND kind = 'OE') AS has_oe, EXISTS (SELECT 1 FROM numbers n WHERE n.part_id = p.part_id AND kind = 'CROSS') AS has_cross,
  EXISTS (SELECT 1 FROM fitments f WHERE f.part_id = p.part_id) AS has_fitment, EXISTS (SELECT 1 FROM images i WHERE i.part_id = p.part_id AND is_primary) AS has_image,
  EXISTS (SELECT 1 FROM offers o WHERE o.part_id = p.part_id) AS has_offer FROM parts p"""
SCORED = f"""SELECT *, 100 - 10 * (length(trim(name_en)) < 5)::INT - 10 * (category IS NULL)::INT - 20 * (NOT has_oe)::INT - 10 * (NOT has_cross)::INT - 10 * (NOT has_fitment)::INT
  - 15 * (NOT has_image)::INT - 10 * (category IS NULL)::INT - 5 * (pcs_per_carton IS NULL OR gross_grams IS NULL)::INT - 10 * (NOT has_offer)::INT AS score FROM ({FLAGS})"""
FLAG_TABLES = ("parts", "numbers", "fitments", "images", "offers")


def flagged(c: Catalog) -> DataFrame:
    return Q.with_flags(c.parts, c.numbers, c.fitments, c.images, c.offers)


# --- offers and prices -----------------------------------------------------------------------------------------------

BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY cost_cents, lead_days NULLS LAST, offer_id) AS rn FROM offers) WHERE rn = 1"""


@register("g1_best_offer_price", f"SELECT part_id, sku, offer_id, supplier_id, cost_cents, lead_days, (((cost_cents * 125 + 50) // 100) / 100.0)::DECIMAL(18,2)::VARCHAR AS price FROM ({BEST}) JOIN parts USING (part_id)", "parts", "offers")
def best_offer_price(c: Catalog) -> DataFrame:
    best = O.best_offer(c.offers)
    return best.join(c.parts, "part_id").select("part_id", "sku", "offer_id", "supplier_id", "cost_cents", "lead_days", O.suggested_price(F.col("cost_cents")).cast("string").alias("price"))


@register("f6_min_cost", "SELECT part_id, min(cost_cents) AS min_cost_cents FROM parts LEFT JOIN offers USING (part_id) GROUP BY part_id", "parts", "offers")
def min_cost(c: Catalog) -> DataFrame:
    return O.min_cost(c.parts, c.offers)


@register("f11_supplier_offer_counts", "SELECT supplier_id, name, count(offer_id) AS n_offers FROM suppliers LEFT JOIN offers USING (supplier_id) GROUP BY supplier_id, name", "suppliers", "offers")
def supplier_offer_counts(c: Catalog) -> DataFrame:
    return O.supplier_offer_counts(c.suppliers, c.offers)


REQUESTS = "SELECT o_orderkey AS request_id, o_custkey AS inquiry_id, o_orderkey % 2500 AS part_id, (o_orderkey % 40 - 1)::BIGINT AS qty, (o_orderkey % 13) * 10000 - 10000 AS margin_bp FROM orders"
LINES = f"""SELECT r.*, cost_cents, moq, supplier_id, CASE WHEN qty <= 0 THEN 'quantity must be positive' WHEN margin_bp < 0 OR margin_bp >= 100000 THEN 'margin out of range' WHEN cost_cents IS NULL THEN 'no offer' END AS problem,
  CASE WHEN NOT (qty <= 0 OR margin_bp < 0 OR margin_bp >= 100000 OR cost_cents IS NULL) THEN (cost_cents * (10000 + margin_bp) + 5000) // 10000 END AS price_cents
  FROM ({REQUESTS}) r LEFT JOIN ({BEST}) b USING (part_id)"""


def requests(c: Catalog) -> DataFrame:
    k = F.col("o_orderkey")
    return c.read("orders").select(k.alias("request_id"), F.col("o_custkey").alias("inquiry_id"), (k % 2500).alias("part_id"), (k % 40 - 1).alias("qty"), (k % 13 * 10_000 - 10_000).alias("margin_bp"))


@register("k4_build_quotes", f"SELECT request_id, inquiry_id, part_id, qty, margin_bp, cost_cents, supplier_id, problem, price_cents, price_cents * qty AS amount_cents, CASE WHEN problem IS NULL AND qty < moq THEN 'below minimum order' END AS note FROM ({LINES})", "offers")
def build_quotes(c: Catalog) -> DataFrame:
    return O.build_quotes(requests(c), c.offers).drop("moq")


@register("f15_quote_totals", f"SELECT inquiry_id, sum(price_cents * qty)::BIGINT AS total_cents, count(*) AS n_lines FROM ({LINES}) WHERE problem IS NULL GROUP BY inquiry_id", "offers")
def quote_totals(c: Catalog) -> DataFrame:
    return O.quote_totals(O.build_quotes(requests(c), c.offers))


@register("a6_quotation_customer", f"SELECT inquiry_id, request_id, part_id, qty, price_cents, price_cents * qty AS amount_cents, CASE WHEN qty < moq THEN 'below minimum order' END AS note FROM ({LINES}) WHERE problem IS NULL", "offers")
def quotation_customer(c: Catalog) -> DataFrame:
    return O.quotation_rows(O.build_quotes(requests(c), c.offers))


@register("a6_quotation_internal", f"SELECT inquiry_id, request_id, part_id, qty, price_cents, price_cents * qty AS amount_cents, CASE WHEN qty < moq THEN 'below minimum order' END AS note, cost_cents, margin_bp, supplier_id FROM ({LINES}) WHERE problem IS NULL", "offers")
def quotation_internal(c: Catalog) -> DataFrame:
    return O.quotation_rows(O.build_quotes(requests(c), c.offers), internal=True)


# --- inquiries -------------------------------------------------------------------------------------------------------

GAP = 6 * 3600
SETTLED = f"""SELECT i.*, user_id IS NOT NULL AND is_text AND EXISTS (SELECT 1 FROM inquiries j WHERE j.user_id = i.user_id AND j.is_text AND j.ts > i.ts AND j.ts <= i.ts + INTERVAL {GAP} SECOND AND starts_with(j.query_key, i.query_key)) AS superseded FROM inquiries i"""


@register("g6_mark_superseded", f"SELECT inquiry_id, user_id, query_key, superseded FROM ({SETTLED})", "inquiries")
def mark_superseded(c: Catalog) -> DataFrame:
    return O.settled(c.inquiries, GAP).select("inquiry_id", "user_id", "query_key", "superseded")


@register("f5_unmatched_top", f"SELECT query_key, count(*) AS n, max(raw) AS raw, max(ts) AS last_at FROM ({SETTLED}) WHERE is_text AND NOT superseded AND matched_part IS NULL AND ts >= TIMESTAMP '1990-01-01' AND query_key <> '' GROUP BY query_key ORDER BY n DESC, last_at DESC, query_key LIMIT 20", "inquiries")
def unmatched_top(c: Catalog) -> DataFrame:
    return O.unmatched_top(c.inquiries, F.lit("1990-01-01").cast("timestamp"), 20, GAP)


@register("h2_recent_settled", f"SELECT inquiry_id, user_id, ts, query_key FROM ({SETTLED}) WHERE NOT superseded ORDER BY ts DESC, inquiry_id DESC LIMIT 6", "inquiries")
def recent_settled(c: Catalog) -> DataFrame:
    return O.recent_settled(c.inquiries, 6, GAP).select("inquiry_id", "user_id", "ts", "query_key")


@register("d5_list_inquiries", "SELECT inquiry_id, user_id, query_key FROM inquiries WHERE is_text AND matched_part IS NOT NULL", "inquiries")
def list_inquiries(c: Catalog) -> DataFrame:
    return c.inquiries.filter("is_text and matched_part is not null").select("inquiry_id", "user_id", "query_key")


@register("m4_unmatched_daily", "SELECT ts::DATE AS day, query_key, count(*) AS n FROM inquiries WHERE is_text AND matched_part IS NULL GROUP BY 1, 2", "inquiries")
def unmatched_daily(c: Catalog) -> DataFrame:
    rows = c.inquiries.filter("is_text and matched_part is null")
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "query_key").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "query_key", "n")


# --- completeness and duplicates -------------------------------------------------------------------------------------

MISSING_SQL = "array_to_string(list_filter([CASE WHEN length(trim(name_en)) < 5 THEN 'name' END, CASE WHEN category IS NULL THEN 'category' END, CASE WHEN NOT has_oe THEN 'oe' END, CASE WHEN NOT has_cross THEN 'cross' END, CASE WHEN NOT has_fitment THEN 'fitment' END, CASE WHEN NOT has_image THEN 'image' END, CASE WHEN category IS NULL THEN 'attributes' END, CASE WHEN pcs_per_carton IS NULL OR gross_grams IS NULL THEN 'packaging' END, CASE WHEN NOT has_offer THEN 'offer' END], lambda x: x IS NOT NULL), ',')"


@register("f1_completeness", f"SELECT part_id, sku, score, {MISSING_SQL} AS missing FROM ({SCORED})", *FLAG_TABLES)
def completeness(c: Catalog) -> DataFrame:
    return Q.completeness(flagged(c)).select("part_id", "sku", "score", F.array_join("missing", ",").alias("missing"))


@register("f2_recompute", f"SELECT part_id, (part_id % 4 * 25)::INT AS old, score FROM ({SCORED}) WHERE score <> part_id % 4 * 25", *FLAG_TABLES)
def recompute(c: Catalog) -> DataFrame:
    return Q.recompute(flagged(c), c.parts.select("part_id", (F.col("part_id") % 4 * 25).cast("int").alias("old")))


LACKS = {"name": "name_en = ''", "category": "category IS NULL", "oe": "NOT has_oe", "cross": "NOT has_cross", "fitment": "NOT has_fitment", "image": "NOT has_image", "description": "description_en = ''", "packaging": "pcs_per_carton IS NULL AND gross_grams IS NULL", "offer": "NOT has_offer"}
DUPLICATES = "SELECT number_norm, string_agg(part_id::VARCHAR, ',' ORDER BY part_id) AS part_ids, count(*)::INT AS n_parts FROM (SELECT DISTINCT number_norm, part_id FROM numbers WHERE kind IN ('OE', 'CROSS')) GROUP BY number_norm HAVING count(*) > 1"
SUMMARY = f"""SELECT count(*) AS total, round_even(avg(score), 0)::INT AS average, {', '.join(f'count(*) FILTER (WHERE score BETWEEN {lo} AND {hi}) AS bucket_{i}' for i, (lo, hi) in enumerate(Q.BUCKETS))},
  {', '.join(f'count(*) FILTER (WHERE {cond}) AS missing_{i}' for i, cond in LACKS.items())}, round_even(100.0 * count(*) FILTER (WHERE score BETWEEN 90 AND 100) / count(*), 0)::INT AS complete_share,
  (SELECT count(*) FROM ({DUPLICATES})) AS duplicate_groups FROM ({SCORED})"""

for _item, _cond in LACKS.items():
    register(f"d1_missing_{_item}", f"SELECT part_id, sku FROM ({FLAGS}) WHERE {_cond}", *FLAG_TABLES)(lambda c, item=_item: Q.parts_missing(flagged(c), item).select("part_id", "sku"))


@register("d2_reviewed", "SELECT part_id, sku, status FROM parts WHERE status IN ('reviewed', 'published')", "parts")
def reviewed(c: Catalog) -> DataFrame:
    return Q.reviewed(c.parts).select("part_id", "sku", "status")


@register("d3_list_parts", f"SELECT part_id, sku, score FROM ({SCORED}) WHERE NOT has_image AND score BETWEEN 40 AND 75 AND status = 'reviewed'", *FLAG_TABLES)
def list_parts(c: Catalog) -> DataFrame:
    return Q.list_parts(flagged(c), "image", 40, 75, "reviewed").select("part_id", "sku", "score")


@register("d4_export_eligible", "SELECT part_id, sku, status <> 'draft' AND has_image AS eligible, concat_ws('; ', CASE WHEN status = 'draft' THEN 'not reviewed' END, CASE WHEN NOT has_image THEN 'no main image' END) AS reasons FROM (SELECT *, EXISTS (SELECT 1 FROM images i WHERE i.part_id = p.part_id AND is_primary) AS has_image FROM parts p)", "parts", "images")
def export_eligible(c: Catalog) -> DataFrame:
    return Q.export_eligible(c.parts, c.images)


@register("f3_quality_summary", SUMMARY, *FLAG_TABLES)
def quality_summary(c: Catalog) -> DataFrame:
    return Q.quality_summary(flagged(c), c.numbers)


@register("f14_top_missing", f"SELECT item, n, round_even(100.0 * n / total, 0)::INT AS percent FROM (SELECT total, unnest([{', '.join(repr(i) for i in LACKS)}]) AS item, unnest([{', '.join('missing_' + i for i in LACKS)}]) AS n FROM ({SUMMARY})) ORDER BY n DESC, item LIMIT 4", *FLAG_TABLES)
def top_missing(c: Catalog) -> DataFrame:
    return Q.top_missing(Q.quality_summary(flagged(c), c.numbers))


@register("f4_duplicate_groups", DUPLICATES, "numbers")
def duplicate_groups(c: Catalog) -> DataFrame:
    return Q.duplicate_groups(c.numbers).withColumn("part_ids", F.array_join(F.transform("part_ids", lambda x: x.cast("string")), ","))


@register("e8_alternatives", f"SELECT DISTINCT a.part_id, b.part_id AS other_id, s.score, s.sku FROM numbers a JOIN numbers b USING (number_norm) JOIN ({SCORED}) s ON s.part_id = b.part_id WHERE a.part_id <> b.part_id", *FLAG_TABLES)
def alternatives(c: Catalog) -> DataFrame:
    return Q.alternatives(c.numbers, Q.completeness(flagged(c)))


@register("e9_has_offer", "SELECT part_id, EXISTS (SELECT 1 FROM offers o WHERE o.part_id = p.part_id) AS has_offer FROM parts p", "parts", "offers")
def has_offer(c: Catalog) -> DataFrame:
    return Q.has_related(c.parts, c.offers, "has_offer").select("part_id", "has_offer")


@register(
    "e10_part_cards",
    """SELECT part_id, sku, (SELECT string_agg(kind || '=' || number, ',' ORDER BY kind, number) FROM numbers n WHERE n.part_id = p.part_id) AS numbers, (SELECT string_agg(make || ' ' || model, ',') FROM fitments f WHERE f.part_id = p.part_id) AS fitments,
  (SELECT string_agg(image_id::VARCHAR, ',' ORDER BY is_primary DESC, image_id) FROM images i WHERE i.part_id = p.part_id) AS images, (SELECT string_agg(offer_id::VARCHAR, ',' ORDER BY cost_cents, lead_days NULLS LAST, offer_id) FROM offers o WHERE o.part_id = p.part_id) AS offers FROM parts p""",
    "parts", "numbers", "fitments", "images", "offers",
)
def part_cards(c: Catalog) -> DataFrame:
    cards = Q.part_cards(c.parts, c.numbers, c.fitments, c.images, c.offers)
    join = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return cards.select("part_id", "sku", join("numbers", lambda x: F.concat_ws("=", x["kind"], x["number"])), join("fitments", lambda x: F.concat_ws(" ", x["make"], x["model"])), join("images", lambda x: x["image_id"].cast("string")), join("offers", lambda x: x["offer_id"].cast("string")))


@register("g8_primary_image", "SELECT part_id, min(image_id) FILTER (WHERE is_primary) AS image_id FROM images GROUP BY part_id", "images")
def primary_image(c: Catalog) -> DataFrame:
    return c.images.groupBy("part_id").agg(F.min(F.when(F.col("is_primary"), F.col("image_id"))).alias("image_id"))


# --- matching --------------------------------------------------------------------------------------------------------

#: Queries made from the numbers: as typed, cut short, with a suffix, with two characters swapped, and by SKU and name.
ASKED = """SELECT part_id * 10 AS query_id, CASE part_id % 5 WHEN 0 THEN number WHEN 1 THEN number_norm WHEN 2 THEN number_norm || '-1' WHEN 3 THEN substr(number_norm, 1, 5) || substr(number_norm, 7, 1) || substr(number_norm, 6, 1) ELSE 'oe: ' || substr(number_norm, 2) END AS raw FROM numbers WHERE kind = 'OE' AND part_id % 3 = 0
  UNION ALL SELECT part_id * 10 + 1, CASE part_id % 2 WHEN 0 THEN sku ELSE 'sku:' || lower(substr(sku, 1, 11)) END FROM parts WHERE part_id % 7 = 0 UNION ALL SELECT part_id * 10 + 2, 'name: ' || name_en FROM parts WHERE part_id % 50 = 1"""
PARSED = f"""SELECT query_id, raw, text, upper(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS norm, CASE WHEN lower(raw) LIKE 'sku:%' THEN 'sku' WHEN lower(raw) LIKE 'oe:%' THEN 'number' WHEN lower(raw) LIKE 'name:%' THEN 'text'
  WHEN NOT regexp_matches(text, '[0-9]') THEN 'text' WHEN starts_with(upper(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')), 'FIT') THEN 'sku' ELSE 'number' END AS kind
  FROM (SELECT query_id, raw, trim(regexp_replace(translate(raw, '０１２３４５６７８９', '0123456789'), '^(sku|oe|name):', '')) AS text FROM ({ASKED}))"""


def asked(c: Catalog) -> DataFrame:
    k, norm, number = F.col("part_id"), F.col("number_norm"), F.col("number")
    cut = lambda *a: F.substring("number_norm", *a)
    raw = F.when(k % 5 == 0, number).when(k % 5 == 1, norm).when(k % 5 == 2, F.concat(norm, F.lit("-1"))).when(k % 5 == 3, F.concat(cut(1, 5), cut(7, 1), cut(6, 1))).otherwise(F.concat(F.lit("oe: "), cut(2, 30)))
    rows = c.numbers.filter((F.col("kind") == "OE") & (k % 3 == 0)).select((k * 10).alias("query_id"), raw.alias("raw"))
    sku = F.when(k % 2 == 0, F.col("sku")).otherwise(F.concat(F.lit("sku:"), F.lower(F.substring("sku", 1, 11))))
    rows = rows.unionByName(c.parts.filter(k % 7 == 0).select((k * 10 + 1).alias("query_id"), sku.alias("raw")))
    return rows.unionByName(c.parts.filter(k % 50 == 1).select((k * 10 + 2).alias("query_id"), F.concat(F.lit("name: "), F.col("name_en")).alias("raw")))


def numbers_(c: Catalog) -> DataFrame:
    return c.numbers.withColumnRenamed("kind", "kind_n")


EXACT = f"SELECT query_id, part_id, CASE WHEN number = trim(regexp_replace(raw, '^(sku|oe|name):\\s*', '')) THEN 0 ELSE 1 END AS level, CASE WHEN number = trim(regexp_replace(raw, '^(sku|oe|name):\\s*', '')) THEN 1000 ELSE 950 END AS milli, number, n.kind AS number_kind FROM ({PARSED}) q JOIN numbers n ON norm = number_norm WHERE q.kind = 'number' AND norm <> ''"
CONTAINED = f"""SELECT query_id, part_id, 2 AS level, round_even(0.8 * least(length(norm), length(number_norm)) / greatest(length(norm), length(number_norm)) * 1000, 0)::INT AS milli, number, kn AS number_kind FROM (
  SELECT q.query_id, norm, n.part_id, n.number, n.number_norm, n.kind AS kn, row_number() OVER (PARTITION BY query_id ORDER BY length(number_norm), number_norm, part_id, n.kind) AS rn FROM ({PARSED}) q JOIN numbers n
  ON norm <> number_norm AND ((length(number_norm) >= 5 AND contains(norm, number_norm)) OR (length(norm) >= 5 AND contains(number_norm, norm))) WHERE q.kind = 'number' AND norm <> '') WHERE rn <= 60"""
TRI = lambda x: f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || lower({x}) || ' ', i, 3)))"
SIMILAR = f"""SELECT query_id, part_id, 3 AS level, round_even(s * 1000, 0)::INT AS milli, number, kn AS number_kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, number_norm, part_id, kn) AS rn FROM (
  SELECT query_id, norm, part_id, number, number_norm, n.kind AS kn, len(list_intersect(qt, nt))::DOUBLE / (len(qt) + len(nt) - len(list_intersect(qt, nt))) AS s
  FROM (SELECT *, {TRI('norm')} AS qt FROM ({PARSED}) WHERE kind = 'number' AND length(norm) >= 3) q JOIN (SELECT *, {TRI('number_norm')} AS nt FROM numbers) n ON norm <> number_norm) WHERE s >= 0.45) WHERE rn <= 60"""
SKU = f"""SELECT query_id, part_id, 0 AS level, 1000 AS milli, sku AS number, 'SKU' AS number_kind FROM ({PARSED}) q JOIN parts ON lower(text) = lower(sku) WHERE q.kind = 'sku'
  UNION ALL SELECT query_id, part_id, 2, 800, sku, 'SKU' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sku) AS rn FROM ({PARSED}) q JOIN parts ON starts_with(lower(sku), lower(text)) WHERE q.kind = 'sku' AND text <> '' AND NOT EXISTS (SELECT 1 FROM parts p WHERE lower(p.sku) = lower(text))) WHERE rn <= 20"""
NAME = f"""SELECT query_id, part_id, 4 AS level, 700 AS milli, NULL::VARCHAR AS number, NULL::VARCHAR AS number_kind FROM (SELECT DISTINCT query_id, token, part_id, n FROM (
  SELECT query_id, unnest(tokens) AS token, len(tokens) AS n FROM (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(replace(text, ',', ' ')), '\\s+'), lambda t: t <> '')) AS tokens FROM ({PARSED}) WHERE kind = 'text')) t
  JOIN (SELECT part_id, lower(name_en) AS f FROM parts UNION SELECT part_id, lower(category) FROM parts UNION SELECT part_id, lower(model) FROM fitments UNION SELECT part_id, lower(make) FROM fitments) x ON contains(f, token)) GROUP BY query_id, part_id, n HAVING count(*) = n"""
COLS = ("query_id", "part_id", "level", "milli", "number", "number_kind")


def parsed(c: Catalog, kind: str | None = None) -> DataFrame:
    q = M.queries_of(asked(c))
    return q if kind is None else q.filter(F.col("kind") == kind)


@register("c3_query_kind", f"SELECT query_id, text, norm, kind FROM ({PARSED}) WHERE norm <> '' OR text <> ''", "parts", "numbers")
def query_kind(c: Catalog) -> DataFrame:
    return parsed(c).select("query_id", "text", "norm", "kind")


@register("e1_match_exact", EXACT, "parts", "numbers")
def match_exact(c: Catalog) -> DataFrame:
    return M.match_exact(parsed(c, "number"), numbers_(c)).select(*COLS)


@register("e2_match_contained", CONTAINED, "parts", "numbers")
def match_contained(c: Catalog) -> DataFrame:
    return M.match_contained(parsed(c, "number"), numbers_(c)).select(*COLS)


@register("e3_match_similar", SIMILAR, "parts", "numbers")
def match_similar(c: Catalog) -> DataFrame:
    return M.match_similar(parsed(c, "number"), numbers_(c)).select(*COLS)


@register("e5_match_sku", SKU, "parts", "numbers")
def match_sku(c: Catalog) -> DataFrame:
    return M.match_sku(parsed(c, "sku"), c.parts).select(*COLS)


@register("e6_match_name", NAME, "parts", "numbers", "fitments")
def match_name(c: Catalog) -> DataFrame:
    return M.match_name(parsed(c, "text"), c.parts, c.fitments).select(*COLS)


MATCHED = f"""SELECT query_id, part_id, level, milli, number, number_kind, row_number() OVER (PARTITION BY query_id ORDER BY level, milli DESC, score DESC, sku, number NULLS FIRST, number_kind NULLS FIRST) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, part_id ORDER BY level, milli DESC, score DESC, sku, number NULLS FIRST, number_kind NULLS FIRST) AS rn FROM (
    WITH x AS MATERIALIZED ({EXACT}), g AS (SELECT query_id, count(*) AS n, count(DISTINCT part_id) AS np FROM x GROUP BY query_id),
    y AS MATERIALIZED (SELECT c.* FROM ({CONTAINED}) c LEFT JOIN g USING (query_id) WHERE coalesce(np, 0) <> 1 AND coalesce(n, 0) < 20),
    h AS (SELECT query_id, count(DISTINCT part_id) AS now FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY query_id),
    z AS (SELECT s.* FROM ({SIMILAR}) s LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id) WHERE coalesce(np, 0) <> 1 AND coalesce(now, 0) < 20)
    SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z UNION ALL {SKU} UNION ALL {NAME}) JOIN (SELECT part_id, score, sku FROM ({SCORED})) USING (part_id)) WHERE rn = 1 QUALIFY rank <= 20"""


def matched(c: Catalog) -> DataFrame:
    return M.match_queries(parsed(c), c.parts, numbers_(c), c.fitments, Q.completeness(flagged(c)))


@register("k1_match_queries", MATCHED, *FLAG_TABLES)
def match_queries(c: Catalog) -> DataFrame:
    return matched(c).select(*COLS, "rank")


#: A photo of every part: a number with unreadable places where it is the part's own, a name, and a brand that may be wrong.
TYPED = "part_id % 5 <> 4 AND name_en <> ''"
WITH_BRAND = f"SELECT part_id AS query_id, 'name: ' || name_en || ' ' || CASE part_id % 3 WHEN 0 THEN make ELSE 'Nosuch' END AS raw FROM parts WHERE part_id % 3 <> 2 AND {TYPED}"
WITHOUT_BRAND = f"SELECT part_id AS query_id, 'name: ' || name_en AS raw FROM parts WHERE {TYPED}"
PHOTOS = f"""WITH n AS MATERIALIZED (SELECT p.part_id AS query_id, n.part_id, CASE WHEN number = number_norm THEN 0 ELSE 1 END AS level, CASE WHEN number = number_norm THEN 1000 ELSE 950 END AS milli, number, n.kind AS number_kind FROM parts p JOIN numbers n ON n.part_id = p.part_id AND n.kind = 'OE' WHERE p.part_id % 4 < 2 AND p.part_id % 10 BETWEEN 1 AND 8),
  t AS MATERIALIZED ({NAME.replace(ASKED, WITH_BRAND)}), u AS MATERIALIZED ({NAME.replace(ASKED, WITHOUT_BRAND)}), every AS (SELECT * FROM n UNION ALL SELECT * FROM t WHERE query_id NOT IN (SELECT query_id FROM n) UNION ALL SELECT * FROM u WHERE query_id NOT IN (SELECT query_id FROM n) AND query_id NOT IN (SELECT query_id FROM t))
  SELECT query_id AS finding_id, part_id, level, milli, number, number_kind, row_number() OVER (PARTITION BY query_id ORDER BY level, milli DESC, score DESC, sku) AS rank FROM every JOIN (SELECT part_id, score, sku FROM ({SCORED})) USING (part_id) QUALIFY rank <= 20"""


@register("e17_photo_candidates", PHOTOS, *FLAG_TABLES)
def photo_candidates(c: Catalog) -> DataFrame:
    k = F.col("part_id")
    own = c.numbers.filter("kind = 'OE'").select("part_id", F.col("number_norm").alias("norm"))
    spoiled = F.concat(F.lit("?"), F.substring("norm", 1, 3), F.lit("?"), F.substring("norm", 4, 30))
    shown = F.when((k % 4 < 2) & (k % 10).between(1, 8), F.array(F.lit("??"), spoiled)).when(k % 2 == 0, F.array(F.lit(" ? ")))
    kind = F.when(k % 5 == 4, "unknown").otherwise(F.col("name_en"))
    hints = F.when(k % 3 == 0, F.array("make", F.lit("Nosuch"))).when(k % 3 == 1, F.array(F.lit("Nosuch")))
    findings = c.parts.join(own, "part_id").select(k.alias("finding_id"), shown.alias("visible_numbers"), kind.alias("part_type"), hints.alias("brand_hints"))
    return M.photo_candidates(findings, c.parts, numbers_(c), c.fitments, Q.completeness(flagged(c))).select("finding_id", *COLS[1:], "rank")


@register("k2_log_inquiries", f"SELECT query_id, raw, regexp_replace(lower(text), '[\\s\\-_./]+', '', 'g') AS query_key, coalesce(n_hits, 0) AS n_hits, matched_part, found FROM ({PARSED}) LEFT JOIN (SELECT query_id, count(*) AS n_hits, min(part_id) FILTER (WHERE rank = 1) AS matched_part, string_agg(part_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS found FROM ({MATCHED}) GROUP BY query_id) USING (query_id) WHERE norm <> '' OR text <> ''", *FLAG_TABLES)
def log_inquiries(c: Catalog) -> DataFrame:
    return M.log_inquiries(parsed(c), matched(c)).withColumn("found", F.array_join(F.transform("found", lambda x: x["part_id"].cast("string")), ","))


# --- column jobs over the catalog's texts ----------------------------------------------------------------------------


@register("c1_number_norm", "SELECT part_id, kind, number, number_norm FROM numbers", "numbers")
def number_norm(c: Catalog) -> DataFrame:
    return c.numbers.select("part_id", "kind", "number", C.full_norm(F.col("number")).alias("number_norm"))


@register(
    "c2_split_numbers",
    """SELECT part_id, CASE part_id % 3 WHEN 0 THEN h || '|X' || number_norm WHEN 1 THEN number_norm || '|' || number_norm || '9' ELSE 'WK ' || part_id::VARCHAR || '/7' END AS numbers
  FROM (SELECT *, translate(number, '０１２３４５６７８９', '0123456789') AS h FROM numbers WHERE kind = 'OE')""",
    "numbers",
)
def split_numbers(c: Catalog) -> DataFrame:
    k, n, norm = F.col("part_id"), F.col("number"), F.col("number_norm")
    cell = F.when(k % 3 == 0, F.concat(n, F.lit(", "), norm, F.lit(";X"), norm)).when(k % 3 == 1, F.concat(norm, F.lit("/"), norm, F.lit("9"))).otherwise(F.concat(F.lit("WK "), k.cast("string"), F.lit("/7")))
    return c.numbers.filter("kind = 'OE'").select("part_id", F.array_join(C.split_numbers(cell), "|").alias("numbers"))


@register("c4_brand_hints", f"SELECT part_id, kind, concat_ws('|', {', '.join(f'''CASE WHEN regexp_matches(number_norm, '{p}') THEN '{b}' END''' for b, p in C.BRAND_FORMATS)}) AS hints FROM numbers", "numbers")
def brand_hints(c: Catalog) -> DataFrame:
    return c.numbers.select("part_id", "kind", F.array_join(C.brand_hints(F.col("number")), "|").alias("hints"))


@register("c7_decimal", "SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 3 WHEN 0 THEN l_quantity::INT + 0.5 WHEN 1 THEN 1000 + l_quantity::INT + 0.25 ELSE l_quantity::INT END)::DECIMAL(18,4)::VARCHAR AS value FROM lineitem")
def decimal(c: Catalog) -> DataFrame:
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = F.when(n % 3 == 0, F.concat(q, F.lit(",5"))).when(n % 3 == 1, F.concat(F.lit("USD 1,"), F.lpad(q, 3, "0"), F.lit(".25 each"))).otherwise(F.concat(F.lit("-"), q))
    return c.read("lineitem").select("l_orderkey", "l_linenumber", C.decimal_of(text).cast("string").alias("value"))


@register("c11_lead_days", "SELECT l_orderkey, l_linenumber, l_linenumber * CASE l_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 1 END AS days FROM lineitem")
def lead_days(c: Catalog) -> DataFrame:
    text = F.concat(F.lit("1-"), F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 3 == 0, " weeks").when(F.col("l_orderkey") % 3 == 1, " months").otherwise(" days"))
    return c.read("lineitem").select("l_orderkey", "l_linenumber", C.lead_days(text).cast("int").alias("days"))


@register("c12_packing", "SELECT p_partkey, p_size / 10.0::DOUBLE AS l_cm, 20.0::DOUBLE AS w_cm, 30.5::DOUBLE AS h_cm, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS weight_kg, NULL::INT AS pcs FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, p_size FROM part WHERE p_partkey % 3 = 0")
def packing(c: Catalog) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    boxed = F.concat(size, F.lit("x200x305mm"), F.when(k % 2 == 0, F.concat(F.lit(" / "), size, F.lit(" kg"))).otherwise(""))
    return c.read("part").select("p_partkey", C.packing(F.when(k % 3 == 0, F.concat(size, F.lit(" pcs/ctn"))).otherwise(boxed)).alias("p")).select("p_partkey", "p.*")


@register("c13_years", "SELECT p_partkey, CASE WHEN 30 + p_size <= 40 THEN 2030 + p_size WHEN 30 + p_size < 100 THEN 1930 + p_size ELSE 30 + p_size END AS year_from, CASE WHEN p_partkey % 2 = 0 THEN 2000 + p_size END AS year_to FROM part")
def years(c: Catalog) -> DataFrame:
    text = F.concat((F.col("p_size") + 30).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), (F.col("p_size") + 2000).cast("string"))).otherwise("+"))
    return c.read("part").select("p_partkey", C.years_v1(text).alias("y")).select("p_partkey", "y.*")


@register("c16_dims", "SELECT p_partkey, (p_size / 10.0)::DECIMAL(8,2)::VARCHAR AS l, '12.34' AS w, '20.00' AS h FROM part")
def dims(c: Catalog) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    cell = F.when(k % 2 == 0, F.concat(size.cast("string"), F.lit(" x 123.4 x 200 mm"))).otherwise(F.concat((size / 10.0).cast("string"), F.lit("*12.34*20")))
    return c.read("part").select("p_partkey", C.dims_cm(cell, F.when(k % 2 == 0, "Carton").otherwise("Package (cm)")).alias("d")).select("p_partkey", *(F.col(f"d.{x}").cast("string").alias(x) for x in "lwh"))


@register("c17_moq", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::INT END AS moq FROM lineitem")
def moq(c: Catalog) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    return c.read("lineitem").select("l_orderkey", "l_linenumber", C.moq(F.when(F.col("l_linenumber") % 4 == 0, F.concat(q, F.lit(".5"))).otherwise(F.concat(q, F.lit(" pcs")))).alias("moq"))


@register("c18_quote_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 AND day(o_orderdate) <= 12 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def quote_date(c: Catalog) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(k % 4 == 2, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return c.read("orders").select("o_orderkey", C.quote_date(text).alias("day"))


@register("c22_scientific", "SELECT p_partkey, p_partkey % 3 = 0 AS spoiled FROM part")
def scientific(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    return c.read("part").select("p_partkey", C.is_scientific(F.when(k % 3 == 0, F.concat(F.lit("9."), k.cast("string"), F.lit("E+08"))).otherwise(k.cast("string"))).alias("spoiled"))


@register("c24_query_key", f"SELECT query_id, regexp_replace(lower(text), '[\\s\\-_./]+', '', 'g') AS query_key FROM ({PARSED})", "parts", "numbers")
def query_key(c: Catalog) -> DataFrame:
    return asked(c).select("query_id", C.query_key(F.col("raw")).alias("query_key"))
