"""Registered queries for suggestions, review queues, record search, vehicles, prices and column mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixture import Catalog
from ..functions import columns as C
from ..operators import archive as A
from ..operators import matching as M
from ..operators import review as R
from ..sources import grid as G
from .archive import CURRENT
from .catalog import register
from .standardize import _attributes, _schemas

def key(name: str = "p_partkey") -> Column:
    return F.col(name)


@register("c10_price", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 0.25 END::DECIMAL(18,4) AS amount, CASE WHEN p_partkey % 4 = 2 THEN 'unreadable price: on request' END AS warning FROM part")
def price(c: Catalog) -> DataFrame:
    size = F.col("p_size")
    rows = c.read("part").select("p_partkey", F.when(key() % 4 == 0, size + 0.5).alias("number"), F.when(key() % 4 == 1, F.concat(F.lit("US$ "), size.cast("string"), F.lit(",25"))).when(key() % 4 == 2, "on request").otherwise("").alias("text"))
    return rows.select("p_partkey", F.inline(F.array(R.price(F.col("number"), F.col("text")))))


@register("c15_vehicles", """SELECT p_partkey, 0 AS place, CASE p_partkey % 4 WHEN 0 THEN 'Volvo' WHEN 1 THEN 'Volvo' WHEN 2 THEN 'Sino' ELSE 'Nobrand X' || p_size END AS make,
  CASE p_partkey % 4 WHEN 0 THEN 'FH' || p_size WHEN 1 THEN 'FM' ELSE '' END AS model FROM part UNION ALL SELECT p_partkey, 1, 'Volvo', 'FM' || p_size FROM part WHERE p_partkey % 4 = 0""")  # fmt: skip
def vehicles(c: Catalog) -> DataFrame:
    aliases = c.spark.createDataFrame([("volvo", "Volvo"), ("volvo trucks", "Volvo"), ("sino", "Sino"), ("howo", "Sino")], "alias string, brand string")
    size = F.col("p_size").cast("string")
    cell = F.when(key() % 4 == 0, F.concat(F.lit("Volvo  Trucks FH"), size, F.lit(" / FM"), size, F.lit("/"))).when(key() % 4 == 1, "VOLVO FM").when(key() % 4 == 2, "Sino HOWO").otherwise(F.concat(F.lit("Nobrand X"), size))
    return R.explode_vehicles(c.read("part").select("p_partkey", cell.alias("cell")), "p_partkey", "cell", aliases)


def _suggested(c: Catalog) -> DataFrame:
    items = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("size", F.when(key() % 2 == 0, "12").otherwise("wide")), ("grade", F.lit("B")), ("oem", F.lit(None).cast("string")), ("colour", F.lit("red")))))
    return c.read("part").select((key() + 100).alias("suggestion_id"), key().alias("part_id"), F.col("p_type").alias("category"), F.inline(items))


def _held(c: Catalog) -> DataFrame:
    return _attributes(c).filter(F.col("key").isin("grade", "extra")).select("part_id", "key", "value")


CLEANED = "SELECT p_partkey + 100 AS suggestion_id, p_partkey AS part_id, 'size' AS key, '12' AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey + 100, p_partkey, 'grade', 'B' FROM part WHERE p_partkey % 3 = 0"


@register("c33_clean_attributes", CLEANED)
def clean_attributes(c: Catalog) -> DataFrame:
    return R.clean_attributes(_suggested(c), _held(c), _schemas(c))


@register("k10_apply_suggestions", f"""SELECT part_id, CASE WHEN part_id % 4 = 0 AND name_en <> '' THEN name_en ELSE 'second' END AS name_en, CASE WHEN part_id % 3 = 0 THEN 'told' ELSE description_en END AS description_en,
  (SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT 'extra=true' AS k WHERE part_id % 2 = 1 UNION ALL SELECT 'grade=' || CASE part_id % 3 WHEN 1 THEN 'A' ELSE 'Z' END WHERE part_id % 3 <> 0 UNION ALL SELECT key || '=' || value FROM ({CLEANED}) s WHERE s.part_id = p.part_id)) AS attributes,
  'ai' AS source, CASE WHEN part_id % 4 <> 0 OR name_en = '' THEN 60 WHEN part_id % 3 = 0 THEN 70 ELSE 80 END AS confidence FROM parts p""", "parts")  # fmt: skip
def apply_suggestions(c: Catalog) -> DataFrame:
    """Verified parts (each fourth) keep their name; their description is suggested where part_id % 3 = 0 and is not verified for others."""
    k = F.col("part_id")
    held = _held(c).filter("value is not null").groupBy("part_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attributes"))
    none = F.create_map().cast("map<string,string>")
    parts = c.parts.select("part_id", "name_en", "description_en", (k % 4 == 0).alias("verified"), F.lit("import").alias("source"), F.lit(90).alias("confidence")).withColumn("description_en", F.when(k % 3 == 0, "").otherwise(F.col("description_en")))
    parts = parts.join(held, "part_id", "left").withColumn("attributes", F.coalesce("attributes", none))
    items = F.array(*(F.struct((k * 10 + i).alias("suggestion_id"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(s).alias("confidence")) for i, f, v, s in ((1, "name_en", "first", 65), (2, "name_en", "second", 60), (3, "description_en", "told", 70))))
    chosen = c.parts.select("part_id", F.inline(items)).filter((F.col("field") == "name_en") | (k % 3 == 0))
    specs = R.clean_attributes(_suggested(c), _held(c), _schemas(c)).withColumn("confidence", F.lit(80))
    out = R.apply_suggestions(chosen, specs, parts, ["name_en", "description_en"])
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.select("part_id", "name_en", "description_en", shown.alias("attributes"), "source", "confidence")


@register("f16_suggestion_counts", "SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (SELECT unnest(['F', 'O', 'P', 'none']) AS s)")
def suggestion_counts(c: Catalog) -> DataFrame:
    return R.suggestion_counts(c.read("orders").select(F.col("o_orderstatus").alias("status")), ["F", "O", "P", "none"])


@register("g9_first_numbers", "SELECT l_orderkey AS record_id, l_returnflag AS kind, l_linestatus AS norm, arg_min(l_linenumber, l_linenumber)::VARCHAR AS number FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1, 2, 3")
def first_numbers(c: Catalog) -> DataFrame:
    norm = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    return R.first_numbers(c.read("lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_returnflag").alias("kind"), norm.alias("norm"), F.col("l_linenumber").alias("place"), F.col("l_linenumber").cast("string").alias("number")))


@register("h4_review_order", "SELECT p_partkey AS cluster, ['info', 'weak', 'strong', 'medium', 'conflict', 'odd'][p_partkey % 6 + 1] AS strength, p_size AS n_records, [4, 3, 0, 2, 1, 9][p_partkey % 6 + 1] AS strength_rank FROM part")
def review_order(c: Catalog) -> DataFrame:
    kinds = F.array(*map(F.lit, ("info", "weak", "strong", "medium", "conflict", "odd")))
    return R.review_order(c.read("part").select(key().alias("cluster"), F.element_at(kinds, (key() % 6 + 1).cast("int")).alias("strength"), F.col("p_size").alias("n_records")))


@register("i4_merged_missing", "SELECT a.l_orderkey AS order_id, string_agg(DISTINCT m, ',' ORDER BY m) AS missing FROM (SELECT l_orderkey, unnest([l_linestatus, l_returnflag]) AS m FROM lineitem) a GROUP BY 1")
def merged_missing(c: Catalog) -> DataFrame:
    side = lambda n: c.read("lineitem").filter(F.col("l_linenumber") % 2 == n).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.flatten(F.collect_set(F.array("l_linestatus", "l_returnflag"))).alias(f"m{n}"))
    return side(0).join(side(1), "order_id", "full").select("order_id", F.array_join(R.merged_missing(F.col("m0"), F.col("m1")), ",").alias("missing"))


@register("i5_shared_numbers", "SELECT a.part_id AS a, b.part_id AS b, string_agg(DISTINCT a.number_norm, ',' ORDER BY a.number_norm) AS shared FROM numbers a JOIN numbers b ON b.part_id = a.part_id + 1 AND a.number_norm = b.number_norm GROUP BY 1, 2", "numbers")
def shared_numbers(c: Catalog) -> DataFrame:
    per = c.numbers.groupBy("part_id").agg(F.collect_set("number_norm").alias("own"))
    j = per.select(F.col("part_id").alias("a"), F.col("own").alias("x")).join(per.select(F.col("part_id").alias("b"), F.col("own").alias("y")), F.col("b") == F.col("a") + 1)
    return j.select("a", "b", F.array_join(R.shared_numbers(F.col("x"), F.col("y")), ",").alias("shared")).filter("shared <> ''")


@register("j16_bulk_confirm", "SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' THEN 'same' END AS decision, CASE WHEN o_orderstatus <> 'F' THEN 'only strong items may be confirmed in bulk' END AS refused FROM orders")
def bulk_confirm(c: Catalog) -> DataFrame:
    return R.bulk_confirm(c.read("orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "strong").otherwise("conflict").alias("category")))


@register("j20_product_history", """SELECT p_partkey AS product_id, l_orderkey * 10 + l_linenumber AS log_id, l_shipdate::DATE AS at FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 1
  UNION SELECT l_partkey, l_orderkey * 10 + l_linenumber, l_shipdate::DATE FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1
  UNION SELECT l_suppkey, l_orderkey * 10 + l_linenumber, l_shipdate::DATE FROM lineitem JOIN part ON l_suppkey = p_partkey WHERE l_linenumber = 1""")  # fmt: skip
def product_history(c: Catalog) -> DataFrame:
    code = lambda x: F.concat(F.lit("P"), F.lpad(F.col(x).cast("string"), 9, "0"))
    payload = F.concat(F.lit("merge "), code("l_partkey"), F.lit(" into "), code("l_suppkey"))
    logs = c.read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id"), F.col("l_shipdate").cast("date").alias("at"), F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("item_id"), payload.alias("payload"))
    part = c.read("part")
    return R.product_history(logs, part.select(key().alias("item_id"), key().alias("product_id")), part.select(key().alias("product_id"), code("p_partkey").alias("code")), r"P\d{9}")


FOUND = f"""SELECT q.query_id, r.record_id, f AS field FROM (SELECT p_partkey AS query_id, CASE p_partkey % 3 WHEN 0 THEN upper(string_split(p_type, ' ')[-1]) || (p_partkey % 40)::VARCHAR WHEN 1 THEN 'supplier#' || lpad(p_partkey::VARCHAR, 9, '0') ELSE 'x' || p_name END AS q FROM part) q
  JOIN (SELECT record_id, unnest(['part_type', 'make', 'model', 'supplier']) AS f, unnest([part_type, make, model, s_name]) AS v FROM (SELECT r.*, s_name FROM ({CURRENT}) r JOIN supplier ON supplier_id = s_suppkey)) r ON contains(lower(v), lower(q.q))"""


@register("d8_search_text", FOUND, "records")
def search_text(c: Catalog) -> DataFrame:
    text = F.when(key() % 3 == 0, F.concat(F.upper(F.element_at(F.split("p_type", " "), -1)), (key() % 40).cast("string"))).when(key() % 3 == 1, F.concat(F.lit("supplier#"), F.lpad(key().cast("string"), 9, "0"))).otherwise(F.concat(F.lit("x"), "p_name"))
    records = A.current_records(c.records).join(c.suppliers.select("supplier_id", F.col("name").alias("supplier")), "supplier_id")
    return R.search_records(c.read("part").select(key().alias("query_id"), text.alias("text")), records, ["part_type", "make", "model", "supplier"])


TRI = "flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
MISSPELT = f"""WITH n AS (SELECT DISTINCT name_en, {TRI.format("name_en")} AS t FROM parts WHERE name_en <> ''), q AS (SELECT DISTINCT p_name || right(p_name, 1) AS q, list_distinct({TRI.format("p_name || right(p_name, 1)")}) AS own FROM part),
  b AS (SELECT q, name_en, own, t, unnest(range(1, len(t) + 1)) AS lo FROM q, n), e AS (SELECT q, name_en, own, t[lo:hi] AS x FROM (SELECT *, unnest(range(lo, len(t) + 1)) AS hi FROM b)),
  s AS (SELECT q, name_en, max(len(list_intersect(own, x)) / len(list_distinct(own || x))) AS share FROM e GROUP BY 1, 2 HAVING share >= 0.3),
  r AS (SELECT q, part_id, share FROM s JOIN parts USING (name_en) QUALIFY row_number() OVER (PARTITION BY q ORDER BY share DESC, sku) <= {M.TOP})
  SELECT p_partkey AS query_id, part_id, round(600 * share)::INT AS milli FROM part JOIN r ON q = p_name || right(p_name, 1)"""


@register("e7_match_misspelt", MISSPELT, "parts")
def match_misspelt(c: Catalog) -> DataFrame:
    """Each part asked by its name with the last letter typed twice: no name holds that, so each goes to the similar ones."""
    q = M.queries_of(c.read("part").select(key().alias("query_id"), F.concat("p_name", F.expr("right(p_name, 1)")).alias("raw")))
    return R.match_misspelt(q, c.parts, M.match_name(q, c.parts, c.fitments).select("query_id"))


@register("c8_currency_v1", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'EUR' END AS currency FROM part")
def currency_v1(c: Catalog) -> DataFrame:
    return c.read("part").select("p_partkey", C.currency_v1(F.when(key() % 4 == 0, "12 $").otherwise(""), F.when(key() % 4 == 1, "￥12").when(key() % 4 == 2, "12 €").otherwise("12")).alias("currency"))


@register("c9_currency", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'EUR' WHEN 3 THEN NULL END AS currency, CASE p_partkey % 5 WHEN 0 THEN 'bare dollar sign read as USD' WHEN 3 THEN 'currency not recognized' END AS warning FROM part")
def currency(c: Catalog) -> DataFrame:
    cell = F.when(key() % 5 == 0, "$").when(key() % 5 == 1, "rmb").when(key() % 5 == 3, "shells").otherwise("")
    return c.read("part").select("p_partkey", F.inline(F.array(C.currency(cell, F.when(key() % 5 == 2, "€ 5").otherwise("$5")))))


@register("c21_split_script", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE '刹车片' END AS zh, CASE p_partkey % 3 WHEN 1 THEN '' ELSE p_name END AS en FROM part")
def split_script(c: Catalog) -> DataFrame:
    name = F.when(key() % 3 == 0, F.concat(F.lit("刹车片 "), "p_name")).when(key() % 3 == 1, "刹车片").otherwise(F.col("p_name"))
    return c.read("part").select("p_partkey", F.inline(F.array(C.split_script(name))))


@register("b8_suggest_mapping", "SELECT s_suppkey AS supplier_id, ['Price', 'Price USD', 'Colour', 'Kept'][s_suppkey % 4 + 1] AS header, ['price', 'price', 'ignore', 'moq'][s_suppkey % 4 + 1] AS field, [1.0, 0.9, 0.0, 1.0][s_suppkey % 4 + 1]::DOUBLE AS confidence, ['synonym', 'unit', 'none', 'template'][s_suppkey % 4 + 1] AS source FROM supplier")
def suggest_mapping(c: Catalog) -> DataFrame:
    synonyms = c.spark.createDataFrame([("price", "price"), ("pri", "note"), ("oe", "oe_numbers")], "synonym string, field string")
    header = F.element_at(F.array(*map(F.lit, ("Price", "Price USD", "Colour", "Kept"))), (key("s_suppkey") % 4 + 1).cast("int"))
    headers = c.read("supplier").select(key("s_suppkey").alias("supplier_id"), header.alias("header"))
    return G.suggest_mapping(headers, synonyms, headers.filter("header = 'Kept'").withColumn("field", F.lit("moq")))


@register("b10_validate_mapping", "SELECT s_suppkey AS supplier_id, ['repeated: price', 'unknown: colour', 'no identity column', ''][s_suppkey % 4 + 1] AS problems FROM supplier")
def validate_mapping(c: Catalog) -> DataFrame:
    fields = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in (("oe_numbers", "price", "price"), ("name", "colour"), ("price", "note"), ("sku", "oe_numbers", "oe_numbers")))), (key("s_suppkey") % 4 + 1).cast("int"))
    return G.validate_mapping(c.read("supplier").select(key("s_suppkey").alias("supplier_id"), F.explode(fields).alias("field")), ["oe_numbers", "price", "name", "note", "sku"], ["supplier_id"])


@register("b11_apply_overrides", "SELECT s_suppkey AS supplier_id, 'Price' AS header, CASE WHEN s_suppkey % 3 = 0 THEN 'moq' ELSE 'price' END AS field, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN s_suppkey % 3 = 0 THEN 'manual' ELSE 'unit' END AS source FROM supplier")
def apply_overrides(c: Catalog) -> DataFrame:
    rows = c.read("supplier").select(key("s_suppkey").alias("supplier_id"), F.lit("Price").alias("header"), F.lit("price").alias("field"), F.lit(0.9).alias("confidence"), F.lit("unit").alias("source"))
    chosen = rows.filter("supplier_id % 3 <> 2").select("supplier_id", "header", F.when(F.col("supplier_id") % 3 == 0, "moq").otherwise("price").alias("field"))
    return G.apply_overrides(rows, chosen, ["supplier_id"])


@register("b12_upsert_templates", "SELECT o_custkey AS supplier_id, o_orderstatus AS signature, o_orderpriority AS mapping, o_orderdate::DATE AS confirmed_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderpriority DESC) = 1")
def upsert_templates(c: Catalog) -> DataFrame:
    rows = c.read("orders").select(F.col("o_custkey").alias("supplier_id"), F.col("o_orderstatus").alias("signature"), F.col("o_orderpriority").alias("mapping"), F.col("o_orderdate").cast("date").alias("confirmed_at"))
    return G.upsert_templates(rows.filter("confirmed_at < date'1996-01-01'"), rows.filter("confirmed_at >= date'1996-01-01'"))
