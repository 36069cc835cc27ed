"""Registered queries for vocabulary-driven columns, attributes and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixture import Catalog
from ..operators import archive as A
from ..operators import standardize as S
from .archive import CURRENT, HEAD, JUDGED, MEMBERS, judged, members
from .catalog import parsed, register


def _brands(c: Catalog) -> DataFrame:
    """Aliases made from the parts' brands: 'Brand#12' is also known as 'b 12'."""
    return c.read("part").select(F.regexp_replace(F.lower("p_brand"), "brand#", "b ").alias("alias"), F.col("p_brand").alias("brand")).distinct()


@register("c5_canonical_brand", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def canonical_brand(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    short = F.regexp_replace("p_brand", "Brand#", "")
    spelled = F.when(k % 3 == 0, F.concat(F.lit("unknown "), short)).when(k % 3 == 1, F.concat(F.lit("B-"), short)).otherwise(F.concat(F.lit("b."), short))
    return S.canonical_brand(c.read("part").select("p_partkey", spelled.alias("spelled")), "spelled", _brands(c)).select("p_partkey", "brand")


@register("c19_part_type", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Odd Thing' ELSE string_split(p_type, ' ')[-1] END AS part_type, p_partkey % 4 <> 0 AS registered FROM part")
def part_type(c: Catalog) -> DataFrame:
    part = c.read("part")
    last = F.element_at(F.split("p_type", " "), -1)
    types = part.select(F.lower(last).alias("alias"), last.alias("name")).distinct()
    k = F.col("p_partkey")
    rows = part.select("p_partkey", F.when(k % 4 == 0, "odd thing").when(k % 4 == 1, F.concat(F.lit("Left "), F.upper("p_type"), F.lit("."))).otherwise("x").alias("name"), F.when(k % 4 == 0, "none").otherwise(F.col("p_type")).alias("category"))
    return S.with_part_type(rows, "p_partkey", "name", "category", types).select("p_partkey", "part_type", "registered")


@register("c20_position", "SELECT p_partkey, ['left', 'right', 'left', ''][p_partkey % 4 + 1] AS position, CASE WHEN p_partkey % 4 = 1 THEN 'position differs from the name' END AS position_warning FROM part")
def position(c: Catalog) -> DataFrame:
    positions = c.spark.createDataFrame([("left", "left"), ("lh", "left"), ("left hand", "left"), ("right", "right"), ("rh", "right")], "alias string, name string")
    k = F.col("p_partkey")
    rows = c.read("part").select("p_partkey", F.when(k % 4 == 0, "pad left hand").when(k % 4 == 1, "pad LH").otherwise("pad").alias("name"), F.when(k % 4 == 1, "RH").when(k % 4 == 2, "Left").otherwise("").alias("col"))
    return S.with_position(rows, "p_partkey", "name", "col", positions).select("p_partkey", "position", "position_warning")


@register("c14_fitments", """SELECT p_partkey, 0 AS entry, 'Volvo Trucks' AS make, 'FH' || p_size AS model, 1990 + p_size % 10 AS year_from, CASE WHEN p_partkey % 3 = 0 THEN 2010 WHEN p_partkey % 3 = 1 THEN NULL ELSE 1990 + p_size % 10 END AS year_to, TRUE AS known FROM part
  UNION ALL SELECT p_partkey, 1, 'Nobrand', 'X 1', NULL, NULL, FALSE FROM part WHERE p_partkey % 2 = 0""")  # fmt: skip
def fitments(c: Catalog) -> DataFrame:
    makes = c.spark.createDataFrame([("volvo", "Volvo"), ("volvo trucks", "Volvo Trucks")], "alias string, name string")
    k = F.col("p_partkey")
    year = (F.col("p_size") % 10 + 1990).cast("string")
    cell = F.concat(F.lit("Volvo Trucks FH"), F.col("p_size").cast("string"), F.lit(" "), year, F.when(k % 3 == 0, "-2010").when(k % 3 == 1, "+").otherwise(""), F.when(k % 2 == 0, ";Nobrand X 1").otherwise(""))
    return S.with_fitments(c.read("part").select("p_partkey", cell.alias("cell")), "p_partkey", "cell", makes)


@register("c23_reclassify_numbers", "SELECT part_id, kind, CASE WHEN part_id % 2 = 0 AND kind = 'OE' THEN 'CROSS' ELSE kind END AS new_kind, CASE WHEN part_id % 2 = 0 AND kind = 'OE' THEN 'Donaldson' END AS hint_brand FROM numbers", "numbers")
def reclassify(c: Catalog) -> DataFrame:
    k = F.col("part_id")
    rows = c.numbers.withColumn("number", F.when((k % 2 == 0) & (F.col("kind") == "OE"), F.concat(F.lit("P"), F.lpad(k.cast("string"), 6, "0"))).otherwise(F.col("number")))
    return S.reclassify_numbers(rows, ["Donaldson", "Sachs", "Fleetguard", "MANN-FILTER"]).select("part_id", "kind", "new_kind", "hint_brand")


def _schemas(c: Catalog) -> DataFrame:
    types = c.read("part").select(F.col("p_type").alias("category")).distinct()
    keys = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(p).alias("place"), F.lit(r).alias("required")) for k, t, p, r in (("size", "number", 1, True), ("grade", "enum", 2, True), ("oem", "bool", 3, False))))
    return types.select("category", F.inline(keys)).withColumn("options", F.array(F.lit("A"), F.lit("B")))


def _attributes(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    items = F.array(
        F.struct(F.lit("size").alias("key"), F.when(k % 5 == 0, "big").otherwise(F.col("p_size").cast("string")).alias("value")),
        F.struct(F.lit("grade").alias("key"), F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "A").otherwise("Z").alias("value")), F.struct(F.when(k % 2 == 0, "oem").otherwise("extra").alias("key"), F.lit("true").alias("value")),
    )
    return c.read("part").select(k.alias("part_id"), F.col("p_type").alias("category"), F.inline(items))


@register("c25_validate_attributes", "SELECT p_partkey AS part_id, 'size' AS key, 'not a valid number' AS problem FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'grade', 'not a valid enum' FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT p_partkey, 'extra', 'unknown key' FROM part WHERE p_partkey % 2 = 1")
def validate_attributes(c: Catalog) -> DataFrame:
    return S.validate_attributes(_attributes(c), _schemas(c))


@register("c26_validate_packaging", "SELECT p_partkey AS part_id, 'unit' AS key, 'unknown unit' AS problem FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'gross_weight_kg', 'not a positive number' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'colour', 'unknown key' FROM part WHERE p_partkey % 5 = 0")
def validate_packaging(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    items = F.array(F.struct(F.lit("unit").alias("key"), F.when(k % 3 == 0, "box").otherwise("set").alias("value")), F.struct(F.lit("gross_weight_kg").alias("key"), F.when(k % 4 == 0, "-1").otherwise("2.5").alias("value")), F.struct(F.when(k % 5 == 0, "colour").otherwise("pcs_per_carton").alias("key"), F.lit("4").alias("value")))
    return S.validate_packaging(c.read("part").select(k.alias("part_id"), F.inline(items)))


@register("c27_attribute_rows", """SELECT part_id, row_number() OVER (PARTITION BY part_id ORDER BY p NULLS LAST, key)::INT AS place, key, value, p IS NOT NULL AS known FROM (
  SELECT p_partkey AS part_id, 1 AS p, 'size' AS key, CASE WHEN p_partkey % 5 = 0 THEN 'big' ELSE p_size::VARCHAR END AS value FROM part UNION ALL SELECT p_partkey, 2, 'grade', CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'Z' END FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 END, CASE WHEN p_partkey % 2 = 0 THEN 'oem' ELSE 'extra' END, 'true' FROM part)""")  # fmt: skip
def attribute_rows(c: Catalog) -> DataFrame:
    return S.attribute_rows(c.read("part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category")), _attributes(c), _schemas(c))


@register("c30_missing_fields", f"SELECT identity, concat_ws(',', CASE WHEN part_type = '' THEN 'part_type' END, CASE WHEN position = '' THEN 'position' END, CASE WHEN model = '' THEN 'fitment' END, CASE WHEN oe = '' THEN 'oe_numbers' END, CASE WHEN dim_a IS NULL THEN 'dims' END, 'currency') AS missing FROM ({CURRENT})", "records")
def missing_fields(c: Catalog) -> DataFrame:
    rows = A.current_records(c.records).withColumns({"fitment": F.col("model"), "dims": F.col("dim_a"), "oe_numbers": F.col("oe"), "price": F.col("price_cents"), "currency": F.lit("")})
    return S.missing_fields(rows, F.lit(True)).select("identity", F.array_join("missing", ",").alias("missing"))


@register("c28_lineage", "SELECT o_orderkey AS row_id, 'date=' || o_orderstatus || '/1;name=' || o_orderpriority || '/2' AS fields FROM orders")
def lineage(c: Catalog) -> DataFrame:
    text = lambda x: F.col(x)
    item = lambda field, col, *cells: [F.struct(F.lit(field).alias("field"), F.lit(f"c{i}").alias("column"), F.lit(f"A{i}").alias("cell"), text(col).alias("raw"), text(col).alias("value"), F.lit("copy").alias("rule")) for i in cells]
    cells = c.read("orders").select(F.col("o_orderkey").alias("row_id"), F.inline(F.array(*item("name", "o_orderpriority", 1, 2), *item("date", "o_orderstatus", 3))))
    shown = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("/"), F.size(e["value"]["sources"]).cast("string")))
    return S.lineage(cells).select("row_id", F.array_join(shown, ";").alias("fields"))


@register("f13_product_missing", f"SELECT product_id, string_agg(field, ',' ORDER BY field) AS missing FROM (SELECT product_id, field FROM ({MEMBERS}) m JOIN (SELECT identity, unnest(list_filter([CASE WHEN dim_a IS NULL THEN 'dims' END, CASE WHEN model = '' THEN 'fitment' END, CASE WHEN record_id % 3 = 0 THEN 'price' END], lambda x: x IS NOT NULL)) AS field FROM ({CURRENT})) USING (identity) GROUP BY product_id, field HAVING count(*) = (SELECT count(*) FROM ({MEMBERS}) n WHERE n.product_id = m.product_id)) GROUP BY product_id", "records")
def product_missing(c: Catalog) -> DataFrame:
    fields = F.array_compact(F.array(F.when(F.col("dim_a").isNull(), "dims"), F.when(F.col("model") == "", "fitment"), F.when(F.col("record_id") % 3 == 0, "price")))
    return S.product_missing(members(c), A.current_records(c.records).select("identity", F.explode(fields).alias("field")))


@register("d11_applicable_suggestions", "SELECT p_partkey AS suggestion_id, p_partkey AS part_id, 'name' AS field, p_partkey % 3 = 0 OR p_partkey % 4 <> 0 AS applicable, p_partkey % 3 = 0 AS ticked, p_partkey % 3 <> 0 AND p_name <> 'x' AS replaces FROM part")
def applicable(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    have = c.read("part").select(k.alias("part_id"), F.lit("name").alias("field"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("have"), (k % 4 == 0).alias("verified"))
    return S.applicable_suggestions(c.read("part").select(k.alias("suggestion_id"), k.alias("part_id"), F.lit("name").alias("field"), F.lit("x").alias("value")), have)


@register("k11_resolve_category", "SELECT s_suppkey AS suggestion_id, CASE WHEN s_suppkey % 3 <> 0 THEN n_nationkey END AS category_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def resolve_category(c: Catalog) -> DataFrame:
    nation = c.read("nation")
    categories = nation.select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"), F.concat(F.lit("en "), "n_name").alias("name_en"), F.col("n_regionkey").alias("parent"))
    names = c.read("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    named = names.select(k.alias("suggestion_id"), F.when(k % 3 == 0, "nowhere").when(k % 3 == 1, F.lower("n_name")).otherwise(F.concat(F.lit("EN "), "n_name")).alias("name"))
    return S.resolve_category(named, categories).select("suggestion_id", "category_id")


@register("e4_match_blocked")
def match_blocked(c: Catalog) -> DataFrame:
    """SKUs without their common prefix: the derived numbers share their first characters, so one block would hold them all."""
    return S.match_blocked(parsed(c, "sku").withColumn("norm", F.substring("norm", 4, 30)), c.parts.select("part_id", F.col("sku").alias("number"), F.substring(F.regexp_replace("sku", "-", ""), 4, 30).alias("number_norm")))


@register("j8_side_by_side", f"{HEAD}, {JUDGED} SELECT j.a, j.b, t.field, CASE t.field WHEN 'part_type' THEN x.part_type ELSE x.position END AS text_a, CASE t.field WHEN 'part_type' THEN y.part_type ELSE y.position END AS text_b, CASE WHEN list_contains(string_split(conflicts, ','), t.field) THEN 'conflict' WHEN list_contains(string_split(missing, ','), t.field) THEN 'missing' ELSE '' END AS flag FROM judged j JOIN r x ON x.identity = j.a JOIN r y ON y.identity = j.b, (VALUES ('part_type'), ('position')) t(field)", "records")
def side_by_side(c: Catalog) -> DataFrame:
    return S.side_by_side(judged(c), A.current_records(c.records), ["part_type", "position"])
