"""Registered queries over cell grids made from orders: one file for each hundred orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixture import Catalog
from ..sources import grid as G
from .catalog import register

#: Per file: a title row, a blank one, the header at a row that depends on the file, then the orders.
CELLS = """SELECT file_id, 's' AS sheet, row_no, col_no, text FROM (
  SELECT f AS file_id, h AS row_no, c AS col_no, ['Order No', 'Price USD', 'Date', 'Price USD', 'OE #'][c] AS text FROM (SELECT DISTINCT o_orderkey // 100 AS f, (o_orderkey // 100 % 4 + 2)::INT AS h FROM orders), (VALUES (1), (2), (3), (4), (5)) t(c)
  UNION ALL SELECT DISTINCT o_orderkey // 100, 1, 1, 'Price list of file ' || (o_orderkey // 100)::VARCHAR FROM orders
  UNION ALL SELECT o_orderkey // 100, (o_orderkey // 100 % 4 + 3 + o_orderkey % 100)::INT, c, [o_orderpriority || o_orderkey::VARCHAR, (o_orderkey % 977)::VARCHAR || '.5', CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE o_orderstatus END, (o_custkey % 31)::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '20' || o_custkey::VARCHAR END][c]
    FROM orders, (VALUES (1), (2), (3), (4), (5)) t(c))"""
FILLED = f"SELECT * FROM ({CELLS}) WHERE trim(text) <> ''"
NUMBER = "regexp_matches(trim(text), '^[+-]?[\\d\\s]*[\\d,]*\\.?\\d+$')"
HEADER = f"""SELECT file_id, sheet, arg_max(row_no, texts * 1000000 - row_no) AS header_row FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet ORDER BY row_no) AS k FROM (
  SELECT file_id, sheet, row_no, count(*) AS n, count(*) FILTER (WHERE NOT {NUMBER}) AS texts FROM ({FILLED}) GROUP BY ALL) WHERE n >= 2) WHERE k <= 20 GROUP BY file_id, sheet"""
NAMED = f"""SELECT file_id, sheet, col_no, text, CASE WHEN k > 1 THEN h || ' (' || k || ')' ELSE h END AS header FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet, h ORDER BY col_no) AS k FROM (
  SELECT file_id, sheet, col_no, max(text) FILTER (WHERE row_no = header_row) AS text, coalesce(trim(max(text) FILTER (WHERE row_no = header_row)), '列' || col_no) AS h FROM ({FILLED}) JOIN ({HEADER}) USING (file_id, sheet) WHERE row_no >= header_row GROUP BY file_id, sheet, col_no))"""
ROWS = f"SELECT file_id, sheet, row_no, header, trim(c.text) AS text, count(*) OVER (PARTITION BY file_id, sheet, row_no) AS n FROM ({FILLED}) c JOIN ({HEADER}) USING (file_id, sheet) JOIN (SELECT file_id, sheet, col_no, header FROM ({NAMED})) USING (file_id, sheet, col_no) WHERE row_no > header_row"


def cells(c: Catalog) -> DataFrame:
    k, f = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 100)
    orders = c.read("orders")
    files = orders.select(f.alias("file_id")).distinct()
    start = (F.col("file_id") % 4 + 2).cast("int")
    stack = lambda *texts: F.posexplode(F.array(*texts))
    columns = lambda df, row: df.select("file_id", F.lit("s").alias("sheet"), row.alias("row_no"), (F.col("pos") + 1).alias("col_no"), F.col("col").alias("text"))
    head = columns(files.select("file_id", stack(*map(F.lit, ("Order No", "Price USD", "Date", "Price USD", "OE #")))), start)
    title = columns(files.select("file_id", stack(F.concat(F.lit("Price list of file "), F.col("file_id").cast("string")))), F.lit(1))
    data = orders.select(
        f.alias("file_id"), k.alias("k"),
        stack(F.concat("o_orderpriority", k.cast("string")), F.concat((k % 977).cast("string"), F.lit(".5")), F.when(k % 3 == 0, "N/A").otherwise(F.col("o_orderstatus")), (F.col("o_custkey") % 31).cast("string"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("20"), F.col("o_custkey").cast("string")))),
    )
    return head.unionByName(title).unionByName(columns(data, (F.col("file_id") % 4 + 3 + F.col("k") % 100).cast("int")))


@register("a3_read_cells", CELLS)
def read_cells(c: Catalog) -> DataFrame:
    return cells(c)


@register("b1_detect_header", HEADER)
def detect_header(c: Catalog) -> DataFrame:
    return G.detect_header(cells(c))


@register("b2_detect_header_v1", f"""SELECT file_id, sheet, arg_max(row_no, texts * 1000000 - numbers * 1000 - row_no) AS header_row FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet ORDER BY row_no) AS k FROM (
  SELECT file_id, sheet, row_no, count(*) FILTER (WHERE NOT {NUMBER}) AS texts, count(*) FILTER (WHERE {NUMBER}) AS numbers FROM ({FILLED}) GROUP BY ALL)) WHERE k <= 10 GROUP BY file_id, sheet""")  # fmt: skip
def detect_header_v1(c: Catalog) -> DataFrame:
    return G.detect_header_v1(cells(c))


@register("b3_dedupe_headers", NAMED)
def headers(c: Catalog) -> DataFrame:
    grid = cells(c)
    return G.sheet_headers(grid, G.detect_header(grid))


@register("b4_rows_from_grid", f"SELECT file_id, sheet, row_no, string_agg(header || '=' || text, ';' ORDER BY header, text) AS raw FROM ({ROWS}) WHERE n > 1 GROUP BY file_id, sheet, row_no")
def rows(c: Catalog) -> DataFrame:
    grid = cells(c)
    found = G.rows_from_grid(grid, G.detect_header(grid))
    return found.withColumn("raw", F.array_join(F.transform(F.array_sort(F.map_entries("raw")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))


@register("b5_skipped_rows", f"SELECT file_id, sheet, row_no, substr(min(text), 1, 40) AS reason FROM ({FILLED}) GROUP BY file_id, sheet, row_no HAVING count(*) = 1")
def skipped(c: Catalog) -> DataFrame:
    return G.skipped_rows(cells(c))


TABLES = "SELECT l_orderkey % 50 AS file_id, l_orderkey // 50 AS page, l_linenumber AS table_no, max(l_quantity::INT % 2 + 4) AS width FROM lineitem GROUP BY ALL"


@register("b6_stitch_tables", f"SELECT file_id, page, table_no, width, sum(starts) OVER (PARTITION BY file_id ORDER BY page, table_no)::BIGINT AS \"group\" FROM (SELECT *, CASE WHEN table_no = 1 AND lag(page) OVER w = page - 1 AND lag(width) OVER w = width THEN 0 ELSE 1 END AS starts FROM ({TABLES}) WINDOW w AS (PARTITION BY file_id ORDER BY page, table_no))")
def stitch(c: Catalog) -> DataFrame:
    tables = c.read("lineitem").select((F.col("l_orderkey") % 50).alias("file_id"), F.floor(F.col("l_orderkey") / 50).alias("page"), F.col("l_linenumber").alias("table_no"), (F.col("l_quantity").cast("int") % 2 + 4).alias("width"))
    return G.stitch_tables(tables.groupBy("file_id", "page", "table_no").agg(F.max("width").alias("width")))


PARTED = "SELECT o_custkey AS file_id, 's' AS sheet, o_orderkey AS col_no, o_orderpriority AS header, o_orderkey % 3 <> 0 AS has_data FROM orders"


@register("b7_merge_split_headers", f"SELECT file_id, sheet, min(col_no) AS col_no, string_agg(header, ' ' ORDER BY col_no) AS header FROM (SELECT *, sum(CASE WHEN has_data OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY col_no) AS island FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY col_no) AS rn FROM ({PARTED}))) GROUP BY file_id, sheet, island")
def merge_headers(c: Catalog) -> DataFrame:
    parted = c.read("orders").select(F.col("o_custkey").alias("file_id"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("col_no"), F.col("o_orderpriority").alias("header"), (F.col("o_orderkey") % 3 != 0).alias("has_data"))
    return G.merge_split_headers(parted)


@register("b9_header_signature", f"SELECT file_id, sheet, sha256(string_agg(k, chr(31) ORDER BY k)) AS signature FROM (SELECT file_id, sheet, regexp_replace(replace(lower(header), '#', ' no '), '[\\s_\\-./()（）:：*]+', '', 'g') AS k FROM ({NAMED})) GROUP BY file_id, sheet")
def signature(c: Catalog) -> DataFrame:
    return G.header_signature(headers(c), ["file_id", "sheet"])


@register("b13_mapped_cells", f"SELECT file_id, sheet, row_no, header, text, field FROM (SELECT *, CASE WHEN starts_with(header, 'Price') THEN 'price' WHEN header = 'Date' THEN 'quote_date' WHEN header = 'OE #' THEN 'oe_numbers' ELSE 'ignore' END AS field FROM ({ROWS}) WHERE n > 1) WHERE field <> 'ignore' AND lower(text) NOT IN ({', '.join(repr(b) for b in G.BLANKS)})")
def mapped(c: Catalog) -> DataFrame:
    grid = cells(c)
    detected = G.detect_header(grid)
    h = F.col("header")
    field = F.when(F.startswith(h, F.lit("Price")), "price").when(h == "Date", "quote_date").when(h == "OE #", "oe_numbers").otherwise("ignore")
    mapping = G.sheet_headers(grid, detected).select("file_id", "sheet", "header", field.alias("field"))
    return G.mapped_cells(G.rows_from_grid(grid, detected), mapping).select("file_id", "sheet", "row_no", "header", "text", "field")


@register("b14_column_samples", f"SELECT file_id, sheet, col_no, string_agg(text, ' | ' ORDER BY row_no) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet, col_no ORDER BY row_no) AS k FROM ({FILLED})) WHERE k <= 3 GROUP BY file_id, sheet, col_no")
def samples(c: Catalog) -> DataFrame:
    return G.column_samples(cells(c))


@register("a2_register_files", """SELECT supplier_id, file_id, sha256, reason IS NULL AS accepted, reason FROM (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 10 = 0 AND r.source = supplier_id AND sha256(r.text) = i.sha256) THEN 'already registered' WHEN rn > 1 THEN 'twice in this drop' END AS reason
  FROM (SELECT source AS supplier_id, doc_id AS file_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) i)""")  # fmt: skip
def register_files(c: Catalog) -> DataFrame:
    docs = c.read("documents")
    registry = docs.filter("doc_id % 10 = 0").select(F.col("source").alias("supplier_id"), F.sha2("text", 256).alias("sha256"))
    return G.register_files(docs.select(F.col("source").alias("supplier_id"), F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content")), registry)
