"""From cells to mapped rows: headers, rows, column mappings and file registration.

Cells: file_id, sheet, row_no, col_no, text. Empty cells are absent or hold ''.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import header_key

#: Texts that stand for no value, and the fields that several columns may feed.
BLANKS = ("-", "--", "—", "/", "n/a", "na", "none", "null", "tbd")
MULTIPLE = ("oe_numbers", "spec", "note", "ignore")
IDENTITY = ("sku", "supplier_sku", "oe_numbers", "name")
NUMERIC = r"^[+-]?[\d\s]*[\d,]*\.?\d+$"
MAX_BYTES = 20 * 1024 * 1024
SHEET = ("file_id", "sheet")


def filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def scan_csv_grids(spark: SparkSession, path: str) -> DataFrame:
    """A1: cells of every CSV file under path. UTF-8 with or without its mark, else GB 18030; the delimiter is guessed."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    text = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = bytes(content).decode("gb18030", "replace")
                try:
                    delimiter = csv.Sniffer().sniff(text[:4096], ",;\t|").delimiter
                except csv.Error:
                    delimiter = ","
                rows = [(name, "csv", r, c, x.strip()) for r, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter), 1) for c, x in enumerate(row, 1) if x.strip()]
                yield pd.DataFrame(rows, columns=["file_id", "sheet", "row_no", "col_no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file_id string, sheet string, row_no int, col_no int, text string")


def register_files(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """A2: incoming (supplier_id, file_id, content) with sha256, accepted and the reason against.

    The same content of a supplier is taken once: neither again later nor twice in one drop.
    """
    hashed = incoming.withColumn("sha256", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content"))
    known = registry.select("supplier_id", "sha256").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("supplier_id", "sha256").orderBy("file_id")) == 1
    out = hashed.join(known, ["supplier_id", "sha256"], "left").withColumn("first", first)
    reason = F.when(F.col("bytes") > MAX_BYTES, "too large").when(F.col("known"), "already registered").when(~F.col("first"), "twice in this drop")
    return out.select("supplier_id", "file_id", "sha256", reason.isNull().alias("accepted"), reason.alias("reason"))


def detect_header(cells: DataFrame) -> DataFrame:
    """B1: among the first 20 rows with two filled cells or more, the one with most cells that are no numbers; then the earliest."""
    rows = cells.filter(filled(F.col("text"))).groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.trim("text").rlike(NUMERIC)).alias("texts"))
    first = rows.filter("n >= 2").withColumn("k", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no"))).filter("k <= 20")
    return first.groupBy(*SHEET).agg(F.max_by("row_no", F.struct("texts", -F.col("row_no"))).alias("header_row"))


def detect_header_v1(cells: DataFrame) -> DataFrame:
    """B2: the best of the first 10 rows that aren't blank by (texts, fewest numbers), then the earliest."""
    number = F.trim("text").rlike(NUMERIC)
    rows = cells.filter(filled(F.col("text"))).groupBy(*SHEET, "row_no").agg(F.count_if(~number).alias("texts"), F.count_if(number).alias("numbers"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_no"))).filter("k <= 10")
    return first.groupBy(*SHEET).agg(F.max_by("row_no", F.struct("texts", -F.col("numbers"), -F.col("row_no"))).alias("header_row"))


def dedupe_headers(headers: DataFrame) -> DataFrame:
    """(sheet, col_no, text) with header: blanks are named by their number, repeats get ' (2)' and on."""
    named = headers.withColumn("header", F.when(filled(F.col("text")), F.trim("text")).otherwise(F.concat(F.lit("列"), F.col("col_no").cast("string"))))
    k = F.row_number().over(Window.partitionBy(*SHEET, "header").orderBy("col_no"))
    return named.withColumn("k", k).withColumn("header", F.when(F.col("k") > 1, F.concat("header", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("header"))).drop("k")


def sheet_headers(cells: DataFrame, detected: DataFrame) -> DataFrame:
    """The headers of every column that has a header or data below it."""
    below = cells.join(detected, list(SHEET)).filter(filled(F.col("text")) & (F.col("row_no") >= F.col("header_row")))
    columns = below.groupBy(*SHEET, "col_no").agg(F.max(F.when(F.col("row_no") == F.col("header_row"), F.col("text"))).alias("text"))
    return dedupe_headers(columns)


def rows_from_grid(cells: DataFrame, detected: DataFrame) -> DataFrame:
    """One row per data row with raw, a map of header to text; rows of one cell are no data."""
    data = cells.join(detected, list(SHEET)).filter((F.col("row_no") > F.col("header_row")) & filled(F.col("text")))
    named = data.join(sheet_headers(cells, detected).select(*SHEET, "col_no", "header"), [*SHEET, "col_no"])
    return named.groupBy(*SHEET, "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", F.trim("text").alias("text"))))).alias("raw")).filter(F.size("raw") > 1)


def skipped_rows(cells: DataFrame) -> DataFrame:
    """Rows of exactly one filled cell: titles and notes, cut to 40 characters."""
    one = cells.filter(filled(F.col("text"))).groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    return one.filter("n = 1").select(*SHEET, "row_no", F.substring("text", 1, 40).alias("reason"))


def stitch_tables(tables: DataFrame) -> DataFrame:
    """(file_id, page, table_no, width) with group: a page's first table of equal width goes on from the page before."""
    w = Window.partitionBy("file_id").orderBy("page", "table_no")
    goes_on = (F.col("table_no") == 1) & (F.lag("page").over(w) == F.col("page") - 1) & (F.lag("width").over(w) == F.col("width"))
    return tables.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("group", F.sum("starts").over(w)).drop("starts")


def merge_split_headers(headers: DataFrame) -> DataFrame:
    """(sheet, col_no, header, has_data) to the header of each data column: those without data join the left one."""
    w = Window.partitionBy(*SHEET).orderBy("col_no")
    island = headers.withColumn("island", F.sum(F.when(F.col("has_data") | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "header"))), lambda x: x["header"])
    return island.groupBy(*SHEET, "island").agg(F.min("col_no").alias("col_no"), F.array_join(parts, " ").alias("header")).drop("island")


def suggest_mapping(headers: DataFrame, synonyms: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(supplier_id, header) with field, confidence and source: template, exact synonym, longest synonym before a unit.

    synonyms (synonym, field) is a rule table of a few hundred rows.
    """
    h = headers.withColumn("key", header_key(F.col("header"), numbers=True))
    s = synonyms.select(header_key(F.col("synonym"), numbers=True).alias("syn"), "field").groupBy("syn").agg(F.min("field").alias("field"))
    exact = h.join(F.broadcast(s), F.col("key") == F.col("syn"), "left").drop("syn").withColumnRenamed("field", "exact")
    starts = F.startswith("key", "syn") & (F.length("syn") >= 3) & (F.col("key") != F.col("syn"))
    unit = F.expr("substring(key, length(syn) + 1)").rlike("^(cm|mm|kg|g|pcs|usd|rmb|days?|inch|in)$")
    long = h.join(F.broadcast(s), starts & unit).groupBy("supplier_id", "header").agg(F.max_by("field", F.struct(F.length("syn"), "syn")).alias("long"))
    out = exact.join(long, ["supplier_id", "header"], "left")
    template = F.lit(None).cast("string")
    if templates is not None:
        out, template = out.join(templates.select("supplier_id", "header", F.col("field").alias("kept")), ["supplier_id", "header"], "left"), F.col("kept")
    field = F.coalesce(template, "exact", "long", F.lit("ignore"))
    source = F.when(template.isNotNull(), "template").when(F.col("exact").isNotNull(), "synonym").when(F.col("long").isNotNull(), "unit").otherwise("none")
    confidence = F.when(template.isNotNull() | F.col("exact").isNotNull(), 1.0).when(F.col("long").isNotNull(), 0.9).otherwise(0.0)
    return out.select("supplier_id", "header", field.alias("field"), confidence.alias("confidence"), source.alias("source"))


def header_signature(headers: DataFrame, by: list[str]) -> DataFrame:
    """A hash of the sorted header keys: the order of columns doesn't matter."""
    return headers.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(header_key(F.col("header"), numbers=True))), "\u001f"), 256).alias("signature"))


def validate_mapping(mapping: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Problems of each mapping: unknown fields, single fields on several columns, nothing that identifies a part."""
    per = mapping.groupBy(*by, "field").agg(F.count(F.lit(1)).alias("n"))
    unknown = F.when(~F.col("field").isin(*fields, "ignore"), F.concat(F.lit("unknown: "), "field"))
    repeated = F.when((F.col("n") > 1) & ~F.col("field").isin(*MULTIPLE), F.concat(F.lit("repeated: "), "field"))
    found = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.coalesce(unknown, repeated))).alias("problems"), F.bool_or(F.col("field").isin(*IDENTITY)).alias("identified"))
    return found.select(*by, F.array_join(F.when(F.col("identified"), F.col("problems")).otherwise(F.array_append("problems", F.lit("no identity column"))), "; ").alias("problems"))


def apply_overrides(mapping: DataFrame, overrides: DataFrame, by: list[str]) -> DataFrame:
    """A chosen field that differs becomes manual with confidence 1."""
    chosen = overrides.select(*by, "header", F.col("field").alias("chosen"))
    out = mapping.join(chosen, [*by, "header"], "left")
    manual = F.col("chosen").isNotNull() & (F.col("chosen") != F.col("field"))
    return out.select(*by, "header", F.when(manual, F.col("chosen")).otherwise(F.col("field")).alias("field"), F.when(manual, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(manual, "manual").otherwise(F.col("source")).alias("source"))


def upsert_templates(templates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(supplier_id, signature, mapping, confirmed_at): the latest per supplier and signature."""
    return templates.unionByName(confirmed).groupBy("supplier_id", "signature").agg(F.max(F.struct("confirmed_at", "mapping")).alias("last")).select("supplier_id", "signature", "last.mapping", "last.confirmed_at")


def mapped_cells(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sheet, row_no, field, header, text), without ignored columns, empty cells and texts that stand for none.

    mapping (file_id, sheet, header, field, col_no).
    """
    cells = rows.select(*SHEET, "row_no", F.explode("raw").alias("header", "text"))
    kept = cells.join(mapping.filter("field <> 'ignore'"), [*SHEET, "header"])
    return kept.filter(filled(F.col("text")) & ~F.lower(F.trim("text")).isin(*BLANKS))


def column_samples(cells: DataFrame, k: int = 3) -> DataFrame:
    """The first k values of every column."""
    rank = F.row_number().over(Window.partitionBy(*SHEET, "col_no").orderBy("row_no"))
    first = cells.filter(filled(F.col("text"))).withColumn("k", rank).filter(F.col("k") <= k)
    return first.groupBy(*SHEET, "col_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " | ").alias("samples"))
