"""Vocabulary-driven columns, attributes and suggestions.

Vocabularies are rule tables of at most some hundred rows; they are broadcast, and the longest alias that fits wins.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Packaging units, and the key fields of a record in the order in which they are shown.
UNITS = ("piece", "set", "pair", "kit")
KEY_FIELDS = ("part_type", "position", "fitment", "oe_numbers", "dims", "price", "currency", "moq", "quote_date")


def canonical_brand(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """Df with brand: the canonical name of a spelling, null where unknown. aliases (alias, brand)."""
    keys = aliases.select(C.brand_key(F.col("alias")).alias("__key"), "brand").groupBy("__key").agg(F.min("brand").alias("brand"))
    return df.withColumn("__k", C.brand_key(F.col(col))).join(F.broadcast(keys), F.col("__k") == F.col("__key"), "left").drop("__k", "__key")


def longest_alias(df: DataFrame, key: str, text: Column, aliases: DataFrame) -> DataFrame:
    """(key, name, alias) of the longest alias that stands in the text as whole words. aliases (alias, name)."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(C.text_of(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = aliases.select("name", F.lower("alias").alias("alias"))
    hits = df.select(key, padded.alias("__t")).join(F.broadcast(words), F.contains("__t", F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return hits.groupBy(key).agg(F.max(F.struct(F.length("alias").alias("n"), "alias", "name")).alias("m")).select(key, "m.name", "m.alias")


def with_part_type(df: DataFrame, key: str, name: str, category: str, types: DataFrame) -> DataFrame:
    """part_type by the longest alias in the name, else in the category, else the title-cased name, unregistered."""
    a = longest_alias(df, key, F.col(name), types).select(key, F.col("name").alias("__a"), F.col("alias").alias("type_alias"))
    b = longest_alias(df, key, F.col(category), types).select(key, F.col("name").alias("__b"))
    out = df.join(a, key, "left").join(b, key, "left")
    return out.withColumn("part_type", F.coalesce("__a", "__b", F.initcap(F.trim(name)))).withColumn("registered", F.col("__a").isNotNull() | F.col("__b").isNotNull()).drop("__a", "__b")


def with_position(df: DataFrame, key: str, name: str, column: str, positions: DataFrame) -> DataFrame:
    """C20: the position column beats the name; a warning where they differ or the column isn't understood."""
    a = longest_alias(df, key, F.col(column), positions).select(key, F.col("name").alias("__a"))
    rest = F.replace(F.lower(F.col(name)), F.coalesce("type_alias", F.lit("\u0001")), F.lit(" ")) if "type_alias" in df.columns else F.col(name)
    b = longest_alias(df, key, rest, positions).select(key, F.col("name").alias("__b"))
    out = df.join(a, key, "left").join(b, key, "left")
    stated = F.trim(C.text_of(F.col(column))) != ""
    warning = F.when(stated & F.col("__a").isNull(), "position not understood").when(F.col("__a") != F.col("__b"), "position differs from the name")
    return out.withColumn("position", F.coalesce("__a", F.when(stated, F.trim(column)), "__b", F.lit(""))).withColumn("position_warning", warning).drop("__a", "__b")


def with_fitments(df: DataFrame, key: str, col: str, makes: DataFrame) -> DataFrame:
    """C14: (key, entry, make, model, year_from, year_to, known) for each entry of a fitment cell.

    Entries stand between ; and line ends. A range of years, an open end (+, up, present) or a single closed year is
    taken off; the longest make alias at the start is the make, else the first word is, unknown.
    """
    entries = df.select(key, F.posexplode(F.split(C.text_of(F.col(col)), r"[;\n]+")).alias("entry", "raw")).filter(F.trim("raw") != "")
    year = r"((?:19|20)\d{2})"
    lo, hi = F.regexp_extract("raw", year, 1), F.regexp_extract("raw", year + r"\s*[-–~/]\s*" + year, 2)
    is_open = F.col("raw").rlike(year + r"\s*(\+|[-–]?\s*(?i)(up|present|on)\b|[-–]\s*$)")
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", year + r"\s*([-–~/]\s*((19|20)\d{2})?|\+)?\s*((?i)(up|present|on)\b)?", " "), r"\s+", " "))
    out = entries.withColumn("year_from", F.when(lo != "", lo.cast("int"))).withColumn("year_to", F.when(hi != "", hi.try_cast("int")).when((lo != "") & ~is_open, lo.try_cast("int"))).withColumn("bare", bare)
    m = makes.select(F.lower("alias").alias("alias"), F.col("name").alias("known_make"))
    hits = out.join(F.broadcast(m), F.startswith(F.concat(F.lower("bare"), F.lit(" ")), F.concat("alias", F.lit(" "))))
    best = hits.groupBy(key, "entry").agg(F.max(F.struct(F.length("alias").alias("n"), "known_make")).alias("m")).select(key, "entry", "m.n", "m.known_make")
    out = out.join(best, [key, "entry"], "left")
    first = F.split("bare", " ")[0]
    make = F.coalesce("known_make", first)
    model = F.trim(F.when(F.col("n").isNotNull(), F.expr("substring(bare, n + 1)")).otherwise(F.expr("substring(bare, length(split(bare, ' ')[0]) + 1)")))
    return out.select(key, "entry", make.alias("make"), model.alias("model"), "year_from", "year_to", F.col("known_make").isNotNull().alias("known"))


def reclassify_numbers(numbers: DataFrame, aftermarket: list[str]) -> DataFrame:
    """An OE number whose every format hint is an aftermarket brand becomes a cross reference of confidence 0.6."""
    hints = C.brand_hints(F.col("number"))
    other = (F.size(hints) > 0) & F.forall(hints, lambda h: h.isin(*aftermarket)) & (F.col("kind") == "OE")
    return numbers.withColumn("new_kind", F.when(other, "CROSS").otherwise(F.col("kind"))).withColumn("confidence", F.when(other, 0.6).otherwise(1.0)).withColumn("hint_brand", F.when(other & (F.size(hints) == 1), hints[0]))


def validate_attributes(attributes: DataFrame, schemas: DataFrame) -> DataFrame:
    """(part_id, category, key, value) against (category, key, type, options): problems; null values are fine."""
    s = schemas.select("category", "key", "type", "options")
    j = attributes.join(F.broadcast(s), ["category", "key"], "left")
    wrong = F.when(F.col("type") == "number", F.col("value").try_cast("double").isNull()).when(F.col("type") == "bool", ~F.lower("value").isin("true", "false")).when(F.col("type") == "enum", ~F.array_contains("options", F.col("value"))).otherwise(F.lit(False))
    problem = F.when(F.col("type").isNull(), "unknown key").when(F.col("value").isNull(), None).when(wrong, F.concat(F.lit("not a valid "), "type"))
    return j.select("part_id", "key", problem.alias("problem")).filter("problem is not null")


def validate_packaging(packaging: DataFrame) -> DataFrame:
    """(part_id, key, value) problems: the unit must be one of four, the rest positive numbers."""
    numbers = ("pcs_per_carton", "carton_l_cm", "carton_w_cm", "carton_h_cm", "gross_weight_kg")
    problem = F.when(F.col("key") == "unit", F.when(~F.col("value").isin(*UNITS), "unknown unit")).when(~F.col("key").isin(*numbers), "unknown key").when(~F.coalesce(F.col("value").try_cast("double") > 0, F.lit(False)), "not a positive number")
    return packaging.select("part_id", "key", problem.alias("problem")).filter("problem is not null")


def attribute_rows(parts: DataFrame, attributes: DataFrame, schemas: DataFrame) -> DataFrame:
    """A part's attributes in schema order, required ones shown even if missing, then unknown keys by name."""
    wanted = parts.select("part_id", "category").join(F.broadcast(schemas.select("category", "key", "place", "required")), "category")
    j = wanted.join(attributes.select("part_id", "key", "value"), ["part_id", "key"], "full")
    shown = j.filter(F.col("value").isNotNull() | F.col("required"))
    rank = F.row_number().over(Window.partitionBy("part_id").orderBy(F.col("place").asc_nulls_last(), "key"))
    return shown.select("part_id", rank.alias("place"), "key", "value", F.col("place").isNotNull().alias("known"))


def missing_fields(df: DataFrame, sided: Column) -> DataFrame:
    """The key fields that a record (columns named by KEY_FIELDS) lacks; position counts for sided types only."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return df.withColumn("missing", F.array_compact(F.array(*(F.when(blank(f) & (sided if f == "position" else F.lit(True)), F.lit(f)) for f in KEY_FIELDS))))


def lineage(cells: DataFrame) -> DataFrame:
    """(row_id, field, column, cell, raw, value, rule) to one map of field to value, rule and sources per row."""
    source = F.struct("column", "cell", "raw")
    per = cells.groupBy("row_id", "field").agg(F.max("value").alias("value"), F.max("rule").alias("rule"), F.array_sort(F.collect_list(source)).alias("sources"))
    return per.groupBy("row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "rule", "sources").alias("v"))))).alias("fields"))


def product_missing(memberships: DataFrame, missing: DataFrame) -> DataFrame:
    """fields that all active members of a product lack. missing (identity, field)."""
    active = memberships.filter("status <> 'suspended'").select("identity", "product_id")
    sizes = active.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    lacks = active.join(missing.distinct(), "identity").groupBy("product_id", "field").agg(F.count(F.lit(1)).alias("k"))
    return lacks.join(sizes, "product_id").filter("k = n").groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("missing"))


def applicable_suggestions(suggestions: DataFrame, parts: DataFrame) -> DataFrame:
    """(suggestion_id, part_id, field, value) with whether it may be applied, is ticked, and replaces a value.

    parts (part_id, field, have, verified): a verified part keeps what it has; blanks are ticked beforehand.
    """
    j = suggestions.join(parts, ["part_id", "field"])
    blank = F.coalesce("have", F.lit("")) == ""
    return j.select("suggestion_id", "part_id", "field", (blank | ~F.col("verified")).alias("applicable"), blank.alias("ticked"), (~blank & (F.col("have") != F.col("value"))).alias("replaces"))


def resolve_category(names: DataFrame, categories: DataFrame) -> DataFrame:
    """(suggestion_id, name) to a category by name or English name without regard to case, leaves first."""
    both = categories.select(F.lower("name").alias("k"), "category_id", "parent").unionByName(categories.select(F.lower("name_en").alias("k"), "category_id", "parent")).filter("k <> ''")
    best = both.groupBy("k").agg(F.min(F.struct(F.col("parent").isNull().alias("top"), "category_id")).alias("b")).select("k", "b.category_id")
    return names.withColumn("k", F.lower(F.trim("name"))).join(best, "k", "left").drop("k")


def _without(text: Column, times: int) -> Column:
    """The distinct texts that are left when so many characters are taken out of text."""
    left = F.array(text)
    for _ in range(times):
        left = F.array_distinct(F.flatten(F.transform(left, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))
    return left


def alike_pairs(asked: DataFrame, held: DataFrame, least: float, taken: int = 3, longest: int = 12) -> DataFrame:
    """(norm, number_norm): pairs of texts (norm of asked, number_norm of held) that share the first or last three characters, among them all
    whose ratio is at least `least`.

    Such texts of m and n characters have `need` in common in their order, so they meet on what is left when m - need and n - need are
    taken out. Texts that are longer, or that would lose more, meet on their first and on their last three characters.
    """
    head = lambda c: F.substring(c, 1, 3)
    tail = lambda c: F.reverse(F.substring(F.reverse(c), 1, 3))
    a, b = F.col("norm"), F.col("number_norm")
    asked, held = asked.select("norm").distinct().withColumn("m", F.length("norm")), held.select("number_norm").distinct().withColumn("n", F.length("number_norm"))
    need = F.ceil(F.lit(least) / 2 * (F.col("m") + F.col("n")) - 1e-9).cast("int")
    sizes = asked.select("m").distinct().crossJoin(held.select("n").distinct()).withColumn("need", need).filter((F.col("need") <= F.least("m", "n")) & (F.greatest("m", "n") > 0))
    near = (F.greatest("m", "n") <= longest) & (F.greatest("m", "n") - F.col("need") <= taken)

    def keyed(df: DataFrame, text: str, own: str) -> DataFrame:
        out = F.col(own) - F.col("need")
        rows = df.join(F.broadcast(sizes.filter(near)), own)  # pairs of lengths
        return rows.select(text, "m", "n", F.explode(F.coalesce(*(F.when(out == k, _without(F.col(text), k)) for k in range(taken + 1)))).alias("g"))

    met = keyed(asked, "norm", "m").join(keyed(held, "number_norm", "n"), ["m", "n", "g"]).filter((head(a) == head(b)) | (tail(a) == tail(b)))
    far = sizes.filter(~near).select("m", "n")
    q, n = asked.join(F.broadcast(far), "m"), held.join(F.broadcast(far), "n")
    block = lambda f: q.withColumn("g", f(a)).join(n.withColumn("g", f(b)), ["m", "n", "g"])
    return met.select("norm", "number_norm").unionByName(block(head).select("norm", "number_norm")).unionByName(block(tail).select("norm", "number_norm")).filter("norm <> number_norm").distinct()


def match_blocked(queries: DataFrame, numbers: DataFrame, least: float = 0.75) -> DataFrame:
    """(query_id, part_id, number, ratio) of numbers that share the first or last three characters and are alike.

    Equi-joins give the candidates; a vectorized function compares the distinct pairs of texts.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    q, n = queries.filter("norm <> ''").select("query_id", "norm"), numbers.select("part_id", "number", "number_norm")
    alike = alike_pairs(q, n, least).withColumn("ratio", ratio("norm", "number_norm")).filter(F.col("ratio") >= least)
    return q.join(alike, "norm").join(n, "number_norm").select("query_id", "part_id", "number", "ratio")


def side_by_side(judged: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """One row per item and field: both texts and whether the field conflicts or is missing."""
    texts = current.select("identity", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))).alias("x")).select("identity", "x.field", "x.text")
    a, b = texts.select(F.col("identity").alias("a"), "field", F.col("text").alias("text_a")), texts.select(F.col("identity").alias("b"), "field", F.col("text").alias("text_b"))
    j = judged.select("a", "b", "conflicts", "missing").join(a, "a").join(b, ["b", "field"])
    flag = F.when(F.array_contains(F.split("conflicts", ","), F.col("field")), "conflict").when(F.array_contains(F.split("missing", ","), F.col("field")), "missing").otherwise("")
    return j.select("a", "b", "field", "text_a", "text_b", flag.alias("flag"))
