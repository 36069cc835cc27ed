"""Registered queries over source records: versions, pairs, review items and products, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixture import Catalog
from ..operators import archive as A
from .catalog import register

CURRENT = "SELECT * FROM records QUALIFY version = max(version) OVER (PARTITION BY identity)"
DIMS = "CASE WHEN {0}dim_a IS NOT NULL THEN list_sort([{0}dim_a, {0}dim_b, {0}dim_c]) END"
FLAT = "replace(replace(lower({0}), ' ', ''), '-', '')"


@register("g2_current_records", f"SELECT identity, version, record_id, price_cents FROM ({CURRENT})", "records")
def current(c: Catalog) -> DataFrame:
    return A.current_records(c.records).select("identity", "version", "record_id", "price_cents")


@register("g3_record_history", "SELECT identity, version, record_id, lag(record_id) OVER w AS previous, lead(record_id) OVER w AS next FROM records WINDOW w AS (PARTITION BY identity ORDER BY version)", "records")
def history(c: Catalog) -> DataFrame:
    return A.record_history(c.records)


HASH = "sha256(concat_ws('|', part_type, position, make, model, coalesce(year_from::VARCHAR, '') || '-' || coalesce(year_to::VARCHAR, ''), coalesce(array_to_string(" + DIMS.format("") + ", 'x'), ''), oe, price_cents::VARCHAR, moq::VARCHAR, quote_date::VARCHAR))"


@register("c29_content_hash", f"SELECT record_id, {HASH} AS content_hash FROM records", "records")
def hashes(c: Catalog) -> DataFrame:
    return c.records.select("record_id", A.content_hash().alias("content_hash"))


ROWS = "SELECT record_id AS locator, supplier_id AS file_id, CASE WHEN part_id % 3 = 0 THEN part_id::VARCHAR ELSE '' END AS record_ref, CASE WHEN part_id % 3 = 1 THEN 'S' || (part_id // 2)::VARCHAR ELSE '' END AS sku, sha256(record_id::VARCHAR) AS content_hash FROM records"


@register(
    "g7_identify_rows",
    f"""SELECT locator, file_id, record_ref, sku, content_hash, duplicate, CASE WHEN duplicate THEN '#' || substr(content_hash, 1, 32) ELSE k END AS record_key, CASE WHEN duplicate OR kind IS NULL THEN 'content' ELSE kind END AS key_kind FROM (
  SELECT *, kind IS NOT NULL AND row_number() OVER (PARTITION BY file_id, k ORDER BY locator) > 1 AS duplicate FROM (
    SELECT *, CASE WHEN record_ref <> '' THEN record_ref WHEN sku <> '' THEN sku ELSE '#' || substr(content_hash, 1, 32) END AS k, CASE WHEN record_ref <> '' THEN 'source_id' WHEN sku <> '' THEN 'supplier_sku' END AS kind FROM ({ROWS})))""",
    "records",
)
def identify(c: Catalog) -> DataFrame:
    k = F.col("part_id")
    rows = c.records.select(
        F.col("record_id").alias("locator"), F.col("supplier_id").alias("file_id"), F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("record_ref"),
        F.when(k % 3 == 1, F.concat(F.lit("S"), F.floor(k / 2).cast("string"))).otherwise("").alias("sku"), F.sha2(F.col("record_id").cast("string"), 256).alias("content_hash"),
    )
    return A.identify_rows(rows)


#: Older versions differ in the fixture by price, quantity and date only; these shift key fields of some.
SHIFTED = "SELECT * REPLACE (CASE WHEN record_id % 11 = 0 AND position <> 'left' THEN 'left' ELSE position END AS position, CASE WHEN record_id % 13 = 0 THEN '' ELSE oe END AS oe) FROM records"


def shifted(c: Catalog) -> DataFrame:
    r, p = F.col("record_id"), F.col("position")
    return c.records.withColumn("position", F.when(r % 11 == 0, "left").otherwise(p)).withColumn("oe", F.when(r % 13 == 0, "").otherwise(F.col("oe")))


def _differs(old: str, new: str) -> tuple[str, str]:
    years = lambda t: f"coalesce({t}.year_from::VARCHAR, '') || '-' || coalesce({t}.year_to::VARCHAR, '')"
    dims = lambda t: DIMS.format(t + ".")
    pairs = {n: (f"{old}.{n}", f"{new}.{n}") for n in ("part_type", "position", "make", "model")} | {"years": (years(old), years(new)), "dims": (dims(old), dims(new)), "oe": (f"{old}.oe", f"{new}.oe")}
    case = lambda n, x: f"CASE WHEN {x[0]} IS DISTINCT FROM {x[1]} THEN '{n}' END"
    keys = ", ".join(case(n, x) for n, x in pairs.items())
    quotes = ", ".join(case(n, (f"{old}.{n}", f"{new}.{n}")) for n in ("price_cents", "moq", "quote_date"))
    return f"concat_ws(',', {keys})", f"concat_ws(',', {quotes})"


_K, _Q = _differs("o", "n")


@register("j9_diff_versions", f"WITH s AS ({SHIFTED}) SELECT identity, version, CASE WHEN k <> '' THEN 'key_change' WHEN q <> '' THEN 'price_update' ELSE '' END AS change, concat_ws(',', nullif(k, ''), nullif(q, '')) AS fields FROM (SELECT n.identity, n.version, {_K} AS k, {_Q} AS q FROM s n JOIN s o ON n.identity = o.identity AND n.version = o.version + 1)", "records")
def diffs(c: Catalog) -> DataFrame:
    return A.diff_versions(shifted(c))


#: The load: newest versions of two thirds of the identities, some changed, and new identities of the same suppliers.
LOAD = f"SELECT * REPLACE (CASE WHEN part_id % 5 = 0 THEN price_cents + 100 ELSE price_cents END AS price_cents, CASE WHEN part_id % 7 = 0 THEN 'other' ELSE position END AS position, CASE WHEN part_id % 11 = 0 THEN identity || 'n' ELSE identity END AS identity) FROM ({CURRENT}) WHERE part_id % 3 <> 0"


def load(c: Catalog) -> DataFrame:
    k = F.col("part_id")
    rows = A.current_records(c.records).filter(k % 3 != 0)
    return rows.withColumn("price_cents", F.when(k % 5 == 0, F.col("price_cents") + 100).otherwise(F.col("price_cents"))).withColumn("position", F.when(k % 7 == 0, "other").otherwise(F.col("position"))).withColumn("identity", F.when(k % 11 == 0, F.concat("identity", F.lit("n"))).otherwise(F.col("identity")))


PLAN = f"SELECT n.identity, n.record_id, n.supplier_id, coalesce(o.version, 0) + 1 AS new_version, CASE WHEN o.identity IS NULL THEN 'new' WHEN {_K} <> '' THEN 'key_change' WHEN {_Q} <> '' THEN 'price_update' ELSE 'unchanged' END AS change FROM ({LOAD}) n LEFT JOIN ({CURRENT}) o USING (identity)"
ABSENT = f"SELECT identity, version FROM ({CURRENT}) c WHERE supplier_id IN (SELECT supplier_id FROM ({LOAD})) AND identity NOT IN (SELECT identity FROM ({LOAD}))"


@register("j10_plan_ingest", PLAN, "records")
def plan_ingest(c: Catalog) -> DataFrame:
    return A.plan_ingest(load(c), A.current_records(c.records)).select("identity", "record_id", "supplier_id", "new_version", "change")


@register("e13_absent_records", ABSENT, "records")
def absent(c: Catalog) -> DataFrame:
    return A.absent_records(A.current_records(c.records), load(c)).select("identity", "version")


@register("f8_ingest_counts", f"SELECT {', '.join(f'''count(*) FILTER (WHERE change = '{k}') AS {k}''' for k in ('new', 'unchanged', 'price_update', 'info_update', 'key_change'))}, count(*) AS rows, (SELECT count(*) FROM ({ABSENT})) AS absent FROM ({PLAN})", "records")
def ingest_counts(c: Catalog) -> DataFrame:
    now = A.current_records(c.records)
    return A.ingest_counts(A.plan_ingest(load(c), now), A.absent_records(now, load(c)))


# --- pairs -----------------------------------------------------------------------------------------------------------

NORMS = f"""SELECT *, CASE WHEN length(oe) >= 5 THEN oe END AS number, {FLAT.format('part_type')} AS type_key, make <> '' AND model <> '' AS has_fit,
  CASE WHEN make <> '' AND model <> '' THEN {FLAT.format("make || ' ' || model")} ELSE '' END AS fit_key, {DIMS.format('')} AS dims FROM ({CURRENT})"""
BLOCKS = """SELECT identity, has_fit, 'n|' || number AS block FROM r WHERE number IS NOT NULL UNION ALL SELECT identity, has_fit, 'f|' || type_key || '|' || fit_key FROM r WHERE type_key <> '' AND has_fit
  UNION ALL SELECT identity, has_fit, 's|' || type_key || '|' || position || '|' || array_to_string(dims, 'x') FROM r WHERE type_key <> '' AND dims IS NOT NULL"""
PAIRS = """SELECT DISTINCT x.identity AS a, y.identity AS b FROM k x JOIN k y ON x.block = y.block AND x.identity < y.identity AND (NOT starts_with(x.block, 's|') OR NOT x.has_fit OR NOT y.has_fit)"""
HEAD = f"WITH r AS MATERIALIZED ({NORMS}), bl AS MATERIALIZED ({BLOCKS}), k AS MATERIALIZED (SELECT * FROM bl WHERE block IN (SELECT block FROM bl GROUP BY block HAVING count(*) BETWEEN 2 AND 200)), pairs AS MATERIALIZED ({PAIRS})"


def _verdict(x: str, y: str, equal: str, gone: str = "missing") -> str:
    return f"CASE WHEN {x} AND {y} THEN CASE WHEN {equal} THEN 'same' ELSE 'differ' END ELSE '{gone}' END"


_V = {
    "part_type": _verdict("x.part_type <> ''", "y.part_type <> ''", "x.type_key = y.type_key"),
    "position": _verdict("x.position <> ''", "y.position <> ''", "lower(x.position) = lower(y.position)", "skip"),
    "fitment": _verdict("x.has_fit", "y.has_fit", "x.fit_key = y.fit_key"),
    "years": "CASE WHEN x.year_from IS NULL AND y.year_from IS NULL THEN 'skip' WHEN x.year_from IS NULL OR y.year_from IS NULL THEN 'missing' WHEN x.year_from <= coalesce(y.year_to, 9999) AND y.year_from <= coalesce(x.year_to, 9999) THEN 'same' ELSE 'differ' END",
    "dims": _verdict("x.dims IS NOT NULL", "y.dims IS NOT NULL", "abs(x.dims[1] - y.dims[1]) <= 100 AND abs(x.dims[2] - y.dims[2]) <= 100 AND abs(x.dims[3] - y.dims[3]) <= 100"),
}
_ANY = lambda what, names: " OR ".join(f"v_{n} = '{what}'" for n in names)
_LIST = lambda what: "concat_ws(',', " + ", ".join(f"CASE WHEN v_{n} = '{what}' THEN '{n}' END" for n in _V) + ")"
JUDGED = f"""judged AS MATERIALIZED (SELECT a, b, category, CASE category WHEN 'strong' THEN 'strong' WHEN 'no_number' THEN 'medium' WHEN 'same_source' THEN 'medium' WHEN 'insufficient' THEN 'weak' ELSE 'conflict' END AS strength,
  shared AS shared_number, {_LIST('same')} AS agreements, {_LIST('differ')} AS conflicts, {_LIST('missing')} AS missing, CASE WHEN (xn IS NULL) <> (yn IS NULL) THEN CASE WHEN xn IS NULL THEN 'a' ELSE 'b' END END AS number_missing_on FROM (
  SELECT *, CASE WHEN v_part_type = 'differ' THEN CASE WHEN shared THEN 'number_conflict' END WHEN v_position = 'differ' THEN CASE WHEN shared THEN 'position_conflict' END
    WHEN xn IS NOT NULL AND yn IS NOT NULL AND NOT shared THEN NULL WHEN {_ANY('missing', _V)} THEN 'insufficient' WHEN {_ANY('differ', ('fitment', 'dims', 'years'))} THEN CASE WHEN shared THEN 'spec_conflict' END
    WHEN shared THEN 'strong' WHEN xs = ys THEN 'same_source' ELSE 'no_number' END AS category FROM (
    SELECT a, b, x.number AS xn, y.number AS yn, x.supplier_id AS xs, y.supplier_id AS ys, coalesce(x.number = y.number, FALSE) AS shared, {', '.join(f'{v} AS v_{n}' for n, v in _V.items())}
    FROM pairs JOIN r x ON x.identity = a JOIN r y ON y.identity = b)) WHERE category IS NOT NULL)"""


def judged(c: Catalog) -> DataFrame:
    return A.judged_pairs(A.current_records(c.records))


@register("j1_candidate_pairs", f"{HEAD} SELECT a, b FROM pairs", "records")
def candidate_pairs(c: Catalog) -> DataFrame:
    return A.candidate_pairs(A.current_records(c.records))


@register("j2_judge_pairs", f"{HEAD}, {JUDGED} SELECT * FROM judged", "records")
def judge(c: Catalog) -> DataFrame:
    return judged(c)


ROWKEY = "concat_ws('|', identity, part_type, position, make, model, coalesce(year_from::VARCHAR, '') || '-' || coalesce(year_to::VARCHAR, ''), coalesce(array_to_string(dims, 'x'), ''), oe)"
HASHED = f"hashed AS MATERIALIZED (SELECT j.*, sha256(category || '#' || least(x.row, y.row) || '#' || greatest(x.row, y.row)) AS evidence_hash FROM judged j JOIN (SELECT identity, {ROWKEY} AS row FROM r) x ON x.identity = a JOIN (SELECT identity, {ROWKEY} AS row FROM r) y ON y.identity = b)"


@register("j5_evidence_hash", f"{HEAD}, {JUDGED}, {HASHED} SELECT a, b, category, evidence_hash FROM hashed", "records")
def evidence(c: Catalog) -> DataFrame:
    return A.judged_pairs(A.current_records(c.records), evidence=True).select("a", "b", "category", "evidence_hash")


@register("j4_incomplete_items", f"SELECT identity, missing FROM (SELECT identity, concat_ws(',', CASE WHEN part_type = '' THEN 'part_type' END, CASE WHEN position = '' THEN 'position' END, CASE WHEN make = '' OR model = '' THEN 'fitment' END, CASE WHEN dim_a IS NULL THEN 'dims' END) AS missing FROM ({CURRENT})) WHERE missing <> ''", "records")
def incomplete(c: Catalog) -> DataFrame:
    return A.incomplete_items(A.current_records(c.records))


_BIT = "('0x' || substr(evidence_hash, 1, 4))::INT"
ITEMS = f"SELECT a, b, CASE {_BIT} % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'same' WHEN 2 THEN 'different' ELSE 'open' END AS status, CASE WHEN {_BIT} % 3 = 0 THEN 'old' ELSE evidence_hash END AS evidence_hash FROM hashed WHERE {_BIT} % 5 <> 0 UNION ALL SELECT a || 'x', b, 'open', 'old' FROM hashed WHERE {_BIT} % 7 = 0"


@register("j6_rematch", f"""{HEAD}, {JUDGED}, {HASHED}, items AS ({ITEMS}) SELECT coalesce(h.a, i.a) AS a, coalesce(h.b, i.b) AS b, CASE WHEN status IS NULL THEN 'create' WHEN h.evidence_hash IS NULL THEN CASE WHEN status = 'open' THEN 'remove' ELSE 'keep' END
  WHEN status NOT IN ('open', 'superseded') THEN CASE WHEN h.evidence_hash = i.evidence_hash THEN 'keep' ELSE 'reopen' END WHEN h.evidence_hash = i.evidence_hash THEN 'keep' ELSE 'update' END AS action FROM hashed h FULL JOIN items i ON h.a = i.a AND h.b = i.b""", "records")  # fmt: skip
def rematch(c: Catalog) -> DataFrame:
    hashed = A.judged_pairs(A.current_records(c.records), evidence=True).select("a", "b", "evidence_hash").withColumn("bit", F.conv(F.substring("evidence_hash", 1, 4), 16, 10).cast("int"))
    bit = F.col("bit")
    items = hashed.filter(bit % 5 != 0).select("a", "b", F.when(bit % 4 == 1, "same").when(bit % 4 == 2, "different").otherwise("open").alias("status"), F.when(bit % 3 == 0, "old").otherwise(F.col("evidence_hash")).alias("evidence_hash"))
    items = items.unionByName(hashed.filter(bit % 7 == 0).select(F.concat("a", F.lit("x")).alias("a"), "b", F.lit("open").alias("status"), F.lit("old").alias("evidence_hash")))
    return A.rematch(hashed.drop("bit"), items)


@register("f9_review_counts", f"{HEAD}, {JUDGED} SELECT category, count(a) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in A.CATEGORIES)}]) AS category) LEFT JOIN judged USING (category) GROUP BY category", "records")
def review_counts(c: Catalog) -> DataFrame:
    return A.review_counts(judged(c))


@register("d6_open_items", f"{HEAD}, {JUDGED} SELECT a, b, category FROM judged WHERE strength = 'strong' AND (starts_with(a, '1:') OR starts_with(b, '1:'))", "records")
def open_items(c: Catalog) -> DataFrame:
    return judged(c).filter("strength = 'strong' and (startswith(a, '1:') or startswith(b, '1:'))").select("a", "b", "category")


@register("a9_export_review_list", f"{HEAD}, {JUDGED} SELECT category, a, b, agreements, conflicts, missing FROM judged", "records")
def review_list(c: Catalog) -> DataFrame:
    return A.export_review_list(judged(c))


@register("j7_review_clusters")
def clusters(c: Catalog) -> DataFrame:
    return A.review_clusters(judged(c).select("a", "b", "category", "strength"))


# --- products --------------------------------------------------------------------------------------------------------

MEMBERS = f"SELECT DISTINCT identity, part_id AS product_id, ['unreviewed', 'grouped', 'independent'][part_id % 3 + 1] AS status FROM ({CURRENT}) WHERE part_id % 4 <> 0"


def members(c: Catalog) -> DataFrame:
    k = F.col("part_id")
    return A.current_records(c.records).filter(k % 4 != 0).select("identity", k.alias("product_id"), F.element_at(F.array(F.lit("unreviewed"), F.lit("grouped"), F.lit("independent")), (k % 3 + 1).cast("int")).alias("status"))


@register("j13_enroll", f"SELECT identity, (SELECT max(product_id) FROM ({MEMBERS})) + row_number() OVER (ORDER BY identity) AS product_id, 'unreviewed' AS status FROM (SELECT DISTINCT identity FROM ({CURRENT}) WHERE part_id % 4 = 0)", "records")
def enroll(c: Catalog) -> DataFrame:
    return A.enroll(A.current_records(c.records), members(c))


@register("f10_product_status_counts", f"SELECT status, count(DISTINCT product_id) AS n_products FROM ({MEMBERS}) GROUP BY status", "records")
def status_counts(c: Catalog) -> DataFrame:
    return A.product_status_counts(members(c))


_T = lambda x, n: f"(SELECT coalesce(string_agg(v, ' / ' ORDER BY i), '') FROM (SELECT v, min(identity) AS i FROM (SELECT identity, {x} AS v FROM m WHERE m.product_id = p.product_id) WHERE coalesce(v, '') <> '' GROUP BY v)) AS {n}"


@register("f12_product_summary", f"""WITH m AS MATERIALIZED (SELECT * FROM ({MEMBERS}) JOIN ({NORMS}) USING (identity)), s AS (SELECT product_id, count(*) AS members, {_T('part_type', 'part_type')}, {_T('position', 'position')}, {_T("trim(make || ' ' || model)", 'fitment')}, {_T("array_to_string(dims, 'x')", 'dims')}, {_T('oe', 'oe')} FROM m p GROUP BY product_id)
  SELECT *, concat_ws(',', {', '.join(f"CASE WHEN contains({n}, ' / ') THEN '{n}' END" for n in ('part_type', 'position', 'fitment', 'dims'))}) AS conflicts FROM s""", "records")  # fmt: skip
def product_summary(c: Catalog) -> DataFrame:
    return A.product_summary(members(c), A.current_records(c.records))


@register("a8_export_supplier_quotes", f"SELECT product_id, identity, record_id, version, price_cents, moq, quote_date FROM ({CURRENT}) LEFT JOIN ({MEMBERS}) USING (identity)", "records")
def supplier_quotes(c: Catalog) -> DataFrame:
    return A.export_supplier_quotes(A.current_records(c.records), members(c))


@register("j19_resolve_merged", "WITH RECURSIVE w(product_id, survivor) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT product_id, survivor // 2 FROM w WHERE survivor > 1 AND survivor % 4 = 0) SELECT product_id, min(survivor) AS survivor FROM w GROUP BY product_id")
def resolve(c: Catalog) -> DataFrame:
    k = F.col("p_partkey")
    return A.resolve_merged(c.read("part").select(k.alias("product_id"), F.when(k % 4 == 0, F.floor(k / 2)).alias("merged_into")))


@register("e15_hints", f"""WITH r AS MATERIALIZED ({NORMS}) SELECT * FROM (SELECT x.identity AS a, y.identity AS b, CASE WHEN x.type_key <> y.type_key AND coalesce(abs(x.dims[1] - y.dims[1]) <= 100 AND abs(x.dims[2] - y.dims[2]) <= 100 AND abs(x.dims[3] - y.dims[3]) <= 100, FALSE) THEN 'same size, other type'
  WHEN x.type_key = y.type_key AND x.position <> '' AND y.position <> '' AND x.position <> y.position THEN 'same type, other side' WHEN x.type_key = y.type_key AND x.number IS NOT NULL AND y.number IS NOT NULL THEN 'numbers on both, none shared' END AS why
  FROM r x JOIN r y ON x.fit_key = y.fit_key AND x.identity < y.identity WHERE x.has_fit AND NOT coalesce(x.number = y.number, FALSE)) WHERE why IS NOT NULL""", "records")  # fmt: skip
def hints(c: Catalog) -> DataFrame:
    return A.hints(A.current_records(c.records))
