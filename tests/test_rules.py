"""Rules on small tables: columns, offers, searches, versions, pairs, import plans and decisions."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from partloom.functions import columns as C
from partloom.operators import archive as A
from partloom.operators import exports as X
from partloom.operators import importing as I
from partloom.operators import matching as M
from partloom.operators import quoting as O
from partloom.sources import grid as G
from partloom.streaming.inquiries import settle


def values(spark, cells, f):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (C.number_norm, {"A 000 420 15 20": "A0004201520", "81.50201-6229": "81502016229", "２０４４-3906": "20443906", None: "", "刹车": ""}),
        (C.split_numbers, {"20443906/20568713": ["20443906", "20568713"], "WK 1080/7": ["WK 1080/7"], "A12345, a-12345;B99999": ["A12345", "B99999"], None: []}),
        (lambda c: C.query_kind(c, "FIT-"), {"sku: x": "sku", "oe:abc": "number", "FIT-10": "sku", "FIT-AB": "text", "20443906": "number", "AB12": "text", "brake": "text"}),
        (C.decimal_of, {"USD 1,234.50": 1234.5, "18,5": 18.5, "1,234": 1234, "abc": None, "1.2.3": None, None: None}),
        (C.lead_days, {"2-3 weeks": 21, "30 days": 30, "1 month": 30, "": None}),
        (C.moq, {"100 pcs": 100, "2.5": None, "": None}),
        (C.quote_date, {"2024-03-05": dt.date(2024, 3, 5), "25/03/2024": dt.date(2024, 3, 25), "05/03/2024": None, "x": None}),
        (C.is_scientific, {"9.86E+08": True, "986": False}),
        (lambda c: C.currency_v1(c), {"$5": "USD", "5 元": "CNY", "€5": "EUR", "5": None}),
        (lambda c: C.years_v1(c)["year_from"], {"98-05": 1998, "2015+": 2015, "": None}),
    ],
)
def test_columns(spark, f, cases):
    got = values(spark, list(cases), f)
    assert [float(x) if hasattr(x, "quantize") else x for x in got] == list(cases.values())


def test_price_rounds_half_up(spark):
    assert [str(r[0]) for r in spark.createDataFrame([(1002,), (10,), (None,)], "c int").select(O.suggested_price(F.col("c"))).collect()] == ["12.53", "0.13", "None"]


def test_best_offer(spark):
    rows = [(1, 9, 100, None, 10), (2, 9, 100, 7, 11), (3, 9, 100, 7, 9), (4, 8, 5, None, 1)]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "supplier_id int, part_id int, cost_cents int, lead_days int, offer_id int, quoted_at date, moq int")
    assert {r.part_id: r.offer_id for r in O.best_offer(df).collect()} == {9: 9, 8: 1}


def searches(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 0, "2", True), (2, 1, 20, "20", True), (3, 1, 90, "204", True), (4, None, 0, "2", True), (5, 1, 95, "9", False), (6, 2, 0, "2", True), (7, 2, 61, "20", True)]
    return rows, spark.createDataFrame([(i, u, t + dt.timedelta(seconds=s), k, k, x, None) for i, u, s, k, x in rows], "inquiry_id long, user_id long, ts timestamp, raw string, query_key string, is_text boolean, matched_part long")


def test_settled_batch_equals_stream_rule(spark):
    rows, df = searches(spark)
    gone = {r.inquiry_id for r in O.settled(df).filter("superseded").collect()}
    assert gone == {1}
    for user in (1, 2):
        own = [(s * 10**6, i, k, x) for i, u, s, k, x in rows if u == user]
        assert {n for n, _, _, g in settle(own, 60 * 10**6, None)[0] if g} == {i for i, u, *_ in rows if u == user and i in gone}


def test_contained_and_similar(spark):
    numbers = spark.createDataFrame([(1, "OE", "20443906", "20443906"), (2, "OE", "20443907", "20443907"), (3, "OE", "20443", "20443"), (4, "OE", "99", "99")], "part_id long, kind_n string, number string, number_norm string")
    queries = M.queries_of(spark.createDataFrame([(1, "20443906-1"), (2, "20443908"), (3, "  ")], "query_id long, raw string"))
    assert {(r.query_id, r.part_id, r.milli) for r in M.match_contained(queries, numbers).collect()} == {(1, 1, 711), (1, 3, 444), (2, 3, 500)}
    assert {(r.query_id, r.part_id) for r in M.match_similar(queries, numbers).collect()} >= {(2, 1), (2, 2)}


def test_joins_are_equi_joins(spark):
    numbers = spark.createDataFrame([(1, "OE", "20443906", "20443906")], "part_id long, kind_n string, number string, number_norm string")
    queries = M.queries_of(spark.createDataFrame([(1, "20443906-1")], "query_id long, raw string"))
    for f in (M.match_exact, M.match_contained, M.match_similar):
        plan = f(queries, numbers)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "NestedLoop" not in f(queries, numbers)._jdf.queryExecution().executedPlan().toString()


RECORD = "identity string, supplier_id long, version int, record_id long, part_type string, position string, make string, model string, year_from int, year_to int, dim_a int, dim_b int, dim_c int, oe string, price_cents long, moq int, quote_date date"


def record(identity, oe="12345", position="left", part_type="Brake Pad", model="FH", dims=(100, 200, 300), version=1, price=5, years=(2000, None)):
    return (identity, int(identity.split(":")[0]), version, hash(identity) % 1000, part_type, position, "Volvo", model, *years, *dims, oe, price, 1, dt.date(2024, 1, 1))


@pytest.mark.parametrize(
    "other, category",
    [
        (dict(), "strong"), (dict(part_type="Mirror"), "number_conflict"), (dict(position="right"), "position_conflict"), (dict(oe=""), "no_number"), (dict(oe="99999"), None),
        (dict(dims=(100, 200, None)), "insufficient"), (dict(dims=(100, 200, 500)), "spec_conflict"), (dict(dims=(300, 250, 150)), "strong"), (dict(years=(1980, 1990)), "spec_conflict"), (dict(years=(None, None)), "insufficient"),
    ],
)
def test_judge(spark, other, category):
    df = spark.createDataFrame([record("1:a"), record("2:b", **other)], RECORD)
    got = A.judge_pairs(A.candidate_pairs(df), df).collect()
    assert [r.category for r in got] == ([category] if category else [])


def test_large_blocks_are_dropped(spark):
    df = spark.createDataFrame([record(f"{i}:x") for i in range(201)], RECORD)
    assert A.candidate_pairs(df).count() == 0


def test_versions(spark):
    df = spark.createDataFrame([record("1:a"), record("1:a", version=2, price=6), record("1:a", version=3, price=6, position="right"), record("1:a", version=4, price=6, position="right")], RECORD)
    assert [(r.change, r.fields) for r in A.diff_versions(df).orderBy("version").collect()] == [("price_update", "price_cents"), ("key_change", "position"), ("", "")]


def test_claims():
    rows = pd.DataFrame([(1, ["A"], [], False, ""), (2, ["A", "B"], [7], False, ""), (3, ["B"], [7], True, ""), (4, ["C"], [1, 2], False, ""), (5, ["C"], [], False, "bad")], columns=["row_no", "norms", "found", "unchanged", "problem"])
    assert I.claim(rows)["result"].tolist() == ["new", "skipped", "skipped", "duplicate", "invalid"]


def test_csv_grids(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿OE号;Price\n123;4,5\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("品名,价格\n刹车片,5\n".encode("gb18030"))
    got = {(r.file_id[-5:], r.row_no, r.col_no): r.text for r in G.scan_csv_grids(spark, str(tmp_path)).collect()}
    assert got[("a.csv", 2, 2)] == "4,5" and got[("b.csv", 2, 1)] == "刹车片" and got[("a.csv", 1, 1)] == "OE号"


def test_mapping(spark):
    headers = spark.createDataFrame([(1, "OE No."), (1, "Weight KG"), (1, "Mystery"), (1, "Price")], "supplier_id int, header string")
    synonyms = spark.createDataFrame([("oe no", "oe_numbers"), ("weight", "weight"), ("price", "price")], "synonym string, field string")
    templates = spark.createDataFrame([(1, "Price", "cost")], "supplier_id int, header string, field string")
    got = {r.header: (r.field, r.confidence, r.source) for r in G.suggest_mapping(headers, synonyms, templates).collect()}
    assert got == {"OE No.": ("oe_numbers", 1.0, "synonym"), "Weight KG": ("weight", 0.9, "unit"), "Mystery": ("ignore", 0.0, "none"), "Price": ("cost", 1.0, "template")}


def test_pairs_meet_once_and_are_never_shuffled(spark):
    """Records that share all three blocks give one pair each, and no exchange carries pairs."""
    row = lambda i, oe, model: (i, 1, f"r{i}", "Lamp", "left", "Volvo", model, 2000, None, 100, 200, 300, oe)
    fields = "identity string, version int, record_id string, part_type string, position string, make string, model string, year_from int, year_to int, dim_a int, dim_b int, dim_c int, oe string, supplier_id int"
    df = spark.createDataFrame([(*row(i, oe, m), 7) for i, oe, m in (("a", "12345", "FH"), ("b", "12345", "FH"), ("c", "", "FH"), ("d", "12345", ""), ("e", "", ""))], fields)
    pairs = A.candidate_pairs(df)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "d"), ("b", "e"), ("c", "d"), ("c", "e"), ("d", "e")]
    plain, whole = A.evidence_hash(A.judge_pairs(pairs, df), df), A.judged_pairs(df, evidence=True)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, whole.collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    above, join = plan.split("Join", 1)  # the last join is the one on blocks
    assert "Aggregate" not in above and "block" in join.splitlines()[0]


def test_only_the_newest_rows_of_a_task_are_shuffled(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 3)], "identity string, version int")
    newest = A.current_records(df)
    assert sorted(map(tuple, newest.collect())) == [("a", 2), ("a", 2)]
    assert "WindowGroupLimit" in newest._jdf.queryExecution().toString()


def test_hits_of_number_searches_are_not_shuffled(spark):
    """A number holds the text at two places, two queries ask the same, and a record without a hit stays out."""
    queries = spark.createDataFrame([(1, "00123"), (2, "00123"), (3, "2000123"), (4, "0012"), (5, "99999"), (6, "")], "query_id long, norm string")
    records = spark.createDataFrame([("a", "2000123"), ("b", "7700123"), ("c", "0012300123"), ("d", "5551234"), ("e", "")], "identity string, oe string")
    hits = X.search_numbers(queries, records)
    assert sorted(map(tuple, hits.collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a")]
    assert "Aggregate" not in hits._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    members = spark.createDataFrame([("a", 10), ("b", 10), ("c", 11), ("d", 12)], "identity string, product_id long")
    ranked = X.ranked_by_number(queries, records, members)
    want = X.ranked_products(hits.withColumn("by_number", F.lit(True)), members)
    columns = ("query_id", "product_id", "by_number", "n_hits", "rank")
    assert sorted(map(tuple, ranked.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_products_come_along_with_pairs(spark):
    df = spark.createDataFrame([record("1:a"), record("2:b"), record("3:c"), record("4:d")], RECORD)
    members = spark.createDataFrame([("1:a", 7, "grouped"), ("2:b", 7, "grouped"), ("3:c", 8, "grouped")], "identity string, product_id long, status string")
    carried = A.judged_pairs(df.join(members.select("identity", "product_id"), "identity", "left"), carry=("product_id",))
    plain = A.judged_pairs(df)
    for new, old in ((X.items_of_products(carried), X.items_for_product(plain, members)), (X.close_shared(carried, members), X.close_implied(plain.select("a", "b"), members))):
        assert sorted(map(tuple, new.select("product_id", "a", "b").collect())) == sorted(map(tuple, old.select("product_id", "a", "b").collect()))
    above, join = X.items_of_products(carried)._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "Aggregate" not in above and "block" in join.splitlines()[0]
