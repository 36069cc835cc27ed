"""Every registered query of the catalog: against its SQL where it has some, else against brute force."""

import datetime
import decimal
import difflib
import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest
from test_decisions import one_by_one
from test_intake import agree, tables

from partloom.fixture import Catalog
from partloom.operators import importing, matching, quality
from partloom.plans import archive, catalog, exports, imports, ingesting, intake, records, review, sheets, standardize, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    want = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), columns)


# --- queries without SQL, each against brute force over the whole of the small tables ------------------------------------


def groups(pairs):
    """node -> least node reachable."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}


def check_j7(spark, c, got):
    label = groups((r.a, r.b) for r in got if r.strength != "conflict")
    assert all(r.cluster == (f"{r.a}~{r.b}" if r.strength == "conflict" else label[r.a]) for r in got)
    assert len(got) == archive.judged(c).count()


def check_k6(spark, c, got):
    """Rows in order: the first of an unclaimed number takes it. found and unchanged come from plain lookups."""
    own, sku, name = {}, {}, {}
    for r in c.numbers.collect():
        own.setdefault(r.number_norm, set()).add(r.part_id)
    for r in c.parts.collect():
        sku[r.sku], name[r.part_id] = r.part_id, r.name_en
    given = []
    for r in imports.rows(c).collect():
        found = [sku[r.sku]] if r.sku in sku else sorted(set().union(*(own.get(n, set()) for n in r.norms))) or ([r.pn_part] if r.pn_part is not None else [])
        problem = "no SKU, OE number or known supplier number" if r.sku == "" and not r.has_oe and r.pn_part is None else ""
        given.append((r.row_no, r.norms, found, bool(found and name[found[0]] == r.name_en and r.no_new), problem))
    want = importing.claim(pd.DataFrame(given, columns=["row_no", "norms", "found", "unchanged", "problem"]))
    assert {r.row_no: (r.result, r.message) for r in got} == {r.row_no: (r.result, r.message) for r in want.itertuples()}


def check_f7(spark, c, got):
    results = Counter(r.result for r in catalog.QUERIES["k6_plan_import"](spark, DATA).collect())
    assert {r.result: r.n for r in got} == {k: results.get(k, 0) for k in importing.RESULTS}


def check_j15(spark, c, got):
    decisions, items, members, products = (df.collect() for df in imports.decided(c))
    items = [(i.item_id, i.kind, "", i.a, i.b, i.status, i.missing) for i in items]
    want = one_by_one([tuple(d) for d in decisions], items, [tuple(m) for m in members], [tuple(p) for p in products])[0]
    strip = lambda rows: sorted((r[0], r[1], r[2]) for r in rows)
    assert strip(got) == strip(want)  # ids of new products depend on the order in which they are made
    assert [r.product_id for r in sorted(got, key=lambda r: r.decision_id)] == [w[3] for w in sorted(want)]


def check_j16(spark, c, got):
    strong = archive.judged(c).filter("category = 'strong'").selectExpr("abs(xxhash64(a, b)) as id", "a", "b").collect()
    label, product = groups((r.a, r.b) for r in strong), {r.decision_id: r.product_id for r in got}
    assert len(got) == len(strong) > 0
    pairs = {(label[r.a], product[r.id]) for r in strong}
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    assert sum(r.applied for r in got) == len(label) - len(set(label.values())) and {r.refusal for r in got} == {"", "already decided"}


def check_e4(spark, c, got):
    numbers = [(r.part_id, r.sku, r.sku.replace("-", "")[3:33]) for r in c.parts.collect()]
    asked = [(r.query_id, r.norm[3:33]) for r in standardize.parsed(c, "sku").collect() if r.norm]
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(q, p, s) for q, x in asked for p, s, y in numbers if x and x != y and (x[:3] == y[:3] or x[-3:] == y[-3:]) and ratio(x, y) >= 0.75}
    assert {(r.query_id, r.part_id, r.number) for r in got} == want and len(got) == len(want) > 0


def check_m3(spark, c, got):
    asked = c.inquiries.filter("is_text").selectExpr("inquiry_id as query_id", "concat('20', lpad(raw, 5, '0')) as raw")
    want = matching.match_queries(matching.queries_of(asked), c.parts, catalog.numbers_(c), c.fitments, quality.completeness(catalog.flagged(c)))
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want.select("query_id", "part_id", "level", "milli", "rank").collect()) and got


def check_k9(spark, c, got):
    store = intake.catalog(c)
    before = tables(store)
    records = intake.N.build_records(intake.cells(c), intake.SPELLINGS)
    _, plan = intake.N.apply_import(store, records, intake.BATCH)
    want = agree(records.collect(), before, tables(store), plan.collect(), intake.BATCH)
    assert {r.row_no: r.result for r in got} == {no: result for no, (result, _) in want.items()}
    assert {result for result, _ in want.values()} == set(importing.RESULTS)


CHECKS = {"k9_apply_import": check_k9, "j7_review_clusters": check_j7, "k6_plan_import": check_k6, "f7_import_counts": check_f7, "j15_apply_decisions": check_j15, "j16_bulk_confirmed": check_j16, "e4_match_blocked": check_e4, "m3_stream_match": check_m3}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_against_brute_force(spark, name):
    CHECKS[name](spark, Catalog(spark, DATA), catalog.QUERIES[name](spark, DATA).collect())
