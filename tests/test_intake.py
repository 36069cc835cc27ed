"""Imports: records of cells, plans, and their whole or no effect; the fold below does a batch one row after the other."""

import datetime as dt
import re
import unicodedata
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from partloom.checkpoints import stored as kept
from partloom.functions import columns as C
from partloom.operators import importing
from partloom.operators import intake as N
from partloom.operators.quality import WEIGHTS
from partloom.operators.snapshots import Store

SPELLINGS = {"Volvo Trucks": "Volvo", "Scania": "Scania", "WABCO": "WABCO", "MAN": "MAN"}
TODAY = dt.date(2024, 5, 17)
CELLS = "row_no long, place int, header string, field string, confidence double, text string"


def norm(text):
    return "".join(x for x in unicodedata.normalize("NFKC", text) if x.isascii() and x.isalnum()).upper()


def fit_key(f):
    return (f["make"].lower(), (f["model"] or "").lower(), (f["engine"] or "").lower(), f["year_from"] or 0, f["year_to"] or 0)


def fold(records, t, batch):
    """Plans of all rows on the catalog as it was, then their effects in row order: ({row_no: (result, sku)}, tables)."""
    parts = {p["part_id"]: dict(p) for p in t["parts"]}
    own, have, fits = {}, {}, {}
    for n in t["numbers"]:
        have.setdefault(n["part_id"], set()).add((n["number_norm"], n["kind"]))
        if n["kind"] != "SUPPLIER":
            own.setdefault(n["number_norm"], set()).add(n["part_id"])
    for f in t["fitments"]:
        fits.setdefault(f["part_id"], set()).add(fit_key(f))
    skus = {p["sku"]: p["part_id"] for p in t["parts"]}
    categories = {c["name"].lower(): c for c in t["categories"]}
    pns = {r["supplier_pn"] for r in records if r["supplier_pn"]}
    by_pn = {}
    for o in sorted((o for o in t["offers"] if o["supplier_id"] == batch.supplier_id and o["supplier_pn"] in pns), key=lambda o: (o["quoted_at"], o["part_id"])):
        by_pn[norm(o["supplier_pn"])] = o["part_id"]
    offers = {(o["supplier_id"], o["part_id"], o["quoted_at"]): tuple(o[x] for x in N.OFFER) for o in t["offers"]}
    before = {p: dict(x) for p, x in parts.items()}

    def sets(part, key, new):
        if new in (None, ""):
            return False
        return part[key] in (None, "") or (batch.overwrite and not part["verified"] and part[key] != new)

    def offer_of(r):
        if batch.supplier_id is None or not r["unit_cost"] or r["unit_cost"] <= 0 or r["currency"] != "USD":
            return None
        return (r["supplier_pn"][:64], r["unit_cost"].quantize(Decimal("0.01"), ROUND_HALF_EVEN), r["moq"] or None, r["lead_days"], r["price_term"])

    def numbers_of(r):
        extra = [(r["supplier_pn"], norm(r["supplier_pn"]), "SUPPLIER")] if r["supplier_pn"] and batch.supplier_id is not None else []
        return [(n["number"], n["norm"], n["kind"]) for n in r["numbers"]] + extra

    def values_of(r):
        c = categories.get(r["category"].lower())
        return {**{x: r[x] for x in (*N.TEXTS, *N.PACKING)}, "category": c["category"] if c else None}

    claimed, plans, last = {}, {}, {}
    for r in sorted(records, key=lambda r: r["row_no"]):
        norms = [n["norm"] for n in r["numbers"]]
        oe = any(n["kind"] == "OE" for n in r["numbers"])
        if r["problems"] or not (r["sku"] or oe or r["supplier_pn"]) or (not (r["sku"] or oe) and batch.supplier_id is None):
            plans[r["row_no"]] = ("invalid", None, r)
            continue
        if any(n in claimed for n in norms):
            plans[r["row_no"]] = ("skipped", None, r)
            continue
        found = {skus[r["sku"]]} if r["sku"] in skus else set().union(*(own.get(n, set()) for n in norms))
        if not found and r["supplier_pn"] and norm(r["supplier_pn"]) in by_pn:
            found = {by_pn[norm(r["supplier_pn"])]}
        if len(found) > 1:
            plans[r["row_no"]] = ("duplicate", None, r)
            continue
        claimed.update(dict.fromkeys(norms, r["row_no"]))
        if found:
            p = before[min(found)]
            offer = offer_of(r)
            change = any(sets(p, k, v) for k, v in values_of(r).items()) or any((n, k) not in have.get(p["part_id"], ()) for _, n, k in numbers_of(r))
            change = change or any(fit_key(f) not in fits.get(p["part_id"], ()) for f in r["fitments"]) or (offer is not None and offers.get((batch.supplier_id, p["part_id"], batch.today)) != offer)
            plans[r["row_no"]] = ("updated" if change else "skipped", p["sku"], r)
            continue
        sku = r["sku"]
        if not sku:
            c = categories.get(r["category"].lower())
            prefix = f"{batch.sku_prefix}{((c['code'] if c else '') or 'GEN').upper()}-"
            if prefix not in last:
                last[prefix] = max((int(s[len(prefix):]) for s in skus if s.startswith(prefix) and s[len(prefix):].isdigit()), default=0)
            last[prefix] += 1
            sku = f"{prefix}{last[prefix]:05d}"
        plans[r["row_no"]] = ("new", sku, r)

    touched, top = set(), max(parts, default=0)
    for result, sku, r in plans.values():
        if result not in ("new", "updated"):
            continue
        if result == "new":
            top += 1
            skus[sku] = top
            parts[top] = {**values_of(r), "part_id": top, "sku": sku, "verified": False, "score": 0}
        p = parts[skus[sku]]
        touched.add(p["part_id"])
        for k, v in values_of(r).items():
            if result == "updated" and sets(p, k, v):
                p[k] = v
        have.setdefault(p["part_id"], set()).update((n, k) for _, n, k in numbers_of(r))
        fits.setdefault(p["part_id"], set()).update(fit_key(f) for f in r["fitments"])
        if offer_of(r):
            offers[(batch.supplier_id, p["part_id"], batch.today)] = offer_of(r)
    pictured, priced = {i["part_id"] for i in t["images"] if i["is_primary"]}, {p for _, p, _ in offers}
    for k in touched:
        p = parts[k]
        kinds = {kind for _, kind in have.get(k, ())}
        there = {"name": len(p["name_en"].strip()) >= 5, "category": p["category"] is not None, "attributes": p["category"] is not None, "oe": "OE" in kinds, "cross": "CROSS" in kinds, "fitment": bool(fits.get(k))}
        there |= {"image": k in pictured, "packaging": p["pcs_per_carton"] is not None and p["gross_weight_kg"] is not None, "offer": k in priced}
        p["score"] = sum(w for x, w in WEIGHTS.items() if there[x])
    return {no: (result, sku) for no, (result, sku, _) in plans.items()}, {"parts": parts, "numbers": {(p, *x) for p, xs in have.items() for x in xs}, "fitments": {(p, *x) for p, xs in fits.items() for x in xs}, "offers": offers}


def tables(store, version=None):
    return {n: store.read(n, version, s).collect() for n, s in N.SCHEMAS.items()}


def agree(records, before, after, plan, batch):
    """An applied batch against the fold."""
    want, end = fold([r.asDict(recursive=True) for r in records], {n: [r.asDict() for r in rows] for n, rows in before.items()}, batch)
    sku = {p.part_id: p.sku for p in after["parts"]}
    assert {r.row_no: (r.result, sku.get(r.part_id)) for r in plan} == want and len(plan) == len(want)
    fields = ("sku", *N.TEXTS, "category", *N.PACKING, "score")
    by_sku = {p["sku"]: p for p in end["parts"].values()}
    got = {p.sku: tuple(p[x] or None for x in fields) for p in after["parts"]}
    assert got == {s: tuple(p[x] or None for x in fields) for s, p in by_sku.items()} and len(after["parts"]) == len(by_sku)
    same = {p["part_id"]: p["sku"] for p in end["parts"].values()}
    assert sorted((sku[n.part_id], n.number_norm, n.kind) for n in after["numbers"]) == sorted((same[p], n, k) for p, n, k in end["numbers"])
    assert sorted((sku[f.part_id], *fit_key(f)) for f in after["fitments"]) == sorted((same[p], *x) for p, *x in end["fitments"])
    assert {(o.supplier_id, sku[o.part_id], o.quoted_at): tuple(o[x] for x in N.OFFER) for o in after["offers"]} == {(s, same[p], d): v for (s, p, d), v in end["offers"].items()}
    return want


# --- small sheets --------------------------------------------------------------------------------------------------------

HEADERS = {"Part No": "supplier_pn", "OEM NO": "oe_number", "Ref": "cross_number", "Desc": "name_en", "Vehicle": "make", "Price": "unit_cost", "MOQ": "moq", "Packing": "pcs_per_carton", "Category": "category", "SKU": "sku"}


def row(**kw):
    return {"Part No": "HB-1", "OEM NO": "20443906", "Desc": "Shock Absorber", "Vehicle": "Volvo FH12", "Price": "18.50", "MOQ": "50", "Packing": "20pcs/ctn", **{k.replace("_", " "): v for k, v in kw.items()}}


def sheet(stored, *rows):
    return stored([(i + 2, j, h, f, 1.0, r.get(h)) for i, r in enumerate(rows) for j, (h, f) in enumerate(HEADERS.items())], CELLS)


def batch(name="b", supplier=7, **kw):
    return N.Batch(name, supplier, TODAY, **kw)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def part(part_id, sku, **kw):
    have = {"part_id": part_id, "sku": sku, "name_en": "", "name_zh": "", "description_en": "", "category": None, **dict.fromkeys(N.PACKING), "verified": False, "status": "draft", "source": "manual", "confidence": Decimal("1.00"), "score": 0} | kw
    return tuple(have[c.split()[0]] for c in N.SCHEMAS["parts"].split(", "))


def publish(store, stored, **rows):
    store.publish(store.version(), {n: stored(r, N.SCHEMAS[n]) for n, r in rows.items()})


def run(store, stored, rows, b, dry=False):
    before = tables(store)
    records = kept(N.build_records(sheet(stored, *rows), SPELLINGS))
    planned = {(r.row_no, r.result, r.message) for r in N.dry_run(store, records, b).collect()} if dry else None
    _, plan = N.apply_import(store, records, b)
    plan, after = plan.collect(), tables(store)
    assert not dry or planned == {(r.row_no, r.result, r.message) for r in plan}
    agree(records.collect(), before, after, plan, b)
    return {r.row_no: r for r in plan}, after


def test_a_new_part_and_the_same_sheet_again(store, stored):
    rows = [row(Ref="K001234", Desc="刹车片 Brake Pad Set", Vehicle="Volvo FH12/FH16", Price="USD 18.5"), row(Part_No="HB-2", OEM_NO="20568713")]
    plan, after = run(store, stored, rows, batch(), dry=True)
    assert [plan[2].result, plan[3].result] == ["new", "new"]
    first = next(p for p in after["parts"] if p.sku == "FIT-GEN-00001")
    assert (first.name_en, first.name_zh, first.pcs_per_carton, first.unit, first.status, first.source) == ("Brake Pad Set", "刹车片", 20, "pc", "draft", "import")
    assert {(n.number, n.kind, n.brand) for n in after["numbers"] if n.part_id == first.part_id} == {("20443906", "OE", "Volvo"), ("K001234", "CROSS", "Knorr-Bremse"), ("HB-1", "SUPPLIER", None)}
    assert {(b.name, b.kind) for b in after["brands"]} == {("Volvo", "OEM"), ("Knorr-Bremse", "AFTERMARKET")}
    offer = next(o for o in after["offers"] if o.part_id == first.part_id)
    assert (offer.unit_cost_usd, offer.moq, offer.price_term) == (Decimal("18.50"), 50, "FOB")
    again, later = run(store, stored, rows, batch("c"))
    assert {r.result for r in again.values()} == {"skipped"} and sorted(later["parts"]) == sorted(after["parts"])
    with pytest.raises(N.ImportFailed, match="applied already"):
        N.apply_import(store, N.build_records(sheet(stored, *rows), SPELLINGS), batch("c"))


def test_numbers_of_new_skus_go_on(store, stored):
    publish(store, stored, parts=[part(4, "FIT-GEN-00007"), part(5, "FIT-GEN-x"), part(6, "FIT-BPD-99999")], categories=[("Pads", "Pads", "bpd")])
    plan, _ = run(store, stored, [row(OEM_NO="30000001", Category="pads"), row(Part_No="", OEM_NO="30000002"), row(Part_No="", OEM_NO="30000003")], batch())
    assert [plan[i].new_sku for i in (2, 3, 4)] == ["FIT-BPD-100000", "FIT-GEN-00008", "FIT-GEN-00009"]


def test_invalid_duplicate_and_repeated_rows(store, stored):
    publish(store, stored, parts=[part(1, "FIT-A"), part(2, "FIT-B")], numbers=[(1, "20443906", "20443906", "OE", None, "manual", None), (2, "2044-3906", "20443906", "OE", None, "manual", None)])
    rows = [row(Part_No="", OEM_NO="", Ref="K001234"), row(OEM_NO="9.86E+08"), row(), row(OEM_NO="555555"), row(OEM_NO="55 55-55", Part_No="HB-9"), {}]
    plan, _ = run(store, stored, rows, batch())
    assert [plan[i].result for i in range(2, 8)] == ["invalid", "invalid", "duplicate", "new", "skipped", "invalid"]
    assert "OEM NO: 9.86E+08" in plan[3].message and "FIT-A, FIT-B" in plan[4].message and "row 5 (555555)" in plan[6].message


def test_without_supplier_and_in_other_money(store, stored):
    plan, after = run(store, stored, [row(), row(OEM_NO=""), row(OEM_NO="777777", Part_No="")], batch(supplier=None))
    assert [plan[i].result for i in (2, 3, 4)] == ["new", "invalid", "new"] and "price left out" in plan[2].message and after["offers"] == []
    plan, after = run(store, stored, [row(Price="¥128"), row(OEM_NO="777777", Part_No="", Price="0")], batch("c"))
    assert "CNY" in plan[2].message and "above 0" in plan[3].message and after["offers"] == []


@pytest.mark.parametrize(("overwrite", "verified", "name"), [(False, False, "Old Name"), (True, False, "Last"), (True, True, "Old Name")])
def test_stated_values(store, stored, overwrite, verified, name):
    publish(store, stored, parts=[part(1, "FIT-A", name_en="Old Name", verified=verified)], numbers=[(1, "20443906", "20443906", "OE", None, "manual", None)], offers=[(7, 1, TODAY, "HB-1", Decimal("20.00"), None, None, "FOB", "")])
    plan, after = run(store, stored, [row(OEM_NO="2044-3906", Desc="New"), row(SKU="fit-a", OEM_NO="", Part_No="", Desc="Last", Price="")], batch(overwrite=overwrite))
    [p] = after["parts"]
    assert plan[2].result == "updated" and (p.name_en, p.pcs_per_carton, p.unit) == (name, 20, "pc")
    assert [(n.number, n.source) for n in after["numbers"] if n.kind == "OE"] == [("20443906", "manual")]
    assert [o.unit_cost_usd for o in after["offers"]] == [Decimal("18.50")]


def test_one_new_sku_in_several_rows(store, stored):
    publish(store, stored, parts=[part(1, "FIT-A")])
    rows = [row(SKU="NEW-1", OEM_NO="30000001"), row(SKU="NEW-1", OEM_NO="30000002"), row(SKU="NEW-1", OEM_NO="30000003"), row(OEM_NO="30000002", Part_No="HB-9")]
    N.apply_parted(store, N.build_records(sheet(stored, *rows), SPELLINGS), batch())
    log = {r.row_no: r.result for r in store.read("import_rows").collect()}
    assert log == {2: "new", 3: "updated", 4: "updated", 5: "new"} and store.read("parts").filter("sku = 'NEW-1'").count() == 1
    [p] = store.read("parts").filter("sku = 'NEW-1'").collect()
    assert {n.number for n in store.read("numbers").filter(F.col("part_id") == p.part_id).collect() if n.kind == "OE"} == {"30000001", "30000002", "30000003"}


def test_all_or_nothing(store, stored, monkeypatch):
    publish(store, stored, parts=[part(1, "FIT-A")])
    before, version = tables(store), store.version()
    same = [row(SKU="NEW-1", OEM_NO="30000001"), row(SKU="NEW-1", OEM_NO="30000002")]
    with pytest.raises(N.ImportFailed, match="NEW-1"):
        N.apply_import(store, N.build_records(sheet(stored, *same), SPELLINGS), batch())
    records = kept(N.build_records(sheet(stored, *(row(OEM_NO=f"2044390{i}", Part_No=f"HB-{i}") for i in range(5))), SPELLINGS))
    real = Store._write

    def broken(df, path, paths):
        if path.endswith("/fitments"):
            df = df.withColumn("model", F.when(F.col("part_id") == 4, F.raise_error(F.lit("disk full"))).otherwise(F.col("model")))
        return real(df, path, paths)

    monkeypatch.setattr(Store, "_write", staticmethod(broken))
    with pytest.raises(Exception, match="disk full"):
        N.apply_import(store, records, batch())
    assert (store.version(), tables(store)) == (version, before)
    monkeypatch.setattr(Store, "_write", staticmethod(real))
    N.apply_import(store, records, batch())
    assert len(store.read("parts").collect()) == 6


def test_empty_sheet_and_strange_names(store, stored, spark):
    plan, after = run(store, stored, [], batch())
    assert plan == {} and after["parts"] == [] and store.version() == 1
    with pytest.raises(ValueError, match="at most"):
        N.build_records(sheet(stored), {f"b{i}": f"B{i}" for i in range(1001)})
    with pytest.raises(AnalysisException):
        N.build_records(spark.range(1), SPELLINGS)


def test_order_of_columns(stored):
    cells = [("Name", "name_en", "减震器 Shock 前 Absorber"), ("EN", "name_en", "Other"), ("中文", "name_zh", "别"), ("Y", "year_from", "93-05"), ("to", "year_to", "2007"), ("Brand", "brand", "wabco"), ("EXW price", "unit_cost", "1,234.50"), ("Cur", "currency", "chf"), ("Make", "make", "MAN"), ("Make", "make", "TGA"), ("Model", "model", "TGX"), ("OE", "oe_number", "A0001234567；ﬁ1234/x"), ("OE2", "oe_number", "P123456"), ("kg", "net_weight_kg", "500g"), ("kg", "gross_weight_kg", "0"), ("L", "carton_l_cm", "450x300x250mm")]
    got = N.build_records(stored([(1, i, h, f, 0.5 if f == "model" else None, t) for i, (h, f, t) in enumerate(cells)], CELLS), SPELLINGS).first()
    assert (got.name_en, got.name_zh, got.currency, got.price_term, got.unit_cost, got.confidence) == ("Shock Absorber", "减震器 前", "CHF", "EXW", Decimal("1234.5"), 0.5)
    assert [tuple(f) for f in got.fitments] == [("MAN", "TGX", "", 1993, 2007), ("TGA", "TGX", "", 1993, 2007)]
    assert [(n.norm, n.kind, n.brand, n.confidence) for n in got.numbers] == [("A0001234567", "OE", "WABCO", 1.0), ("FI1234X", "OE", "WABCO", 1.0), ("P123456", "CROSS", "Donaldson", 0.6)]
    assert (got.net_weight_kg, got.gross_weight_kg, got.carton_l_cm, got.pcs_per_carton) == (0.5, None, 45.0, None)


def test_ranks_of_one_large_group(stored, spark):
    rows = stored([(i, "a" if i % 50 else "b") for i in range(4000)], "row_no long, g string", parts=4)
    got = {r.row_no: r.k for r in importing.ranked(rows, "g", "row_no", "k").collect()}
    for g in (0, 1):
        numbers = [got[i] for i in range(4000) if bool(i % 50) == bool(g)]
        assert numbers == list(range(1, len(numbers) + 1))


# --- compatible forms ----------------------------------------------------------------------------------------------------


def test_every_compatible_character(spark):
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x500 or unicodedata.normalize("NFKC", chr(i)) != chr(i))]
    df = spark.createDataFrame([("".join(every[i : i + 50]),) for i in range(0, len(every), 50)] + [(x,) for x in ("", None, "plain 12", "ﬁlter ⑩ ㎏ ﾊﾝ")], "t string")
    for r in df.select("t", C.compat(F.col("t")).alias("c"), C.full_norm(F.col("t")).alias("n")).collect():
        want = "".join(unicodedata.normalize("NFKC", x) for x in r.t or "")
        assert r.c == want and r.n == "".join(x for x in want if x.isascii() and x.isalnum()).upper()


def test_numbers_of_other_forms(spark):
    df = spark.createDataFrame([("⑫３４５－６；ﬁ 77、ﬀ77/１２３４５",)], "t string")
    assert df.select(C.split_numbers(F.col("t")).alias("x")).first().x == ["12345-6", "fi 77", "ff77/12345"]
    assert "Python" not in df.select(C.full_norm(F.col("t")).alias("x"))._jdf.queryExecution().toString()


def test_a_number_is_read_once(spark):
    """What stands in a lambda is computed anew wherever it stands: each format of a brand stands once, as each number is read once."""
    rows = spark.createDataFrame([("2000123; W712; 2000 123",)], "t string").select(N._numbers(F.col("t"), F.lit("oe_number"), F.lit(0.9)).alias("x"))
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("rlike(") == len(C.BRAND_FORMATS)
    assert [(x.number, x.norm, x.kind, x.brand, float(x.confidence)) for x in rows.first()[0]] == [("2000123", "2000123", "OE", None, 0.9), ("W712", "W712", "CROSS", "MANN-FILTER", 0.6)]


def test_values_are_read_in_their_own_cells_only(stored):
    """Amounts, minimums and lead times are computed where the field asks for them, not in every cell."""
    rows = N.build_records(stored([(1, 0, "Price", "unit_cost", 1.0, "5")], "row_no long, place int, header string, field string, confidence double, text string"), {})
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"max_by\(CASE WHEN \(_?f#\d+ = ", plan)) == 7
    assert float(rows.first()["unit_cost"]) == 5.0
