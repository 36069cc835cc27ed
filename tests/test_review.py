"""Misspelt names against brute force, record search with short and empty texts, vehicles and suggestions at their edges."""

import pytest
from pyspark.sql import functions as F

from partloom.operators import archive as A
from partloom.operators import review as R


def trigrams_of(text):
    words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
    return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]


def test_misspelt(spark):
    names = ["brake pad front", "brake disc", "barke shoe", "oil filter", "", "air filter housing", "brake pad front", None]
    parts = spark.createDataFrame([(i, f"S{i}", n) for i, n in enumerate(names)], "part_id long, sku string, name_en string")
    asked = ["barke pad", "fliter", "xyzzy", "", "disk brake", "named already"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = R.match_misspelt(queries, parts, spark.createDataFrame([(5,)], "query_id long"), k=3).collect()
    want = []
    for q, text in enumerate(asked[:5]):
        own, found = set(trigrams_of(text)), []
        for i, name in enumerate(names):
            t = trigrams_of(name or "")
            shares = [len(own & set(t[a:b])) / len(own | set(t[a:b])) for a in range(len(t)) for b in range(a + 1, len(t) + 1)] if own else []
            if shares and max(shares) >= 0.3:
                found.append((-max(shares), f"S{i}", i))
        want += [(q, i, round(-600 * s + 1e-9)) for s, _, i in sorted(found)[:3]]
    assert sorted((r.query_id, r.part_id, r.milli) for r in got) == sorted(want)
    assert {q for q, _, _ in want} == {0, 4}


def test_search_records(spark):
    records = spark.createDataFrame([(1, "Brake Pad", "VOLVO"), (2, "pad", None), (3, "", "Ao")], "record_id long, name string, make string")
    queries = spark.createDataFrame([(1, "pad"), (2, "A"), (3, " "), (4, None), (5, "ake p"), (6, "ao"), (7, "zzz")], "query_id long, text string")
    got = {tuple(r) for r in R.search_records(queries, records, ["name", "make"]).collect()}
    texts = {1: "pad", 2: "a", 5: "ake p", 6: "ao", 7: "zzz"}
    assert got == {(q, r.record_id, f) for q, t in texts.items() for r in records.collect() for f in ("name", "make") if r[f] and t in r[f].lower()}


def test_vehicles(spark):
    aliases = spark.createDataFrame([("volvo", "Volvo"), ("Volvo Trucks", "Volvo"), ("沃尔沃", "Volvo")], "alias string, brand string")
    cells = spark.createDataFrame([(1, "Volvo FH12/FH16"), (2, "沃尔沃 FH"), (3, None), (4, " "), (5, "Volvo"), (6, "Odd Make 1/2"), (7, "volvo 沃尔沃"), (8, "VOLVO TRUCKS P/ G")], "id long, cell string")
    got = {(r.id, r.place): (r.make, r.model) for r in R.explode_vehicles(cells, "id", "cell", aliases).collect()}
    assert got == {(1, 0): ("Volvo", "FH12"), (1, 1): ("Volvo", "FH16"), (2, 0): ("Volvo", "FH"), (5, 0): ("Volvo", ""), (6, 0): ("Odd Make 1/2", ""), (7, 0): ("Volvo", ""), (8, 0): ("Volvo", "P"), (8, 1): ("Volvo", "G")}


def test_suggestions_for_nothing(spark):
    parts = spark.createDataFrame([(1, True, {"a": "1"}, 90, "import", "x"), (2, False, {"a": None}, 40, "import", "")], "part_id long, verified boolean, attributes map<string,string>, confidence int, source string, name string")
    chosen = spark.createDataFrame([(7, 1, "name", "new", 50), (8, 9, "name", "lost", 50)], "suggestion_id long, part_id long, field string, value string, confidence int")
    specs = spark.createDataFrame([(7, 2, "a", "2", 80), (9, 2, "a", "3", 80)], "suggestion_id long, part_id long, key string, value string, confidence int")
    got = {r.part_id: r for r in R.apply_suggestions(chosen, specs, parts, ["name"]).collect()}
    assert (got[1].name, got[1].source, got[1].confidence, got[1].attributes) == ("x", "import", 90, {"a": "1"})
    assert (got[2].name, got[2].source, got[2].confidence, got[2].attributes) == ("", "ai", 40, {"a": "2"})
    assert R.suggestion_counts(parts.select(F.lit("new").alias("status")).limit(0), ["new", "done"]).collect() == [("new", 0), ("done", 0)]


def test_clusters_of_a_long_chain(spark):
    """Any length: no round is the last before all labels stand."""
    pairs = [(f"n{k:04d}", f"n{k + 1:04d}", "strong", "strong") for k in range(300)] + [("n0000", "z", "spec_conflict", "conflict")]
    got = A.review_clusters(spark.createDataFrame(pairs, "a string, b string, category string, strength string")).collect()
    assert {r.cluster for r in got} == {"n0000", "n0000~z"} and len(got) == 301


@pytest.mark.parametrize("ring", [[(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)]])
def test_products_merged_in_a_ring(spark, ring):
    with pytest.raises(ValueError):
        A.resolve_merged(spark.createDataFrame([*ring, (7, 8), (8, None)], "product_id long, merged_into long"))


def test_a_long_chain_of_merges(spark):
    got = A.resolve_merged(spark.createDataFrame([(k, k - 1 if k else None) for k in range(200)], "product_id long, merged_into long")).collect()
    assert len(got) == 200 and {r.survivor for r in got} == {0}
