from datetime import datetime

import pytest

from quern.operators.references import count_by_period, orphan_references

D = datetime
NODES = [("a", D(2024, 1, 1), None), ("a", D(2024, 1, 1), None), ("b", D(2024, 1, 1), D(2024, 2, 1)), ("b", D(2024, 3, 1), None), (None, D(2024, 1, 1), None), ("c", None, None)]
REFS = [(1, "a", D(2024, 1, 1)), (2, "a", D(2023, 12, 31)), (3, "b", D(2024, 2, 1)), (4, "b", D(2024, 2, 20)), (5, "b", D(2024, 3, 5)), (6, None, D(2024, 1, 1)), (7, "z", D(2024, 1, 1)), (7, "z", D(2024, 1, 1)), (8, "b", None), (9, "z", None), (10, "c", D(1999, 1, 1))]


def brute(refs, nodes):
    out = []
    for i, k, t in refs:
        if k is None:
            continue
        if not any(n == k and (t is None or ((a is None or a <= t) and (r is None or r > t))) for n, a, r in nodes):
            out.append(i)
    return sorted(out)


def frames(spark, refs=REFS, nodes=NODES):
    return spark.createDataFrame(refs, "id int, key string, at timestamp_ntz"), spark.createDataFrame(nodes, "key string, added timestamp_ntz, removed timestamp_ntz")


@pytest.mark.parametrize("hot", [1, 1000])
def test_times_nulls_repeats_and_hot_keys(spark, hot):
    refs, nodes = frames(spark, REFS * 3)
    found = orphan_references(refs, nodes, [("key", "key")], "simple", "at", ("added", "removed"), min_hot_rows=hot, rows_per_salt=2)
    assert found.columns == ["id", "key", "at"]
    assert sorted(r.id for r in found.collect()) == brute(REFS * 3, NODES)


def test_empty_tables(spark):
    refs, nodes = frames(spark)
    none_refs, none_nodes = frames(spark, [], [])
    assert orphan_references(none_refs, nodes, [("key", "key")]).count() == 0
    assert sorted(r.id for r in orphan_references(refs, none_nodes, [("key", "key")]).collect()) == sorted(i for i, k, _ in REFS if k is not None)


@pytest.mark.parametrize("match,expected", [("simple", [2]), ("partial", [2, 4]), ("full", [2, 3, 4, 5])])
def test_null_masks(spark, match, expected):
    refs = spark.createDataFrame([(1, 10, "x"), (2, 10, "y"), (3, None, "x"), (4, None, "q"), (5, 11, None), (6, None, None)], "_at int, page int, title string")
    nodes = spark.createDataFrame([(10, "x"), (11, "w"), (None, "q2"), (12, None)], "page int, title string")
    found = orphan_references(refs, nodes, [("page", "page"), ("title", "title")], match)
    assert sorted(r["_at"] for r in found.collect()) == expected


def test_period_report(spark):
    refs, nodes = frames(spark)
    found = orphan_references(refs, nodes, [("key", "key")], "simple", "at", ("added", "removed"))
    rows = {(r.tbl, r.month): r.orphans for r in count_by_period(found.selectExpr("'t' AS tbl", "at"), "tbl", "at").collect()}
    assert rows == {("t", "2023-12"): 1, ("t", "2024-02"): 2, ("t", "2024-01"): 2, ("t", None): 1}


def test_key_types_that_differ(spark):
    refs = spark.createDataFrame([(1, 5, "x"), (2, None, "x"), (3, 7, None), (4, None, None), (5, 6, "x")], "id int, a int, b string")
    nodes = spark.createDataFrame([(5.0, "x"), (7.0, "y"), (None, "z")], "a double, b string")
    assert sorted(r.id for r in orphan_references(refs, nodes, [("a", "a"), ("b", "b")], "partial").collect()) == [5]
