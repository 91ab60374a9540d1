import json
import os

import pytest
from pyspark.sql import functions as F

from quern.functions import stats as A
from quern.operators import events as E
from quern.operators import lookup as K
from quern.operators import relational as R
from quern.sources import lines as L


def test_level_changes(spark):
    rows = spark.createDataFrame([(99, 99, 3, 10), (50, 60, 5, 15), (10, 3, -4, 0), (99, 250, 20, 0), (10, 10, 0, 99)], "b int, n int, c int, p int")
    args = [F.col(c) for c in "bncp"]
    got = [tuple(r) for r in rows.select(A.stat_add(*args), A.stat_sub(*args), A.stat_boost(*args), A.stat_drain(*args), A.stat_heal(*args)).collect()]
    assert got == [(111, 87, 111, 87, 99), (72, 48, 62, 46, 60), (-1, 7, 3, 7, 3), (255, 230, 250, 230, 250), (19, 1, 19, 1, 10)]


def test_lists_take_no_more_than_they_hold(spark):
    stored = spark.createDataFrame([("a",)] * 3 + [("b",)] * 9, "u string")
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5), (None, 6)], "u string, i int")
    assert {r.i: r.accepted for r in R.accept_up_to(stored, new, "u", "i", 5).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_unions_by_key(spark):
    old, new = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b"), (2, "c"), (None, "n")], [(2, "B"), (3, "C")]))
    assert sorted(map(str, R.union_new_wins(old, new, ["k"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (None, "n"), (2, "B"), (3, "C")], old.schema).collect()))
    tables = [spark.createDataFrame(rows, "k int, l array<string>, n string") for rows in ([(1, ["x", "y"], None), (2, None, "p")], [(1, ["y", "a", None], "first"), (1, [], "first")], [(1, ["z"], "late")])]
    assert {r.k: (r.l, r.n) for r in R.merge_by_id(tables, "k", ["l"], ["n"]).collect()} == {1: (["a", "x", "y", "z"], "first"), 2: ([], "p")}


def test_champions_need_a_place(spark):
    gains = spark.createDataFrame([("f", "a", 5, 1), ("f", "b", 3, 2), ("f", "late", 99, 3), ("f", "b", 2, 4), ("f", "low", 0, 0), ("g", "x", 0, 5)], "f string, w string, p int, o int")
    assert [tuple(r) for r in E.champions(gains, "f", "w", "p", "o", 2).collect()] == [("f", "a", 5)]
    assert [tuple(r) for r in E.champions(gains, "f", "w", "p", "o", 9).collect()] == [("f", "late", 99)]


def test_unknown_checks_and_missing_entries(spark):
    with pytest.raises(ValueError):
        E.check_column("other", {})
    state = spark.createDataFrame([({}, None)], "inventory map<string,bigint>, messages array<string>")
    assert tuple(state.select(E.check_column("inventory_lacks", {"item": "x"}), E.check_column("inventory_contains", {"item": "x"}), E.check_column("message_matches", {"pattern": "a"})).first()) == (True, False, False)


def test_zones_documents_and_reports(spark, tmp_path):
    lines = spark.createDataFrame([(0, "level,x,z"), (1, "0, 8,15"), (2, "0,9,8"), (3, "// c"), (4, "1,x,2"), (5, None), (6, "1,16,0")], "i int, b string")
    assert {tuple(r) for r in L.zone_set(L.without_header(lines, "i"), "b").collect()} == {(0, 1, 1), (1, 2, 0)}
    L.write_json_document(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "d"))
    part = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".json"))
    assert json.loads((tmp_path / "d" / part).read_text()) == {"n": 1, "s": "x"}
    with pytest.raises(ValueError):
        L.write_json_document(spark.range(2), str(tmp_path / "d"))
    got = L.table_lines(spark.createDataFrame([("b", None), ("a|c", 2)], "n string, v int"), ["n", "v"], ["n"]).orderBy("ord").collect()
    assert [r.line for r in got] == ["| n | v |", "| --- | --- |", r"| a\|c | 2 |", "| b |  |"]


def test_counting_lookups(spark):
    spec = K.TableSpec(7, {"c": (("int",), True, None)})
    rows = spark.createDataFrame([(7, i, [(i % 2,)]) for i in range(9)] + [(8, 1, [(1,)])], "table_id int, row_id int, c array<struct<f0:int>>")
    found = K.find(rows, spec, "c", 1)
    assert K.count_of(found).first().found == 4 and K.enum_count({1: "a", 2: "b"}) == 2
    assert [(r.row_id, r.ord) for r in K.list_all(rows, spec).orderBy("ord").collect()] == [(i, i) for i in range(9)]
    assert K.count_of(found.where("false")).first().found == 0
