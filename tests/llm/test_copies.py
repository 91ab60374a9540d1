import pytest

from quern.llm.copies import CopyClasses, keyed_records

SCHEMA = "id bigint, a string, b string, props string, key string"
ROWS = [
    (5, "The Hammer-of X", None, '{"k": 1, "m": {"y": 2, "x": [1, 2]}}', "clash"),
    (3, "the hammer of x!", "", '{ "m" : {"x":[1,2], "y":2} , "k":1 }', "clash"),
    (9, "THEHAMMER OFX", "  ", '{"k":1,"m":{"x":[2,1],"y":2}}', "other list order"),
    (4, "a b", "c", None, None), (6, "ab", "c", "{}", None), (7, "a", "bc", "{}", None),
    (8, None, None, "not json ", None), (10, "", "—", " not json", None), (11, "", "", "", None),
    (12, "Ünï", "É", '{"a":"1"}', None), (13, "ünï", "é", '{"a":"\\u0031"}', None), (14, "uni", "e", '{"a":1}', None),
    (5, "The Hammer-of X", None, '{"k": 1, "m": {"y": 2, "x": [1, 2]}}', "repeated row"),
    (None, "a b", "c", None, None),
    (20, "z" * 200_000, "", None, None), (21, "Z" * 200_000, None, None, None),
]


@pytest.mark.parametrize("hot", [1, 1000])
def test_classes(spark, hot):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    classes = CopyClasses(keyed_records(rows, "id", ["a", "b"], ["props"]), min_hot_rows=hot, rows_per_salt=2)
    got = sorted((r.id is None, r.id or 0, r.first_id, r.copies) for r in classes.members().collect())
    first = {i: (f, n) for _, i, f, n in got}
    assert first[5] == (3, 3) and first[3] == (3, 3) and first[9] == (9, 1)
    assert first[4] == (4, 3) and first[6] == (4, 3) and first[7] == (7, 1) and got[-1] == (True, 0, 4, 3)
    assert first[8] == (8, 2) and first[10] == (8, 2) and first[11][1] == 1
    assert first[12] == (12, 2) and first[13] == (12, 2) and first[14] == (14, 1)
    assert first[20] == (20, 2) and first[21] == (20, 2)
    collapsed = sorted((r.first_id, r.copies) for r in classes.collapsed().collect())
    assert collapsed == sorted({(f, n) for _, _, f, n in got}) and sum(n for _, n in collapsed) == len(ROWS)


def test_hot_key_of_a_third_of_the_rows(spark):
    rows = [(i, "Hot! key" if i % 3 == 0 else f"cold {i // 2}", None, None, None) for i in range(900)]
    keyed = keyed_records(spark.createDataFrame(rows, SCHEMA), "id", ["a"])
    hot = {(r.id, r.first_id, r.copies) for r in CopyClasses(keyed, min_hot_rows=50, rows_per_salt=20).members().collect()}
    cold = {(r.id, r.first_id, r.copies) for r in CopyClasses(keyed, min_hot_rows=10_000).members().collect()}
    assert hot == cold and len(hot) == 900 and (3, 0, 300) in hot


def test_empty_table(spark):
    classes = CopyClasses(keyed_records(spark.createDataFrame([], SCHEMA), "id", ["a"], ["props"]))
    assert classes.members().count() == 0 and classes.collapsed().count() == 0
