import json

from quern.operators import schema_drift
from quern.operators.schema_drift import cast_value, changes_between, column_names, consistent, correspond, drift, flood, leaves_of

SCHEMA = "line_id bigint, feed string, file_seq int, line_no int, rec_key string, body string, path string"


def lines(files):
    rows, n = [], 0
    for feed, seq, bodies in files:
        for i, b in enumerate(bodies):
            n += 1
            rows.append((n, feed, seq, i + 1, f"k{i}", b if b is None or isinstance(b, str) else json.dumps(b), "clash"))
    return rows


def found(spark, files):
    return sorted((r.feed, r.file_seq, r.change, r.field, r.new_field) for r in drift(spark.createDataFrame(lines(files), SCHEMA)).collect())


def test_every_kind_of_change(spark):
    a = [{"t": i, "p": {"u": f"x{i}", "gone": 1}, "d": f"2020-01-0{i}", "s": "1"} for i in range(5)]
    b = [{"t": i, "p": {"href": f"x{i}"}, "when": {"d": f"2020-01-0{i}"}, "s": [1], "new": True} for i in range(5)]
    assert found(spark, [("f", 1, a), ("f", 4, b)]) == [("f", 4, "added", "new", ""), ("f", 4, "removed", "p.gone", ""), ("f", 4, "renamed", "d", "when.d"), ("f", 4, "renamed", "p.u", "p.href"), ("f", 4, "type_changed", "s", "")]


def test_rare_fields_broken_blank_null_and_odd_lines(spark):
    a = [{"x": 1} for _ in range(10)]
    b = [{"x": 1, "rare": 1}] + [{"x": 1} for _ in range(9)] + ["", "  ", None, "{", "[1", {"x": None}]
    c = [{"x": 1, "fifth": 1}, {"x": "odd", "fifth": 2}] + [{"x": 1}] * 8
    assert found(spark, [("f", 1, a), ("f", 2, b), ("f", 3, c)]) == [("f", 3, "added", "fifth", "")]


def test_nulls_and_very_long_lines(spark):
    rows = [(1, None, 1, 1, "k", json.dumps({"old": "v" * 300_000, "n": 1}), None), (2, None, 1, None, None, json.dumps({"old": "w", "n": 1}), None)]
    rows += [(3, None, 2, 1, "k", json.dumps({"new": "v" * 300_000, "n": "1"}), None), (4, None, 2, 1, "k", json.dumps({"new": "v" * 300_000, "n": "1"}), None), (5, None, None, 1, "k", json.dumps({"zzz": 1}), None)]
    got = sorted((r.feed, r.file_seq, r.change, r.field, r.new_field) for r in drift(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(None, 2, "renamed", "old", "new"), (None, 2, "type_changed", "n", "")]


def test_share_of_equal_values_decides(spark):
    a = [{"old": i} for i in range(10)]
    b = [{"new": i if i < 8 else -1} for i in range(10)]
    c = [{"other": i if i < 7 else -1} for i in range(10)]
    assert found(spark, [("f", 1, a), ("f", 2, b)]) == [("f", 2, "renamed", "old", "new")]
    assert found(spark, [("f", 1, a), ("f", 2, c)]) == [("f", 2, "added", "other", ""), ("f", 2, "removed", "old", "")]


def test_empty_table_and_single_file(spark):
    assert found(spark, []) == []
    assert found(spark, [("f", 1, [{"x": 1}])]) == []


def test_ties_are_settled_by_the_flooded_scores():
    old = [("page.url", "string"), ("page.rev", "number"), ("lead", "string")]
    new = [("page.href", "string"), ("page.rev", "number"), ("content.lead", "string")]
    scores = flood(old, new)
    same = {(p, q): scores[p, q] for p in ("page.url", "lead") for q in ("page.href", "content.lead")}
    assert {x for x in changes_between(old, new, same) if x[0] == "renamed"} == {("renamed", "page.url", "page.href"), ("renamed", "lead", "content.lead")}
    assert scores[("page.url", "page.href")] > scores[("lead", "page.href")]


def test_flooding_proposes_where_values_do_not_decide(spark, monkeypatch):
    """Both lost fields and both new ones hold the same values: only the schema graphs tell which became which."""
    a = [{"page": {"url": f"v{i}", "rev": i}, "lead": f"v{i}"} for i in range(5)]
    b = [{"page": {"href": f"v{i}", "rev": i}, "content": {"lead": f"v{i}"}} for i in range(5)]
    files = [("f", 1, a), ("f", 2, b)]
    assert found(spark, files) == [("f", 2, "renamed", "lead", "content.lead"), ("f", 2, "renamed", "page.url", "page.href")]
    monkeypatch.setattr(schema_drift, "flood", lambda old, new, **_: {(p, q): 0.0 for p, _ in old for q, _ in new})
    assert found(spark, files) != [("f", 2, "renamed", "lead", "content.lead"), ("f", 2, "renamed", "page.url", "page.href")]


def test_keys_that_are_data_belong_to_no_file(spark):
    a = [{"x": i, "by_id": {f"id{i}_{k}": 1 for k in range(50)}} for i in range(20)]
    assert found(spark, [("f", 1, a), ("f", 2, [{"y": i} for i in range(20)])]) == [("f", 2, "renamed", "x", "y")]


def test_correspondence_is_one_to_one_and_as_large_as_possible():
    assert correspond({("a", "x"): 0.9, ("a", "y"): 0.5, ("b", "x"): 0.1}) == {"a": "y", "b": "x"}


def test_one_table_keeps_everything(spark):
    a = [{"dateAdded": f"2020-0{i + 1}", "n": i, "l": ["x"]} for i in range(7)]
    b = [{"date_added": f"2020-0{i + 1}", "n": str(i), "l": "x"} for i in range(5)] + ["{", ""]
    c = [{"N": 1, "date_added": "2021", "n": "odd"}]
    rows = spark.createDataFrame(lines([("f", 1, a), ("f", 2, b), ("f", 3, c)]), SCHEMA)
    made = consistent(rows, ["line_id", "feed", "file_seq", "path"])
    got = {r.line_id: r for r in made.collect()}
    assert len(got) == 13
    assert got[8].dateAdded == "2020-01" and got[8].n == 0.0 and got[8].l == ["x"] and got[8].path == "clash"
    assert got[15].dateAdded == "2021" and got[15].rest == {"n": '"odd"'}


def test_casts_and_names():
    assert cast_value(["3"], "number") == 3.0 and cast_value("no", "boolean") is False and cast_value(True, "number") is None
    assert cast_value([1, 2], "number") is None and cast_value([1, 2], "string") == "[1, 2]" and cast_value("a", "array") == ["a"]
    assert column_names(["a.b", "A.B", "rest"], {"rest"}) == {"a.b": "a_b", "A.B": "A_B_2", "rest": "rest_2"}
    assert dict(leaves_of({"a": {"b": None, "c": {}}, "d": [1]})) == {"d": [1]}
