import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import events as E
from quern.operators import graph as G
from quern.operators import graph_build as B
from quern.operators import inventory as I
from quern.operators import lookup as L
from quern.operators import nested as N
from quern.operators import relational as R
from quern.operators.temporal import available_at
from quern.sources import lines as S
from quern.sources.paged import fetch_json, pages
from quern.streaming import state as ST


def test_equal_rows_share_a_rank_but_not_a_position(spark):
    rows = spark.createDataFrame([("a", 9, 5), ("b", 9, 5), ("c", 9, 4), ("d", 1, 1)], "n string, level int, time int")
    assert {r.n: r.rank for r in R.competition_rank(rows, "level", "time").collect()} == {"c": 1, "a": 2, "b": 2, "d": 4}
    assert [r.n for r in R.position(rows, [("level", True), ("time", False), ("n", False)]).orderBy("position").collect()] == ["c", "a", "b", "d"]
    assert R.hide_names(rows, "n", []).count() == 4 and R.hide_names(rows, "n", ["A"]).count() == 3


def test_availability_order(spark):
    cases = [("2004-09-07", None, "available_at_cutoff"), ("2004-09-08", None, "added_after_cutoff"), ("2004", None, "added_after_cutoff"), ("2004-08", None, "available_at_cutoff"), ("2003", "2004-09-07", "removed_on_or_before_cutoff"), ("2003", "2004", "available_at_cutoff"), (None, None, "unknown_added_date"), ("Early beta", None, "unknown_added_date")]
    rows = spark.createDataFrame(cases, "a string, r string, want string")
    assert all(x.reason == x.want for x in available_at(rows, [F.col("a")], F.col("r")).collect())
    lax = available_at(rows.where("a is null"), [F.col("a")], F.col("r"), lax=True).first()
    assert lax.reason == "unknown_added_included" and lax.kept


def test_pagerank_sums_to_one_and_spreads_loose_mass(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("a", "zz", 9.0)], "source string, target string, weight double")
    got = {r.id: r.rank for r in G.pagerank(nodes, edges, rounds=25).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    share = {("a", "b"): 0.25, ("a", "c"): 0.75, ("b", "c"): 1.0, ("c", "a"): 1.0}
    for _ in range(25):
        rank = {n: 0.15 / 4 + 0.85 * (sum(rank[s] * w for (s, t), w in share.items() if t == n) + rank["d"] / 4) for n in rank}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[n] - rank[n]) < 1e-9 for n in rank)
    assert G.pagerank(nodes.where("false"), edges).count() == 0


def test_pagerank_adds_up_repeated_edges_and_leaves_null_names_out(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 1.0), ("c", "b", None), (None, "a", 5.0), ("a", None, 5.0)], "source string, target string, weight double")
    rank = dict.fromkeys(["a", "b", "c", None], 0.25)
    for _ in range(25):
        even = 0.15 / 4 + 0.85 * (rank["c"] + rank[None]) / 4
        rank = {"a": even + 0.85 * rank["b"], "b": even + 0.85 * 0.75 * rank["a"], "c": even + 0.85 * 0.25 * rank["a"], None: even}
    got = {r.id: r.rank for r in G.pagerank(nodes, edges).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-9 for n in rank)


def test_edges_and_nodes_merge(spark):
    edges = spark.createDataFrame([(1, "a", "b", "r", None, 1.0), (2, "a", "b", "r", None, 2.0), (3, "a", "b", "r", "f", 1.0), (4, "a", "a", "r", None, 1.0), (5, "a", None, "r", None, 1.0)], "edge_id int, source string, target string, relation string, field string, weight double")
    got = {(r.field, r.weight, r.evidence, r.first_seen) for r in G.merge_edges(edges, "edge_id").collect()}
    assert got == {(None, 3.0, 2, 1), ("f", 1.0, 1, 3)}
    nodes = spark.createDataFrame([(1, "x", "page", "A"), (2, "x", "item", None), (3, "x", None, "B"), (4, "y", "item", None)], "k int, id string, kind string, label string")
    assert {(r.id, r.kind, r.label, r.deliveries) for r in G.merge_nodes(nodes, "k", ["kind", "label"]).collect()} == {("x", "page", "B", 3), ("y", "item", None, 1)}


def test_lists_find_a_row_twice(spark):
    spec = L.TableSpec(1, {"l": (("int", "string"), True, None), "p": (("int",), False, (5,))})
    rows = spark.createDataFrame([(1, 10, [(3, "a"), (3, "b")], None), (1, 11, [(4, "c")], [(8,)]), (2, 12, [(3, "d")], None)], "table_id int, row_id int, l array<struct<f0:int,f1:string>>, p array<struct<f0:int>>")
    assert [(r.row_id, r.ord) for r in L.find(rows, spec, "l", 3).orderBy("ord").collect()] == [(10, 0), (10, 1)]
    assert L.find(rows, spec, "p", 8).count() == 0
    got = {r.row_id: (r.v, r.p, r.n) for r in rows.select("row_id", L.get_field(spec, "l", F.lit(1), 1).alias("v"), L.get_field(spec, "p", F.lit(0)).alias("p"), L.field_count(spec, "l").alias("n")).collect()}
    assert got == {10: ("b", 5, 2), 11: ("", 8, 1), 12: ("", 5, 0)}


def test_inventory_log(spark):
    log = [("o", 1, 7, 5, False), ("o", 2, 8, 1, False), ("o", 3, 9, 1, False), ("o", 4, 7, -9, True), ("o", 5, 7, 2**31 - 1, True), ("o", 6, 8, -1, False), ("o", 7, 9, 4, False), ("p", 1, 1, -1, False), (None, 1, 1, 1, False)]
    rows = spark.createDataFrame(log, "who string, at int, item bigint, amount bigint, all_or_nothing boolean")
    assert sorted(tuple(r) for r in I.apply_log(rows, "who", "at", 2).collect()) == [("o", 0, 7, 5), ("o", 1, 9, 4)]


def test_knowledge_keeps_the_last_tick_and_merges_to_the_largest(spark):
    schema = "k string, tick int, at int, o string"
    a = E.observe(spark.createDataFrame([("x", 9, 1, "p"), ("x", 4, 2, "q")], schema), ["k"], "tick", "at", "o")
    b = E.observe(spark.createDataFrame([("x", 2, 3, "p"), ("y", 1, 1, "r")], schema), ["k"], "tick", "at", "o")
    assert {(r.k, r.seen, r.last_tick, tuple(r.options)) for r in E.merge_knowledge(a, b, ["k"]).collect()} == {("x", 3, 4, ("p", "q")), ("y", 1, 1, ("r",))}


def test_checks_and_metrics(spark):
    rows = spark.createDataFrame([("m", True, 4.0), ("m", False, None), ("n", None, 2.0)], "k string, ok boolean, v double")
    got = {r.k: (r.runs, r.successes, r.avg_v, r.rate) for r in E.metrics(rows, ["k"], F.col("ok"), ["v"]).collect()}
    assert got == {"m": (2, 1, 2.0, 0.5), "n": (1, 0, 2.0, 0.0)}
    v = E.verify(rows, {"a": F.col("ok"), "b": F.col("v") > 1}).collect()
    assert [(r.passed, r.failed, r.success) for r in v] == [(["a", "b"], [], True), ([], ["a", "b"], False), (["b"], ["a"], False)]


def test_heading_paths_and_plan(spark):
    rows = spark.createDataFrame([(1, [("2", "A"), ("3", "B"), ("2", "C"), ("4", None)])], "id int, h array<struct<level:string,line:string>>")
    assert [r.path for r in N.heading_paths(rows, "id", "h").orderBy("at").collect()] == ["A", "A > B", "C", "C > "]
    actions = spark.createDataFrame([("get", [["here"]], ["has"], []), ("go", [["here"], ["has", "map"]], ["there"], ["here"]), ("back", [["there"]], ["here"], ["there"])], "name string, needs array<array<string>>, adds array<string>, removes array<string>")
    found = N.plan(["here"], ["there"], actions, 5).first()
    assert found.steps == 2 and found.actions == ["get", "go"]
    assert N.plan(["here"], ["nowhere"], actions, 5).count() == 0 and N.plan(["here"], ["here"], actions, 5).first().steps == 0


def test_edges_from_records(spark):
    rows = spark.createDataFrame([("A b", ["x", None, " ", "y", "z"], ["C_d", "C d"])], "t string, l array<string>, c array<string>")
    made = B.edges_from(rows, B.page_id(F.col("t")), [("wiki_link", F.col("l"), "page"), ("in_category", F.col("c"), "category")], 2)
    assert sorted((r.source, r.target, r.relation) for r in made.collect()) == [("page:a b", "category:c d", "in_category")] * 2 + [("page:a b", "page:x", "wiki_link"), ("page:a b", "page:y", "wiki_link")]


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n\n  \n{"a": 2\n[1]\nnull\n{"a": "odd"}\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StructType([T.StructField("c", T.StringType())]))])
    parsed = S.parse_json_lines(S.read_lines(spark, str(tmp_path)), "body", schema)
    r = S.counters(parsed, []).first()
    assert (r["read"], r.parsed, r.errors) == (7, 1, 4) and S.counters(parsed, [], False).first()["read"] == 5
    with pytest.raises(Exception):
        S.parse_json_lines(S.read_lines(spark, str(tmp_path)), "body", schema, strict=True).collect()
    rows = spark.createDataFrame([(1, 'a "q", b', ["x", "y"], None)], "i int, s string, l array<string>, n string")
    assert S.csv_always_quoted(rows).first().line == '"1","a ""q"", b","x|y",'
    assert S.csv_quoted_where_needed(rows).first().line == '1,"a ""q"", b","[""x"",""y""]",'
    assert spark.range(1).select(S.split_quoted(F.lit('a,"b,c",d')).alias("c")).first().c == ["a", "b,c", "d"]
    lines = spark.createDataFrame([("1, 2,3",), ("// no",), ("1,2",), (None,)], "body string")
    assert [r.cells for r in S.read_csv_cells(lines, "body", 3).collect()] == [["1", "2", "3"]]
    S.write_json_lines(rows, str(tmp_path / "out"))
    ST.fan_out(rows, [str(tmp_path / "p"), str(tmp_path / "q"), str(tmp_path / "p")])
    assert spark.read.json(str(tmp_path / "out")).count() == spark.read.json(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "q")).count() == 1


def test_paged_source_follows_continuations_and_retries():
    asked, slept = [], []
    answers = [{"items": [1], "continue": {"from": "b"}}, {"items": [2]}]
    found = list(pages("http://x", {"q": "1"}, lambda u: asked.append(u) or answers[len(asked) - 1], 0.5, slept.append))
    assert [f["items"] for f in found] == [[1], [2]] and asked == ["http://x?q=1", "http://x?q=1&from=b"] and slept == [0.5]

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return json.dumps({"ok": 1}).encode()

    tries, pauses = [], []

    def get(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("down")
        return Answer()

    assert fetch_json("u", pause=1, get=get, sleep=pauses.append) == {"ok": 1} and pauses == [1, 2]


def test_state_of_streams_matches_batch_for_late_rows(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 2), "b")], "u int, ts timestamp_ntz, v string")
    now = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:10"))
    got = ST.staleness(rows.groupBy("u").agg(F.max("ts").alias("ts")), "ts", now, 8, 60).first().status
    assert got == "stale"


def test_upsert_actions(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, "y"), (3, None, "z")], "k int, v int, w string")
    new = spark.createDataFrame([(1, 5, "changed"), (2, 7, "new"), (4, 1, "in"), (3, None, "q")], "k int, v int, w string")
    got = {r.k: (r.v, r.w, r.action) for r in R.upsert(old, new, ["k"], ["v", "w"], ["v"]).collect()}
    assert got == {1: (5, "x", "kept"), 2: (7, "new", "updated"), 3: (None, "z", "kept"), 4: (1, "in", "inserted")}
