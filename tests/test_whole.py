"""Queries do the whole job of the reference: no cuts of their own."""

import datetime
import math

from quern.operators import graph as G
from quern.plans import building, graphs, records, searching
from quern.runtime import scope

LINK = "array<struct<ns:int,title:string,exists:boolean>>"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_all_links_of_a_page_are_edges_up_to_the_hundred_of_the_reference(spark, tmp_path):
    links = lambda n: [(0, f"t{i}", None) for i in range(n)]
    write(spark, tmp_path, "raw_pages", [(1, "Few", links(7), []), (2, "Many", links(105), [])], f"raw_id bigint, title string, links {LINK}, categories array<struct<category:string,hidden:boolean,sortkey:string>>")
    counts = {r.source: r["count"] for r in building.graph_edges_built(spark, str(tmp_path)).groupBy("source").count().collect()}
    assert counts == {"page:few": 7, "page:many": 100}
    assert building.graph_nodes_built(spark, str(tmp_path)).count() == 102


def graph(spark, folder, nodes, edges):
    columns = "id string, node_key bigint, label string, kind string, primary_type string"
    write(spark, folder, "page_nodes", [(n, i, n, "page", None) for i, n in enumerate(nodes)], columns)
    write(spark, folder, "core_nodes", [], columns)
    write(spark, folder, "graph_edges", [(i, *e, datetime.datetime(2020, 1, 1)) for i, e in enumerate(edges)], "edge_id bigint, source string, target string, relation string, field string, weight double, built_at timestamp")


def test_pagerank_takes_the_25_rounds_of_the_reference(spark, tmp_path):
    graph(spark, tmp_path, ["page:a", "page:b", "page:c"], [("page:a", "page:b", "wiki_link", None, 1.0), ("page:b", "page:a", "wiki_link", None, 1.0), ("page:c", "page:a", "wiki_link", None, 1.0)])
    rank = dict.fromkeys("abc", 1 / 3)
    for _ in range(25):
        rank = {"a": 0.05 + 0.85 * (rank["b"] + rank["c"]), "b": 0.05 + 0.85 * rank["a"], "c": 0.05}
    for query in (graphs.pagerank, graphs.pagerank_subgraph):
        got = {r.id[5:]: r.rank for r in query(spark, str(tmp_path)).collect()}
        assert all(abs(got[n] - rank[n]) < 2e-9 for n in rank)


def test_best_edges_count_the_rank_of_the_target_and_dates(spark, tmp_path):
    link = lambda s, t: (f"page:{s}", f"page:{t}", "wiki_link", None, 1.0)
    info = lambda t, field: ("page:s", t, "infobox_link", field, 5.0)
    graph(spark, tmp_path, ["page:s", "page:a", "page:z", "page:q"], [link("s", "a"), link("s", "z"), link("a", "z"), link("q", "z"), info("page:2004", None), info("page:x", "removal"), ("page:q", "action:dig", "has_action", None, 2.0)])
    rank = {"page:a": 0.1, "page:z": 0.4}
    ranks = spark.createDataFrame(list(rank.items()), "id string, rank double")
    got = {(r.source, r.target): (r.rn, r.score) for r in graphs.best_edges(spark, str(tmp_path), 9, ranks).collect()}
    assert got["page:s", "page:z"][0] < got["page:s", "page:a"][0]
    assert got["page:s", "page:z"][1] == round(1 + math.log1p(rank["page:z"] * 1e5), 6)
    assert got["page:s", "page:2004"][1] == got["page:s", "page:x"][1] == 4.0 and got["page:q", "action:dig"][1] == 6.0


def test_postings_weigh_aliases_types_categories_and_fields(spark, tmp_path):
    columns = "node_key bigint, id string, title string, primary_type string, aliases array<string>, types array<string>"
    write(spark, tmp_path, "page_nodes", [(1, "page:Red_Hat", "Red Hat", "item", ["Cap"], ["item", "cloth"]), (2, "page:red hat", "Red Hat", "item", ["Beret", None], None), (3, "page:plain", "Plain", None, None, None)], columns)
    facts = '{"fields": {"release": ["2004", "soon"], "aka": "the red"}, "recipes": [{"tools": ["Needle"]}]}'
    write(spark, tmp_path, "structured_records", [(1, "Red hat", (["Felt things"],), facts), (2, "red_hat", (None,), None), (3, None, (["x"],), "{}")], "record_id bigint, title string, taxonomy struct<categories:array<string>>, facts string")
    got = {(r.node, r.token): r.weight for r in searching.postings(spark, str(tmp_path)).collect()}
    red = {"red": 14.0, "hat": 12.0, "cap": 10.0, "beret": 10.0, "item": 8.0, "cloth": 4.0, "felt": 3.0, "things": 3.0, "2004": 2.0, "soon": 2.0, "the": 2.0}
    assert got == {**{("page:red hat", k): v for k, v in red.items()}, ("page:plain", "plain"): 12.0}
    pages = {r.node: r for r in searching._pages(spark, str(tmp_path)).collect()}
    assert [[tuple(x) for x in parts] for parts in pages["page:red hat"].recipes] == [[("tools", "Needle")]] and pages["page:plain"].recipes is None


def test_a_context_ranks_pages_once_and_merges_only_the_edges_of_its_starts(spark, sf, monkeypatch):
    runs, merged, pagerank, merge_edges = [], [], G.pagerank, G.merge_edges
    monkeypatch.setattr(G, "pagerank", lambda *a, **k: runs.append(a) or pagerank(*a, **k))
    monkeypatch.setattr(G, "merge_edges", lambda edges, order: merged.append(edges) or merge_edges(edges, order))
    with scope():
        rows = records.search_context(spark, sf).collect()
        starts = {r.node for r in rows if r.part == "match" and r.rn <= 4}
        assert len(runs) == len(merged) == 1
        assert {r.source for r in merged[0].select("source").distinct().collect()} <= starts
