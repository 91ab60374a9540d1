"""Literal values of the scalar rules: marks, numbers, names, dates, types, markup."""

from pyspark.sql import functions as F

from quern.functions import dates as D
from quern.functions import markup as M
from quern.functions import text as X
from quern.operators import nested as N


def each(spark, function, values, kind="string"):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").orderBy("i").select(function(F.col("v"))).collect()]


def test_marks_numbers_and_names(spark):
    assert each(spark, X.tri_state, ["Yes", "TRUE", "y", "no", "False", "N", "Yes, but", "1", "0", "", None]) == [True, True, True, False, False, False, None, None, None, None, None]
    assert each(spark, X.safe_number, [" 12.5 ", "1,234.5", "-3", "1e3", ".5", "x", "Infinity", "NaN", "1d", "", None]) == [12.5, None, -3.0, 1000.0, 0.5, None, None, None, None, None, None]
    assert each(spark, X.base_field, ["Name_1", " Drop  Rate 12", "id", "7", None]) == ["name", "drop rate", "id", "", None]
    assert each(spark, X.decode_entities, ["&amp;lt;&#160;&nbsp;&#039;&apos;&quot;&#39;&gt;", None]) == ["<  ''\"&#39;>", None]
    assert each(spark, X.unique_strings, [["a_b", " a  b ", "A b", "", None, "c"], None], "array<string>") == [["a b", "A b", "c"], None]
    assert each(spark, X.split_list, ["Talk-to, pick_up ,Talk-to,,a/b|c", None]) == [["Talk-to", "pick up", "a/b|c"], []]
    assert each(spark, X.phrase, ["The  Cat_sat, on: Bé!", None]) == ["the cat sat on b", ""]
    rows = spark.createDataFrame([("My_Page", ["my page, Other", "Third"], ["MY PAGE", "Name, one"]), (None, None, None)], "t string, a array<string>, b array<string>")
    assert [r[0] for r in rows.select(X.aliases(F.col("t"), F.col("a"), F.col("b"))).collect()] == [["Other", "Third", "Name, one"], []]
    got = spark.createDataFrame([({"Name1": "A_x", "name2": "b", "name 3": "A x", "": "q", "empty": " "},)], "m map<string,string>").select(X.field_map(F.col("m"))).first()[0]
    assert got == {"name": ["A x", "b"]}


def test_lists_however_they_are_written(spark):
    texts = ['{"l": ["a", null, "b"]}', '{"l": {"0": "a", "1": "b"}}', '{"l": "a"}', r'{"l": "[\"a\", \"b\"]"}', '{"l": null}', "{}", None]
    assert each(spark, lambda c: X.listed(F.get_json_object(c, "$.l")), texts) == [["a", None, "b"], ["a", "b"], ["a"], ["a", "b"], None, None, None]


def test_amounts_and_times(spark):
    assert each(spark, X.gold_amount, [0, 999, 99_999, 100_000, 1_234_567, 9_999_999, 10_000_000, None], "bigint") == ["0", "999", "99,999", "100K", "1234K", "9999K", "10M", None]
    assert each(spark, X.stack_amount, [999, 1000, 999_999, 1_000_000, 1_999_999_999, None], "bigint") == ["999", "1K", "999K", "1M", "1B", None]
    assert each(spark, X.play_time, [0, 100, 6000, 12_100], "bigint") == ["0m", "1m", "1h 0m", "2h 1m"]


def test_types_by_rule_and_priority(spark):
    rows = [(["Members' quests", "Edible_Items"], None), (["Itemised"], ["Infobox  NPC"]), (["Cities"], ["Quest details"]), (["Training", "Music tracks", None], []), (None, None)]
    df = spark.createDataFrame(rows, "c array<string>, t array<string>").select(X.matched_types(F.col("c"), F.col("t")).alias("x")).select("x", X.primary_type(F.col("x")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [(["quest", "item"], "item"), (["npc"], "npc"), (["quest", "location"], "quest"), (["guide", "music"], "guide"), ([], "article")]


def test_date_candidates(spark):
    cases = {
        "7 September 2004": ("2004-09-07", "day"), "added on 27 [[may]] 2013": ("2013", "year"), "on  3  MAY 2013, late": ("2013-05-03", "day"), "September 2004": ("2004-09", "month"), "in 2004.": ("2004", "year"),
        "2004-09-07": ("2004", "year"), "1899": ("1899", "raw"), "soon": ("soon", "raw"), " Unknown ": None, None: None, " ": None,
    }
    made = each(spark, D.date_candidate, list(cases))
    assert [r and (r["value"], r["precision"]) for r in made] == list(cases.values())


def test_lifecycle(spark):
    rows = [
        (1, {"release": ["6 May 2013", "April 2012"], "removed": ["unknown"]}, ["Content released in 2001", "Content removed in 2015", None]),
        (2, {"name": ["2001"]}, ["content released in 2007", "Content released in 2006"]), (3, None, None), (4, {"start date": None, "added": ["x 2009"]}, []),
    ]
    df = spark.createDataFrame(rows, "k int, f map<string,array<string>>, c array<string>").select("k", D.lifecycle(F.col("f"), F.col("c")).alias("l"))
    got = {r.k: (r.l.added and tuple(r.l.added), r.l.removed and tuple(r.l.removed), r.l.content_years) for r in df.collect()}
    assert got == {
        1: (("2012-04", "month", "infobox:release"), ("2015", "year", "category"), [2001, 2015]), 2: (("2007", "year", "category"), None, [2006, 2007]),
        3: (None, None, []), 4: (("2009", "year", "infobox:added"), None, []),
    }


def test_fact_names(spark):
    assert each(spark, N.fact_name, [" Raw Shrimp!", "__a__", "", None]) == ["raw_shrimp", "a", "", ""]
    assert each(spark, N.alternatives, ["Fire | Cooking range||_|Fire", None]) == [["fire", "cooking_range", "fire"], []]
    row = spark.range(1).select(N.state_facts(*[F.lit(None).cast(t) for t in ("map<string,int>", "array<struct<name:string,options:array<string>>>", "array<string>", "array<struct<name:string,count:int>>", "map<string,boolean>", "array<struct<name:string,level:int,xp:int>>")])).first()
    assert row[0] == []


def test_plain_text_step_by_step():
    cases = {
        "a<!-- x\ny -->b": "ab", "a{| t\n| c\n|}b": "a b", "a<ref name=x>y</ref>b<REF n=1 />c": "a b c", "{{Mes|said|x=1}}!": "said!", "a[[File:x.png|thumb]]b[[category:z]]c": "a b c",
        "[[A#s|label]] [[B#s]]": "label B", "[https://x.y/z the site] [http://x]": "the site", "{{a|{{b}}{{c|{{d}}}}}}e": "e", "''i'' '''b'''": "i b", "== Head ==\ntext": "Head\ntext", "a<br/>b": "a b",
        "&amp;lt;&nbsp;x": "< x", "a\n\n\n\nb \t c": "a\n\nb c", "{{open": "{{open",
    }
    assert {k: M.plain_text(k) for k in cases} == cases
    assert M.without_templates("{{" * 25 + "}}" * 25).count("{{") == 5


def test_top_matter_and_maps():
    top = "<!-- c -->{{a|{{b}}}}\n[[File:x.png|t]] {|\n| t\n|}\n"
    assert M.below_top_matter(f"{top}''Read'' {{{{me}}}}") == "''Read'' {{me}}"
    assert M.below_top_matter("{{never closed") == "{{never closed" and M.below_top_matter("  x") == "x"
    assert M.lead_of("{{Infobox|a=b\n\nc}}\nOne.\n\nTwo.\n\nThree.\n==H==\nx") == "One.\n\nTwo."
    assert M.maps_of("map", "{{Map|x=1|y=2|plane=0|r=3|mtype=pin|name=[[A|b]]}} {{map|x=q}}") == [
        {"field": "map", "x": 1.0, "y": 2.0, "plane": 0.0, "radius": 3.0, "type": "pin", "name": "b"},
        {"field": "map", "x": None, "y": None, "plane": None, "radius": None, "type": None, "name": ""},
    ]
    assert M.maps_of("map", None) == []
