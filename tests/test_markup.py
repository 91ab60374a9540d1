from pyspark.sql import functions as F

from quern.functions import markup as M

TEXT = """{{Infobox|name = [[A|b=c]] {{x|1=2}} | pos1 |key2=v}}<!-- {{hidden}} -->
'''Bold''' start of [[the lead|a lead]] with [[File:x.png|thumb]] and <ref>gone {{cite}}</ref>text.

Second paragraph &amp; more.

Third.
== One ==
body [[One]]
=== Two ===
deep
== One ==
again {{unclosed
"""


def test_templates():
    found = M.templates_of(TEXT)
    assert [t["name"] for t in found] == ["Infobox"] + ["cite"]
    assert found[0]["named"] == {"name": "[[A|b=c]] {{x|1=2}}", "key2": "v"} and found[0]["positional"] == ["pos1"]
    assert M.templates_of(None) == [] and M.templates_of("{{{{}}}}") == [] and M.spans("}}{{a}}{{") == [(2, 7)]
    assert M.templates_of("{{a|x=1|x=2}}")[0]["named"] == {"x": "2"}


def test_sections_and_lead():
    s = M.sections_of(TEXT)
    assert [(x["level"], x["path"], x["anchor"]) for x in s] == [(1, "", ""), (2, "One", "One"), (3, "One > Two", "Two"), (2, "One", "One_2")]
    assert M.lead_of(TEXT) == "Bold start of a lead with and text.\n\nSecond paragraph & more."
    assert M.plain_text(None) is None and M.plain_text("[[a]] [[b|c]] {{x|{{y}}}}*z") == "a c *z"
    assert M.lead_of(None) == "" and len(M.sections_of("")) == 1


def test_frames(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, t string")
    assert M.explode_templates(rows, "id", "t").count() == 2
    assert M.explode_sections(rows, "id", "t").count() == 6
    assert [r.plain for r in M.rendered(rows.where("id > 1"), "id", "t").collect()] == [None, ""]


def test_numbered_and_slots(spark):
    named = {"name1": "a", "name2": "b", "id2": "7", "empty3": " ", "plain": "x", "mat1": "m", "mat3": "n", "mat1quantity": "2", "mat11": "no"}
    row = spark.createDataFrame([(named,)], "m map<string,string>").select(M.numbered(F.col("m")).alias("v"), M.slots(F.col("m"), {"item": "mat{}", "n": "mat{}quantity"}).alias("s")).first()
    assert {v["index"]: v["fields"] for v in row.v}[2] == {"name": "b", "id": "7"}
    assert [(s["slot"], s["item"], s["n"]) for s in row.s] == [(1, "m", "2"), (3, "n", None)]
