import json

from quern.operators.shredding import Group, assemble, shred, siblings

GROUPS = (Group("kids", (("doc", ("kids",)), ("more", ())), ("name", "age"), (Group("toys", leaves=("kind",), key="toys"),)), Group("tags", (("tags", ()),), scalar=True))
CHILDREN = {"kid": "kids", "toy": "kids.toys", "tag": "tags"}


def brute(rows):
    out = []
    for rid, doc, more, tags, _ in rows:
        def parse(x):
            try:
                return json.loads(x) if x is not None else None
            except ValueError:
                return None

        d = parse(doc)
        kids = siblings(d.get("kids")) if isinstance(d, dict) else []
        kids = kids + siblings(parse(more))
        for i, k in enumerate(kids):
            if isinstance(k, dict) and k:
                out.append((rid, "kid", -1, i))
                for j, t in enumerate(siblings(k.get("toys"))):
                    if isinstance(t, dict) and t:
                        out.append((rid, "toy", i, j))
        for i, t in enumerate(tags or []):
            if t and t.strip():
                out.append((rid, "tag", -1, i))
    return sorted(out, key=str)


ROWS = [
    (1, json.dumps({"kids": [{"name": "a", "toys": [{"kind": "x"}, None, {}, {"kind": None}]}, None, {}, {"age": None}, "odd", {"z": [1, {"q": 2}]}]}), None, ["p", "", None, " ", "q"], "c"),
    (2, json.dumps({"kids": {"0": {"name": "b"}, "1": {}, "2": {"toys": {"kind": "lone"}}}}), None, None, "c"),
    (3, json.dumps({"kids": {"name": "lone", "toys": json.dumps([{"kind": "in text"}])}}), None, [], None),
    (4, None, json.dumps([{"name": "other place"}]), None, None),
    (5, "{broken", "[{\"name\": \"kept\"}]", None, None),
    (6, json.dumps({"kids": "[{\"name\": \"text\"}]"}), "null", None, None),
    (7, json.dumps([1, 2]), "3", None, None),
    (None, json.dumps({"kids": [{"name": "no id"}]}), None, None, None),
    (2, json.dumps({"kids": [{"name": "again"}]}), None, None, None),
    (8, json.dumps({"kids": [{"name": "n" * 10, "toys": [{"kind": str(i)} for i in range(3000)]}]}), None, None, None),
]
SCHEMA = "record_id bigint, doc string, more string, tags array<string>, child string"


def test_positions_match_brute_force(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for leaves in (None, ["kids.*", "kids.toys.*", "tags.*"]):
        found = assemble(shred(rows, "record_id", GROUPS, leaves), CHILDREN).collect()
        assert sorted(((r.record_id, r.child, r.parent_ord, r.child_ord) for r in found), key=str) == brute(ROWS)


def test_attributes_and_rest_keep_all_content(spark):
    rows = spark.createDataFrame(ROWS[:1], SCHEMA)
    made = assemble(shred(rows, "record_id", GROUPS), {"kid": "kids"}, {"kid": ("name", "age", "*")})
    got = {r.child_ord: r.attributes for r in made.collect()}
    assert got[0] == {"name": "a"} and got[3] == {}
    assert json.loads(got[5]["*"]) == {"z": [1, {"q": 2}]}


def test_levels(spark):
    rows = spark.createDataFrame(ROWS[:1], SCHEMA)
    r = shred(rows, "record_id", GROUPS, ["kids.name", "kids.toys.kind"]).first()
    assert (list(r["kids__name"].r), list(r["kids__name"].d)) == ([0, 1, 1, 1, 1, 1], [4, 1, 1, 2, 1, 2])
    assert (list(r["kids__toys__kind"].r), list(r["kids__toys__kind"].d)) == ([0, 2, 2, 2, 1, 1, 1, 1, 1], [6, 3, 3, 5, 1, 1, 2, 1, 2])


def test_empty_table(spark):
    assert assemble(shred(spark.createDataFrame([], SCHEMA), "record_id", GROUPS), CHILDREN).count() == 0
