"""Queries over states, lists, lookups and places that stand for a game world, made from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import stats as A
from quern.operators import events as E
from quern.operators import inventory as I
from quern.operators import relational as R
from quern.operators import spatial as P
from quern.runtime import table
from quern.sources import lines as L

CHECKS = (
    ("inventory_contains", {"item": "view", "count": 12}), ("inventory_lacks", {"item": "refund"}), ("inventory_gained", {"item": "^(click|SIGN)", "count": 20}), ("xp_gained", {"skill": "error", "min": 900}),
    ("level_at_least", {"skill": "purchase", "level": 480}), ("position_within", {"x": 100, "z": 10, "tolerance": 40, "level": 1}), ("ui_open", {"ui": "bank"}), ("message_matches", {"pattern": "click.*view"}),
)


def _points(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf, name).select(k.alias("id"), (k % 2).cast("int").alias("level"), (k * 7919 % 97).cast("int").alias("x"), (k * 104729 % 89).cast("int").alias("z"), (k % 3).cast("int").alias("kind"))


def better_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts strictly better than one: larger, or as large and cheaper."""
    return table(spark, sf, "part").where(R.better("p_size", "p_retailprice", F.lit(48), F.lit(1000.0))).select("p_partkey", "p_size")


def three_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Points by level, x and z, each with its place."""
    return R.position(_points(spark, sf, "part", "p_partkey"), [(c, False) for c in ("level", "x", "z", "id")], "place").select("id", "place")


def capped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Which late orders a customer's list of early ones still takes, up to 16 entries."""
    orders, line = table(spark, sf, "orders"), F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00"))
    return R.accept_up_to(orders.where(F.col("o_orderdate") < line), orders.where(F.col("o_orderdate") >= line), "o_custkey", "o_orderkey", 16).select("o_orderkey", "accepted")


def new_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = rows.where(F.col("c_custkey") % 3 == 0).withColumn("c_acctbal", -F.col("c_acctbal")).unionByName(rows.limit(0)).withColumn("c_name", F.lower("c_name"))
    return R.union_new_wins(rows.where(F.col("c_custkey") % 2 == 0), new, ["c_custkey"])


def merged_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """Three lists of records by id: kinds united, the first name that there is."""
    part = table(spark, sf, "part")
    made = [part.where(F.col("p_partkey") % m == 0).select((F.col("p_partkey") % 50).alias("id"), F.array(c, F.lit(c)).alias("kinds"), F.when(F.col("p_partkey") % 100 == 50, F.lit(f"name {m}")).alias("name")) for m, c in ((2, "p_brand"), (3, "p_type"), (5, "p_brand"))]
    merged = R.merge_by_id(made, "id", ["kinds"], ["name"])
    return merged.select("id", F.array_join("kinds", ",").alias("kinds"), "name")


def champions(spark: SparkSession, sf: str) -> DataFrame:
    """For each event type the user with the most points among the first sixteen that have any."""
    gains = table(spark, sf, "events").withColumn("points", F.floor("value"))
    return E.champions(gains, "event_type", "user_id", "points", "event_id", 16)


def seen_places(spark: SparkSession, sf: str) -> DataFrame:
    made = E.observe_places(_points(spark, sf, "orders", "o_orderkey"), ["kind", "level"], ["x"])
    return made.select("kind", "level", F.size("places").alias("n"), F.array_join(F.transform("places", lambda p: p["x"].cast("string")), ",").alias("places"))


def model_report(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown table of the runs of each type: how many, failures, mean and sum."""
    runs = table(spark, sf, "events").withColumn("bad", (F.col("value") < 10).cast("bigint"))
    made = E.metrics(runs, ["event_type"], F.col("value") > 100, ["value"], ["bad"]).select("event_type", "runs", "failures", F.format_number("avg_value", 2).alias("average"), "sum_bad")
    return L.table_lines(made, ["event_type", "runs", "failures", "average", "sum_bad"], ["event_type"])


def verifier_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """All eight kinds of checks on the state of each user."""
    ev, at = table(spark, sf, "events"), F.struct("ts", "event_id")
    by_type = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("value")).alias("xp"), F.floor(F.max("value")).alias("top"))
    maps = by_type.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.struct("event_type", c))).alias(m) for m, c in (("inventory", "n"), ("gained", "n"), ("xp", "xp"), ("levels", "top"))])
    last = ev.groupBy("user_id").agg(F.concat_ws(" ", F.max_by("event_type", at), F.min_by("event_type", at)).alias("m"))
    state = maps.join(last, "user_id").select("*", F.array("m").alias("messages"), F.create_map(F.lit("bank"), F.col("user_id") % 2 == 0).alias("open"), F.col("user_id").alias("x"), (F.col("user_id") % 7).alias("z"), (F.col("user_id") % 2).alias("level"))
    made = E.verify(state, {kind: E.check_column(kind, spec) for kind, spec in CHECKS})
    return made.select("user_id", F.array_join("passed", ",").alias("passed"), "success")


def visible_to(spark: SparkSession, sf: str) -> DataFrame:
    """How many customers each supplier of its nation sees: staff (keys by 10) sees all; others not the private ones and
    not those that ignore them."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 4 == 0).alias("private"), (F.col("c_custkey") % 25).alias("ignored"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10 == 0).alias("staff"), (F.col("s_suppkey") % 25).alias("slot"))
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("everyone"), F.count_if(~F.col("private")).alias("open"))
    ignoring = c.where(~F.col("private")).groupBy(F.col("c_nationkey").alias("_n"), "ignored").agg(F.count(F.lit(1)).alias("off"))
    joined = s.join(per, F.col("s_nationkey") == F.col("c_nationkey"), "left").join(ignoring, (F.col("s_nationkey") == F.col("_n")) & (F.col("slot") == F.col("ignored")), "left")
    return joined.select("s_suppkey", F.coalesce(F.when(F.col("staff"), F.col("everyone")).otherwise(F.col("open") - F.coalesce("off", F.lit(0))), F.lit(0)).alias("visible"))


def stat_changes(spark: SparkSession, sf: str) -> DataFrame:
    base, now, constant, percent = F.col("p_size") * 5, F.col("p_partkey").cast("int") % 260, F.lit(3), (F.col("p_partkey") % 40).cast("int") - 10
    rules = {"added": A.stat_add, "taken": A.stat_sub, "boosted": A.stat_boost, "drained": A.stat_drain, "healed": A.stat_heal}
    return table(spark, sf, "part").select("p_partkey", *[f(base, now, constant, percent).cast("int").alias(k) for k, f in rules.items()])


def things_at(spark: SparkSession, sf: str) -> DataFrame:
    """The first part of the same kind where each supplier stands."""
    return P.find_at(_points(spark, sf, "supplier", "s_suppkey"), _points(spark, sf, "part", "p_partkey"), "kind", "id").select("id", "thing")


def things_in_zone(spark: SparkSession, sf: str) -> DataFrame:
    made = P.in_zone(_points(spark, sf, "supplier", "s_suppkey"), _points(spark, sf, "part", "p_partkey"), "id", "id")
    return made.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("thing").alias("first"))


def slot_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Item and amount of slot 2 of each order, and the stock of its size in a shop of three items."""
    inventory = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("slot")).agg(F.min("l_partkey").alias("item"), F.max(F.floor("l_quantity")).alias("amount"))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("owner"), F.lit(2).alias("slot"))
    stock = F.create_map(*[F.lit(x) for kv in ((0, 7), (1, 9), (4, 0)) for x in kv])
    return I.slot_contents(asked, inventory, "owner").select("owner", "item", "amount", I.stock_base(stock, (F.col("owner") % 5).cast("int")).alias("stock"))


def zone_set(spark: SparkSession, sf: str) -> DataFrame:
    """Zones of lines that are written from points, with a head and comments among them."""
    p = _points(spark, sf, "part", "p_partkey")
    line = F.when(F.col("id") % 17 == 0, F.lit("// none")).otherwise(F.concat_ws(", ", "level", "x", "z"))
    head = spark.createDataFrame([(0, "level,x,z")], "id bigint, line string")
    return L.zone_set(L.without_header(p.select("id", line.alias("line")).unionByName(head), "id"), "line")


QUERIES = {f.__name__: f for f in (better_rows, three_key_sort, capped_lists, new_wins, merged_schemas, champions, seen_places, model_report, verifier_kinds, visible_to, stat_changes, things_at, things_in_zone, slot_reads, zone_set)}

_PT = "SELECT {1} AS id, {1} % 2 AS level, {1} * 7919 % 97 AS x, {1} * 104729 % 89 AS z, {1} % 3 AS kind FROM {0}".format
_D = lambda of: f"CAST(trunc(3 + {of} * percent / 100) AS INTEGER)"
ORACLE = {
    "better_rows": "SELECT p_partkey, p_size FROM part WHERE p_size > 48 OR (p_size = 48 AND p_retailprice < 1000)",
    "three_key_sort": f"SELECT id, row_number() OVER (ORDER BY level, x, z, id) AS place FROM ({_PT('part', 'p_partkey')})",
    "capped_lists": "WITH h AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1) SELECT o_orderkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) <= 16 AS accepted FROM orders o LEFT JOIN h USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '2000-01-01'",
    "new_wins": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "merged_schemas": "WITH r AS (SELECT p_partkey % 50 AS id, 0 AS t, p_brand AS k, 'p_brand' AS c, CASE WHEN p_partkey % 100 = 50 THEN 'name 2' END AS name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey % 50, 1, p_type, 'p_type', CASE WHEN p_partkey % 100 = 50 THEN 'name 3' END FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey % 50, 2, p_brand, 'p_brand', CASE WHEN p_partkey % 100 = 50 THEN 'name 5' END FROM part WHERE p_partkey % 5 = 0), k AS (SELECT id, unnest([k, c]) AS k FROM r) SELECT id, kinds, name FROM (SELECT id, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM k GROUP BY 1) JOIN (SELECT id, arg_min(name, t) FILTER (name IS NOT NULL) AS name FROM r GROUP BY 1) USING (id)",
    "champions": "WITH s AS (SELECT event_type, user_id, CAST(sum(floor(value)) AS BIGINT) AS points, min(event_id) AS f FROM events WHERE floor(value) >= 1 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f, user_id) AS place FROM s) SELECT event_type, user_id, points FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY points DESC, place) AS rn FROM p WHERE place <= 16) WHERE rn = 1",
    "seen_places": f"SELECT kind, level, count(DISTINCT x) AS n, array_to_string(list_sort(list(DISTINCT x)), ',') AS places FROM ({_PT('orders', 'o_orderkey')}) GROUP BY 1, 2",
    "model_report": "WITH m AS (SELECT event_type, count(*) AS runs, count(*) FILTER (value <= 100) AS failures, format('{:,.2f}', avg(value)) AS average, count(*) FILTER (value < 10) AS bad FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY event_type) - 1 AS ord, '| ' || event_type || ' | ' || runs || ' | ' || failures || ' | ' || average || ' | ' || bad || ' |' AS line FROM m UNION ALL SELECT -2, '| event_type | runs | failures | average | sum_bad |' UNION ALL SELECT -1, '| --- | --- | --- | --- | --- |'",
    "verifier_kinds": """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'view') >= 12 AS a, true AS b, count(*) FILTER (event_type IN ('click', 'signup')) >= 20 AS c, coalesce(floor(sum(value) FILTER (event_type = 'error')), 0) >= 900 AS d, coalesce(floor(max(value) FILTER (event_type = 'purchase')), 0) >= 480 AS e,
greatest(abs(user_id - 100), abs(user_id % 7 - 10)) <= 40 AND user_id % 2 = 1 AS f, user_id % 2 = 0 AS g, regexp_matches(arg_max(event_type, (ts, event_id)) || ' ' || arg_min(event_type, (ts, event_id)), 'click.*view') AS h FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN a THEN 'inventory_contains' END, CASE WHEN b THEN 'inventory_lacks' END, CASE WHEN c THEN 'inventory_gained' END, CASE WHEN d THEN 'xp_gained' END, CASE WHEN e THEN 'level_at_least' END, CASE WHEN f THEN 'position_within' END, CASE WHEN g THEN 'ui_open' END, CASE WHEN h THEN 'message_matches' END], lambda x: x IS NOT NULL), ',') AS passed, a AND b AND c AND d AND e AND f AND g AND h AS success FROM s""",
    "visible_to": "SELECT s_suppkey, count(c_custkey) AS visible FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND (s_suppkey % 10 = 0 OR (c_custkey % 4 <> 0 AND c_custkey % 25 <> s_suppkey % 25)) GROUP BY 1",
    "stat_changes": f"WITH p AS (SELECT p_partkey, p_size * 5 AS base, p_partkey % 260 AS now, p_partkey % 40 - 10 AS percent FROM part) SELECT p_partkey, CAST(least(now + {_D('base')}, 255) AS INTEGER) AS added, CAST(greatest(now - {_D('base')}, 0) AS INTEGER) AS taken, CAST(least(greatest(least(now + {_D('base')}, base + {_D('base')}), now), 255) AS INTEGER) AS boosted, CAST(greatest(now - {_D('now')}, 0) AS INTEGER) AS drained, CAST(greatest(least(now + {_D('base')}, base), now) AS INTEGER) AS healed FROM p",
    "things_at": f"WITH t AS (SELECT level, x, z, kind, min(id) AS thing FROM ({_PT('part', 'p_partkey')}) GROUP BY 1, 2, 3, 4) SELECT id, thing FROM ({_PT('supplier', 's_suppkey')}) LEFT JOIN t USING (level, x, z, kind)",
    "things_in_zone": f"WITH t AS ({_PT('part', 'p_partkey')}), s AS ({_PT('supplier', 's_suppkey')}) SELECT s.id AS query, count(*) AS n, min(t.id) AS first FROM s JOIN t ON s.level = t.level AND s.x // 8 = t.x // 8 AND s.z // 8 = t.z // 8 GROUP BY 1",
    "slot_reads": "WITH i AS (SELECT l_orderkey AS owner, min(l_partkey) AS item, CAST(max(floor(l_quantity)) AS BIGINT) AS amount FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT o_orderkey AS owner, coalesce(item, -1) AS item, coalesce(amount, 0) AS amount, CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 9 WHEN 4 THEN 0 ELSE -1 END AS stock FROM orders LEFT JOIN i ON owner = o_orderkey",
    "zone_set": f"SELECT DISTINCT level, x // 8 AS zx, z // 8 AS zz FROM ({_PT('part', 'p_partkey')}) WHERE id % 17 <> 0",
}
