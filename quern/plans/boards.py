"""Leaderboards and other relational queries over customers, orders, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.runtime import table

HIDDEN = ["customer#000000007", "CUSTOMER#000000011"]


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    """name, orders, total: how often a customer ordered and for how much in whole units."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.floor("o_totalprice")).alias("total"))
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment", "orders", "total")


def leaderboard_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Most orders first, the smaller total first among equals; hidden names left out; the first 50."""
    ranked = R.competition_rank(R.hide_names(_totals(spark, sf), "name", HIDDEN), "orders", "total")
    return ranked.select("name", "orders", "total", "rank").orderBy("rank", "name").limit(50)


def leaderboard_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return R.competition_rank(_totals(spark, sf), "orders", "total", ["c_mktsegment"]).select("c_mktsegment", "name", "orders", "total", "rank")


def leaderboard_position(spark: SparkSession, sf: str) -> DataFrame:
    return R.position(_totals(spark, sf), [("orders", True), ("total", False), ("c_custkey", False)]).select("name", "orders", "total", "position")


def leaderboard_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(leaderboard_position(spark, sf), 10)


def rank_by_count(spark: SparkSession, sf: str) -> DataFrame:
    """The rank of each customer on market segment BUILDING, counted as better rows plus one by a window."""
    rows = _totals(spark, sf).where(F.col("c_mktsegment") == "BUILDING")
    return R.competition_rank(rows, "orders", "total", ["c_mktsegment"]).select("name", "rank")


def hidden_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.hide_names(table(spark, sf, "customer"), "c_name", HIDDEN).select("c_custkey", "c_name")


def playtime_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """The top 15 % of orders by price, ties with the last kept."""
    return R.top_share(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.15)


def wealth_excluding_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Value of each order's lines but for those of slot 3, in whole units."""
    lines = table(spark, sf, "lineitem")
    value = F.floor(F.col("l_extendedprice")) * F.floor("l_quantity")
    return lines.groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("l_linenumber") != 3, value)), F.lit(0)).alias("wealth"))


def wealth_items_list(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier's parts on returned lines: the value and the item list, most valuable first, as text.

    The list of a supplier holds one entry per part, so its length is bounded by the parts and not by the lines.
    """
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    items = lines.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.floor("l_extendedprice")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("k"), F.col("l_partkey").alias("p"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["p"].cast("string"), (-x["k"]).cast("string"))), ",")
    return items.groupBy("l_suppkey").agg(F.sum("v").alias("wealth"), text.alias("items"))


def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of nations that trade: customer's nation, supplier's nation, orders; two hops over orders and lines."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer"))), "c_nationkey")
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))), "s_nationkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "seller"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c.select("c_custkey", "buyer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("buyer", "seller").agg(F.count(F.lit(1)).alias("lines"))


def left_join_extra_on(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer with its orders of status F only; customers without any stay."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    cond = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F")
    return table(spark, sf, "customer").join(orders, cond, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first_order"))


def unread_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Users with their number of event types (threads) whose last event came after their last view, or never viewed."""
    ev = table(spark, sf, "events")
    last = ev.where(F.col("event_type") != "view").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"))
    seen = ev.where(F.col("event_type") == "view").groupBy("user_id").agg(F.max("ts").alias("read_at"))
    unread = F.col("read_at").isNull() | (F.col("read_at") < F.col("last_at"))
    return last.join(seen, "user_id", "left").where(unread).groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))


def refine_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of parts of size over 40, refined to parts of one brand; repeated lines stay."""
    part = table(spark, sf, "part")
    found = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part.where(F.col("p_size") > 40).select("p_partkey"), "p_partkey", "left_semi")
    return R.refine(found, part.where(F.col("p_brand") == "Brand#11"), ["p_partkey"]).select("l_orderkey", "p_partkey")


def resume_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches that neither by page id nor by title are among the structured records."""
    pages = table(spark, sf, "raw_pages").select("raw_id", "pageid", "title")
    title = lambda c: F.lower(F.trim(F.translate(F.col(c), "_", " ")))
    known = table(spark, sf, "structured_records").select("pageid", title("title").alias("t"))
    return R.skip_known(pages, known, [(F.col("pageid"), "pageid"), (title("title"), "t")]).select("raw_id")


def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users with three or more in the twelve hours before."""
    return R.limited(table(spark, sf, "events"), "user_id", "ts", 43_200, 3, "event_id").select("event_id", "user_id", "recent")


def upsert_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with new balances: some the same, some changed, some new."""
    stored = table(spark, sf, "customer").select("c_custkey", F.floor("c_acctbal").alias("balance"), "c_mktsegment")
    newer = F.when(F.col("c_custkey") % 3 == 0, F.col("balance") + 5).otherwise(F.col("balance"))
    incoming = stored.where(F.col("c_custkey") % 2 == 1).select((F.col("c_custkey") + F.when(F.col("c_custkey") % 5 == 0, 1_000_000_000).otherwise(0)).alias("c_custkey"), newer.alias("balance"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return R.upsert(stored, incoming, ["c_custkey"], ["balance", "c_mktsegment"], ["balance"])


def delete_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Orders but for those of customers with a negative balance."""
    doomed = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return R.delete_where_in(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), doomed, ["o_custkey"]).select("o_orderkey", "o_custkey")


def insert_ignore_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    have = part.where(F.col("p_size") > 10).select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).distinct()
    return R.insert_ignore(have, part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), ["brand", "kind"])


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers under one header; what one of them lacks is null."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.floor("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.floor("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (leaderboard_rank, leaderboard_by_segment, leaderboard_position, leaderboard_page, rank_by_count, hidden_filter, playtime_cutoff, wealth_excluding_slot, wealth_items_list, two_hop, left_join_extra_on, unread_threads, refine_semi, resume_skip, rate_limited, upsert_customers, delete_semi, insert_ignore_parts, union_by_name)}

_TOTALS = """WITH o AS (SELECT o_custkey, count(*) AS orders, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders GROUP BY 1),
t AS (SELECT c_custkey, c_name AS name, c_mktsegment, orders, total FROM customer JOIN o ON c_custkey = o_custkey) """
_VISIBLE = "lower(name) NOT IN ('customer#000000007', 'customer#000000011')"
_POSITION = "SELECT name, orders, total, row_number() OVER (ORDER BY orders DESC, total, c_custkey) AS position FROM t"
ORACLE = {
    "leaderboard_rank": _TOTALS + f"SELECT name, orders, total, rank() OVER (ORDER BY orders DESC, total) AS rank FROM t WHERE {_VISIBLE} ORDER BY rank, name LIMIT 50",
    "leaderboard_by_segment": _TOTALS + "SELECT c_mktsegment, name, orders, total, rank() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC, total) AS rank FROM t",
    "leaderboard_position": _TOTALS + _POSITION,
    "leaderboard_page": _TOTALS + f"SELECT * FROM ({_POSITION}) WHERE position BETWEEN 10 AND 30",
    "rank_by_count": _TOTALS + ", b AS (SELECT * FROM t WHERE c_mktsegment = 'BUILDING') SELECT name, (SELECT count(*) FROM b y WHERE y.orders > x.orders OR (y.orders = x.orders AND y.total < x.total)) + 1 AS rank FROM b x",
    "hidden_filter": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN ('customer#000000007', 'customer#000000011')",
    "playtime_cutoff": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(o_totalprice) FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS rn FROM orders) WHERE rn <= (SELECT ceil(count(*) * 0.15) FROM orders))",
    "wealth_excluding_slot": "SELECT l_orderkey, CAST(coalesce(sum(floor(l_extendedprice) * floor(l_quantity)) FILTER (l_linenumber <> 3), 0) AS BIGINT) AS wealth FROM lineitem GROUP BY 1",
    "wealth_items_list": "WITH i AS (SELECT l_suppkey, l_partkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT l_suppkey, CAST(sum(v) AS BIGINT) AS wealth, string_agg(l_partkey || ':' || v, ',' ORDER BY v DESC, l_partkey) AS items FROM i GROUP BY 1",
    "two_hop": "SELECT a.n_name AS buyer, b.n_name AS seller, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2",
    "left_join_extra_on": "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1",
    "unread_threads": "WITH l AS (SELECT user_id, event_type, max(ts) AS last_at FROM events WHERE event_type <> 'view' GROUP BY 1, 2), s AS (SELECT user_id, max(ts) AS read_at FROM events WHERE event_type = 'view' GROUP BY 1) SELECT l.user_id, count(*) AS unread FROM l LEFT JOIN s ON l.user_id = s.user_id WHERE read_at IS NULL OR read_at < last_at GROUP BY 1",
    "refine_semi": "SELECT l_orderkey, l_partkey AS p_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')",
    "resume_skip": "WITH k AS (SELECT pageid, lower(trim(replace(title, '_', ' '))) AS t FROM structured_records) SELECT raw_id FROM raw_pages r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.pageid = r.pageid) AND NOT EXISTS (SELECT 1 FROM k WHERE k.t = lower(trim(replace(r.title, '_', ' '))))",
    "rate_limited": "SELECT e.event_id, e.user_id, count(*) AS recent FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 12 HOUR GROUP BY 1, 2 HAVING count(*) >= 3",
    "upsert_customers": """WITH s AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS balance, c_mktsegment FROM customer),
i AS (SELECT c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN balance + 5 ELSE balance END AS balance, lower(c_mktsegment) AS c_mktsegment FROM s WHERE c_custkey % 2 = 1)
SELECT coalesce(s.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN a = 'kept' THEN s.balance ELSE i.balance END AS balance, CASE WHEN a = 'kept' THEN s.c_mktsegment ELSE i.c_mktsegment END AS c_mktsegment, a AS action
FROM s FULL JOIN i ON s.c_custkey = i.c_custkey, LATERAL (SELECT CASE WHEN s.c_custkey IS NULL THEN 'inserted' WHEN i.c_custkey IS NOT NULL AND i.balance IS DISTINCT FROM s.balance THEN 'updated' ELSE 'kept' END AS a) x""",
    "delete_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "insert_ignore_parts": "SELECT DISTINCT p_brand AS brand, p_type AS kind FROM part",
    "union_by_name": "SELECT c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer UNION ALL SELECT s_name, CAST(floor(s_acctbal) AS BIGINT), NULL, s_nationkey FROM supplier",
}
