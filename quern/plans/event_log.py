"""Event log queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import events as E
from quern.runtime import table

HALF = "2024-01-16 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def step_delta(spark: SparkSession, sf: str) -> DataFrame:
    made = E.step_delta(_events(spark, sf), "user_id", ["ts", "event_id"], "value")
    return made.select("event_id", F.round("delta", 4).alias("delta"), F.round("from_start", 4).alias("from_start"))


def changed_only(spark: SparkSession, sf: str) -> DataFrame:
    return E.changed_only(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


def state_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user and type in the second half of the month against the first."""
    ev = _events(spark, sf)
    half = F.to_timestamp_ntz(F.lit(HALF))
    counted = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.state_delta(counted(ev.where(F.col("ts") < half)), counted(ev.where(F.col("ts") >= half)), ["user_id", "event_type"], "n")


def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per event type: a value over 100 is a success; the number in props counts as 0 where it is odd or missing."""
    k = F.get_json_object("props", "$.k").cast("double")
    runs = _events(spark, sf).withColumn("k", F.when(k % 2 == 0, k))
    made = E.metrics(runs, ["event_type"], F.col("value") > 100, ["value", "k"])
    return made.select("event_type", "runs", "successes", "failures", *[F.round(c, 6).alias(c) for c in ("rate", "avg_value", "avg_k")])


def verifier_all(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: bought something, never more than 40 errors, gained over the month, last seen after the 20th."""
    ev = _events(spark, sf)
    at = F.struct("ts", "event_id")
    state = ev.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.max_by("value", at) - F.min_by("value", at)).alias("gain"), F.max("ts").alias("last"))
    checks = {"inventory_contains": F.col("bought") >= 1, "inventory_lacks": F.col("errors") <= 12, "xp_gained": F.col("gain") > 0, "level_at_least": F.col("last") >= F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))}
    made = E.verify(state, checks)
    return made.select("user_id", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"), "success")


def comparator(spark: SparkSession, sf: str) -> DataFrame:
    """Events that pass a comparison given by their type."""
    condition = F.create_map(*[F.lit(x) for x in ("click", ">", "view", "<", "purchase", "=", "signup", "!")])[F.col("event_type")]
    rows = _events(spark, sf).where(E.compare_as(condition, F.floor("value"), F.lit(250)))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def kb_observe(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf).withColumn("tick", F.floor("value"))
    made = E.observe(ev, ["user_id"], "tick", "event_id", "event_type")
    return made.select("user_id", "seen", "last_tick", F.array_join("options", ",").alias("options"))


def kb_merge(spark: SparkSession, sf: str) -> DataFrame:
    ev = _events(spark, sf).withColumn("tick", F.floor("value"))
    half = F.to_timestamp_ntz(F.lit(HALF))
    part = lambda cond: E.observe(ev.where(cond), ["user_id"], "tick", "event_id", "event_type")
    made = E.merge_knowledge(part(F.col("ts") < half), part(F.col("ts") >= half), ["user_id"])
    return made.select("user_id", "seen", "last_tick", F.array_join("options", ",").alias("options"))


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return E.latest(_events(spark, sf), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


def sliding_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return E.sliding_buffer(_events(spark, sf), "user_id", "ts", "event_id", 5 * 86_400, 10).select("user_id", "event_id")


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.histogram(_events(spark, sf), "value", [5, 25, 50, 100, 250, 400])


def milestones(spark: SparkSession, sf: str) -> DataFrame:
    """Events at which a user's largest value so far passes a multiple of 100."""
    from pyspark.sql import Window

    ev = _events(spark, sf).withColumn("best", F.floor(F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))))
    return E.milestones(ev, "user_id", ["ts", "event_id"], "best", 100, [77]).select("event_id", "user_id", "best")


def replay(spark: SparkSession, sf: str) -> DataFrame:
    made = E.replay(_events(spark, sf), "user_id", ["ts", "event_id"], "value", F.col("last") > F.col("first"))
    return made.select("user_id", "steps", "verdict")


def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The last three events of each user as text, newest last."""
    rows = E.sliding_buffer(_events(spark, sf), "user_id", "ts", "event_id", 365 * 86_400, 3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ">")
    return rows.groupBy("user_id").agg(text.alias("messages"))


def hero_points(spark: SparkSession, sf: str) -> DataFrame:
    """For each event type the user with the most points, values below 1 not counted; ties go to the smaller id."""
    points = _events(spark, sf).where(F.col("value") >= 1).groupBy("event_type", "user_id").agg(F.sum(F.floor("value")).alias("points"))
    return points.groupBy("event_type").agg(F.max_by("user_id", F.struct("points", -F.col("user_id"))).alias("user_id"), F.max("points").alias("points"))


QUERIES = {f.__name__: f for f in (step_delta, changed_only, state_delta, batch_metrics, verifier_all, comparator, kb_observe, kb_merge, latest_per_key, sliding_buffer, histogram, milestones, replay, last_messages, hero_points)}

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_KB = "SELECT user_id, count(*) AS seen, CAST({} AS BIGINT) AS last_tick, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS options FROM {} GROUP BY 1"
ORACLE = {
    "step_delta": f"SELECT event_id, round(value - lag(value) OVER {_W}, 4) AS delta, round(value - first_value(value) OVER {_W}, 4) AS from_start FROM events",
    "changed_only": f"SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER {_W} AS b FROM events) WHERE event_type IS DISTINCT FROM b",
    "state_delta": f"SELECT user_id, event_type, count(*) FILTER (ts >= TIMESTAMP '{HALF}') - count(*) FILTER (ts < TIMESTAMP '{HALF}') AS change FROM events GROUP BY 1, 2",
    "batch_metrics": "SELECT event_type, count(*) AS runs, count(*) FILTER (value > 100) AS successes, count(*) FILTER (value <= 100) AS failures, round(count(*) FILTER (value > 100) / count(*), 6) AS rate, round(avg(value), 6) AS avg_value, round(avg(CASE WHEN k % 2 = 0 THEN k ELSE 0 END), 6) AS avg_k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1",
    "verifier_all": """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') >= 1 AS a, count(*) FILTER (event_type = 'error') <= 12 AS b, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) > 0 AS c, max(ts) >= TIMESTAMP '2024-01-30' AS d FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN a THEN 'inventory_contains' END, CASE WHEN b THEN 'inventory_lacks' END, CASE WHEN c THEN 'xp_gained' END, CASE WHEN d THEN 'level_at_least' END], lambda x: x IS NOT NULL), ',') AS passed,
array_to_string(list_filter([CASE WHEN NOT a THEN 'inventory_contains' END, CASE WHEN NOT b THEN 'inventory_lacks' END, CASE WHEN NOT c THEN 'xp_gained' END, CASE WHEN NOT d THEN 'level_at_least' END], lambda x: x IS NOT NULL), ',') AS failed, a AND b AND c AND d AS success FROM s""",
    "comparator": "SELECT event_type, count(*) AS n FROM events WHERE (event_type = 'click' AND floor(value) > 250) OR (event_type = 'view' AND floor(value) < 250) OR (event_type = 'purchase' AND floor(value) = 250) OR (event_type = 'signup' AND floor(value) <> 250) GROUP BY 1",
    "kb_observe": _KB.format("arg_max(floor(value), event_id)", "events"),
    "kb_merge": f"WITH p AS (SELECT user_id, ts < TIMESTAMP '{HALF}' AS h, arg_max(floor(value), event_id) AS t FROM events GROUP BY 1, 2), m AS (SELECT user_id, CAST(max(t) AS BIGINT) AS last_tick FROM p GROUP BY 1) SELECT e.user_id, count(*) AS seen, any_value(last_tick) AS last_tick, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS options FROM events e JOIN m ON e.user_id = m.user_id GROUP BY 1",
    "latest_per_key": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "sliding_buffer": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE rn <= 10 AND ts > last - INTERVAL 5 DAY",
    "histogram": "WITH b AS (SELECT unnest([5, 25, 50, 100, 250, 400, 1e300]) AS hi, unnest([-1e300, 5, 25, 50, 100, 250, 400]) AS lo, unnest(['5', '25', '50', '100', '250', '400', '+Inf']) AS bound) SELECT bound, count(value) AS n FROM b LEFT JOIN events ON value <= hi AND value > lo GROUP BY 1",
    "milestones": f"WITH b AS (SELECT *, CAST(floor(max(value) OVER {_W}) AS BIGINT) AS best FROM events), l AS (SELECT *, coalesce(lag(best) OVER {_W}, 0) AS was FROM b) SELECT event_id, user_id, best FROM l WHERE best // 100 > was // 100 OR (best = 77 AND was <> 77)",
    "replay": "SELECT user_id, count(*) AS steps, arg_max(value, (ts, event_id)) > arg_min(value, (ts, event_id)) AS verdict FROM events GROUP BY 1",
    "last_messages": "SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY 1",
    "hero_points": "WITH p AS (SELECT event_type, user_id, CAST(sum(floor(value)) AS BIGINT) AS points FROM events WHERE value >= 1 GROUP BY 1, 2) SELECT event_type, arg_max(user_id, (points, -user_id)) AS user_id, max(points) AS points FROM p GROUP BY 1",
}
