"""Shaping of records: types, aliases, actions, bonuses, links; predicates given as data; contexts from search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import dates as D
from quern.functions import text as X
from quern.operators import nested as N
from quern.operators.temporal import available_at
from quern.plans import graphs, searching
from quern.plans.ranks import page_ranks
from quern.runtime import cut, table

CUTOFF = "2012-06-15"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "structured_records")


def record_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types by the rules over categories and templates, and the first of them by priority."""
    types = X.matched_types(F.col("taxonomy.categories"), F.col("taxonomy.templates"))
    return _records(spark, sf).withColumn("_types", types).select("record_id", F.array_join("_types", ",").alias("types"), X.primary_type(F.col("_types")).alias("primary"))


def record_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Other names of pages: aliases, taken apart at commas, and the label, without the title."""
    made = X.aliases(F.col("title"), F.col("aliases"), F.array("label"))
    return table(spark, sf, "page_nodes").select("node_key", F.array_join(made, "|").alias("aliases"))


def record_actions(spark: SparkSession, sf: str) -> DataFrame:
    """How often each action is named, once per record, however the list is written."""
    listed = X.listed(F.get_json_object("facts", "$.actions"))
    split = X.unique_strings(F.flatten(F.transform(F.filter(listed, lambda x: x.isNotNull()), lambda x: F.split(x, r"\s*,\s*"))))
    return _records(spark, sf).select(F.explode(split).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("records"))


def _fields():
    """facts.fields as a map of arrays, however the values are written."""
    return F.transform_values(F.from_json(F.get_json_object("facts", "$.fields"), "map<string,string>"), lambda k, v: X.listed(v))


def _lived(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).withColumn("life", D.lifecycle(_fields(), F.col("taxonomy.categories")))


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """When the content of each record came and went, by its fields or else its categories."""
    part = lambda of: [F.col(f"life.{of}.{x}").alias(f"{of}_{x}") for x in ("value", "precision", "source")]
    return _lived(spark, sf).select("record_id", *part("added"), *part("removed"), F.array_join("life.content_years", ",").alias("content_years"))


def record_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Which records were there at a cutoff; without a date of addition the earliest content year counts."""
    year = F.array_min("life.content_years").cast("string")
    judged = available_at(_lived(spark, sf), [F.col("life.added.value"), year], F.col("life.removed.value"), CUTOFF)
    return judged.select("record_id", "reason", "kept")


def equipment_bonuses(spark: SparkSession, sf: str) -> DataFrame:
    """Bonuses of equipment that read as numbers, one row each."""
    fields = F.from_json(F.get_json_object("facts", "$.equipment.bonuses"), "map<string,string>")
    wanted = ["astab", "aslash", "acrush", "amagic", "arange", "dstab", "dslash", "dcrush", "dmagic", "drange", "str", "rstr", "mdmg", "prayer"]
    return _records(spark, sf).select("record_id", F.explode(X.numbers_of(fields, wanted)).alias("bonus", "value"))


def record_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """The flat head of each record in the current version: names, types, dates, three-valued marks and sizes of its parts."""
    fields = _fields()
    mark = lambda name: X.tri_state(F.try_element_at(F.try_element_at(fields, F.lit(name)), F.lit(1))).alias(name)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    kept = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    types = X.matched_types(F.col("taxonomy.categories"), F.col("taxonomy.templates"))
    return _lived(spark, sf).select(
        "record_id", "pageid", "title", X.normal_name(F.col("title")).alias("normalized_title"), X.page_id(F.col("title")).alias("node"), F.array_join(types, ",").alias("types"), X.primary_type(types).alias("primary_type"),
        mark("members"), mark("tradeable"), mark("equipable"), F.col("life.added.value").alias("date_added"), F.col("life.removed.value").alias("date_removed"),
        size(kept("taxonomy.categories")).alias("categories"), size(kept("taxonomy.templates")).alias("templates"), F.coalesce(F.size(fields), F.lit(0)).alias("fields"),
        size(kept(X.listed(F.get_json_object("facts", "$.actions")))).alias("actions"), F.get_json_object("facts", "$.equipment.slot").alias("slot"), (F.col("schema_version") == "wiki-structured-v4").alias("current"),
    )


def infobox_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of records by field, target and label, each once per source."""
    edges = table(spark, sf, "graph_edges").where(F.col("relation") == "infobox_link")
    once = edges.select("source", "field", "target", "label").dropDuplicates(["source", "field", "target", "label"])
    return once.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def fact_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with alternatives: written with a bar between them, one row per alternative."""
    text = F.concat_ws(" | ", "primary_type", F.element_at(F.concat("types", F.array(F.lit("none"))), 1), F.lit(" "))
    rows = table(spark, sf, "page_nodes").where(F.col("types").isNotNull() & F.col("primary_type").isNotNull())
    return rows.select("node_key", F.explode(F.array_distinct(N.alternatives(text))).alias("fact"))


def all_of_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that meet every check of a list of (attribute number, comparison, value); number -1 always passes."""
    checks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(v).alias("v")) for i, c, v in ((0, ">", 10), (-1, "=", 0), (1, "!", 7), (0, "<", 40))])
    values = F.array(F.col("p_size"), (F.col("p_partkey") % 10).cast("int"))
    ok = F.forall(checks, lambda k: (k["i"] == -1) | F.coalesce(F.when(k["c"] == ">", values[F.greatest(k["i"], F.lit(0))] > k["v"]).when(k["c"] == "<", values[F.greatest(k["i"], F.lit(0))] < k["v"]).when(k["c"] == "!", values[F.greatest(k["i"], F.lit(0))] != k["v"]), F.lit(False)))
    return table(spark, sf, "part").where(ok).select("p_partkey")


def hunt_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers that find customers of their nation: not poor, not of a hidden segment, with enough orders."""
    busy = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 8)
    c = table(spark, sf, "customer").where((F.col("c_acctbal") > 1000) & (F.col("c_mktsegment") != "MACHINERY")).join(busy, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    found = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "supplier").join(found, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


def visible_users(spark: SparkSession, sf: str) -> DataFrame:
    """Whom each user sees among the users who had the same type of event last: all but those on its ignore list."""
    ev = table(spark, sf, "events")
    last = ev.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    ignored = ev.where(F.col("event_type") == "error").select("user_id", ((F.col("event_id") * 31) % 150).alias("other")).distinct()
    seen = last.groupBy("kind").agg(F.count(F.lit(1)).alias("all"))
    hidden = ignored.join(last.select(F.col("user_id").alias("other"), F.col("kind").alias("other_kind")), "other").join(last, "user_id").where((F.col("kind") == F.col("other_kind")) & (F.col("other") != F.col("user_id")))
    dropped = hidden.groupBy("user_id").agg(F.count(F.lit(1)).alias("hidden"))
    return last.join(seen, "kind").join(dropped, "user_id", "left").select("user_id", (F.col("all") - 1 - F.coalesce("hidden", F.lit(0))).alias("visible"))


def snapshot_text(spark: SparkSession, sf: str) -> DataFrame:
    """A line of text for each user's state."""
    at = F.struct("ts", "event_id")
    state = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", at).alias("kind"), F.floor(F.max("value")).alias("best"))
    return state.select("user_id", F.format_string("user %d: %d events, last %s, best %d", "user_id", "n", "kind", "best").alias("line"))


def two_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Two totals per user over the enabled types, and only the users at or above a threshold."""
    ev = table(spark, sf, "events").where(F.col("event_type") != "error")
    made = ev.groupBy("user_id").agg(F.sum(F.floor("value")).alias("xp"), F.sum(F.floor(F.col("value") / 50)).alias("levels"))
    return made.where(F.col("levels") >= 30)


def search_context(spark: SparkSession, sf: str, k: int = 6, most: int = 14) -> DataFrame:
    """What is given to read for each question: its pages and their neighbours, in order.

    A question whose best page was found by name or phrase is focused: only that page is read, and the way goes on
    from it alone; else all k pages are read and the way goes on from the first four. Of the neighbours over the best
    edges of these the ``most`` with the highest rank are read, each once and none that was a start.

    The names of all edges are brought to normal form once, and the pages are ranked once, for the search and for the
    edges. Only edges of the starts, at most four a question, are merged and put in order.
    """
    edges = cut(graphs.edges_of(spark, sf), "edges")
    ranks = page_ranks(spark, sf, edges)
    hits = cut(searching.found(spark, sf, k, ranks), "hits")
    focus = hits.where("rn = 1").select("query", F.col("strong").alias("focused"))
    kept = hits.join(F.broadcast(focus), "query").where(~F.col("focused") | (F.col("rn") == 1))
    seeds = kept.where(F.col("rn") <= 4).select("query", F.col("node").alias("source"))
    best = graphs.best_edges(spark, sf, most, ranks, edges.join(F.broadcast(seeds.select("source").distinct()), "source", "left_semi")).select("source", "target")
    near = seeds.join(best, "source").join(ranks.select(F.col("id").alias("target"), "rank"), "target").select("query", F.col("target").alias("node"), "rank").distinct()
    fresh = near.join(seeds.withColumnRenamed("source", "node"), ["query", "node"], "left_anti")
    by_rank = Window.partitionBy("query").orderBy(F.desc(F.round("rank", 12)), "node")
    around = fresh.withColumn("rn", F.row_number().over(by_rank)).where(F.col("rn") <= most)
    pages = kept.select("query", F.lit("match").alias("part"), "rn", "node", "score", "focused")
    return pages.unionByName(around.join(F.broadcast(focus), "query").select("query", F.lit("neighbour").alias("part"), "rn", "node", F.lit(None).cast("double").alias("score"), "focused"))


QUERIES = {f.__name__: f for f in (record_types, record_aliases, record_actions, lifecycle, record_availability, equipment_bonuses, record_assembly, infobox_links, fact_alternatives, all_of_predicates, hunt_pipeline, visible_users, snapshot_text, two_sums, search_context)}

_N = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))".format
_KEY = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(regexp_replace(replace(x, '_', ' '), '[\\s\\p{{Z}}]+', ' ', 'g')))), lambda x: x IS NOT NULL)"
_LIT = lambda p: p.replace("'", "''")
_HAS = lambda c, p: f"len(list_filter({c}, lambda x: regexp_matches(x, '{_LIT(p)}'))) > 0"
_MATCH = ", ".join(f"CASE WHEN {_HAS('cs', c)}{' OR ' + _HAS('ts', t) if t else ''} THEN '{k}' END" for k, t, c in X.TYPE_RULES)
_TYPES = f"keys AS (SELECT record_id, {_KEY('taxonomy.categories')} AS cs, {_KEY('taxonomy.templates')} AS ts FROM structured_records), typed AS (SELECT record_id, list_filter([{_MATCH}], lambda k: k IS NOT NULL) AS types FROM keys)"
_PRIMARY = f"coalesce(list_filter({list(X.TYPE_PRIORITY)}, lambda p: list_contains(types, p))[1], 'article')"
_LIST = lambda j: f"(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS VARCHAR[]) WHEN 'OBJECT' THEN list_transform(json_keys({j}), lambda k: json_extract_string({j}, '$.\"' || k || '\"')) WHEN 'VARCHAR' THEN CASE WHEN json_extract_string({j}, '$') LIKE '[%' THEN CAST(CAST(json_extract_string({j}, '$') AS JSON) AS VARCHAR[]) ELSE [json_extract_string({j}, '$')] END END)"
_M = "|".join(D.MONTHS)
_MON = lambda i, p: f"lpad(CAST(list_position({list(D.MONTHS)}, lower(regexp_extract(raw, '{p}', {i}))) AS VARCHAR), 2, '0')"
_DAYS, _MONS, _YEAR = rf"(?i)\b(\d{{1,2}})\s+({_M})\s+(\d{{4}})\b", rf"(?i)\b({_M})\s+(\d{{4}})\b", r"\b((?:19|20)\d{2})\b"
_SIDE = lambda name, fields, pattern: f"""{name}_f AS (SELECT record_id, value, precision, 'infobox:' || k AS source FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY value, n) AS rn FROM dated WHERE k IN ({', '.join(f"'{x}'" for x in fields)})) WHERE rn = 1),
{name}_c AS (SELECT record_id, regexp_extract(list_filter(taxonomy.categories, lambda c: regexp_matches(c, '{pattern}'))[1], '{pattern}', 1) AS value FROM structured_records),
{name} AS (SELECT record_id, coalesce(f.value, nullif(c.value, '')) AS value, CASE WHEN f.value IS NOT NULL THEN f.precision WHEN c.value <> '' THEN 'year' END AS precision, CASE WHEN f.value IS NOT NULL THEN f.source WHEN c.value <> '' THEN 'category' END AS source FROM {name}_c c LEFT JOIN {name}_f f USING (record_id))"""  # noqa: E731
_LIFE = f"""entries AS (SELECT record_id, k, json_extract(facts, '$.fields.\"' || k || '\"') AS j FROM (SELECT record_id, facts, unnest(json_keys(facts, '$.fields')) AS k FROM structured_records)),
texts AS (SELECT record_id, k, unnest({_LIST('j')}) AS t, generate_subscripts({_LIST('j')}, 1) AS n FROM entries), raws AS (SELECT record_id, k, n, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS raw FROM texts),
dated AS (SELECT record_id, k, n, CASE WHEN regexp_matches(raw, '{_DAYS}') THEN regexp_extract(raw, '{_DAYS}', 3) || '-' || {_MON(2, _DAYS)} || '-' || lpad(regexp_extract(raw, '{_DAYS}', 1), 2, '0') WHEN regexp_matches(raw, '{_MONS}') THEN regexp_extract(raw, '{_MONS}', 2) || '-' || {_MON(1, _MONS)} WHEN regexp_matches(raw, '{_YEAR}') THEN regexp_extract(raw, '{_YEAR}', 1) ELSE raw END AS value,
  CASE WHEN regexp_matches(raw, '{_DAYS}') THEN 'day' WHEN regexp_matches(raw, '{_MONS}') THEN 'month' WHEN regexp_matches(raw, '{_YEAR}') THEN 'year' ELSE 'raw' END AS precision FROM raws WHERE raw <> '' AND lower(raw) <> 'unknown'),
{_SIDE('added', D.ADDED, D.CAME)}, {_SIDE('removed', D.REMOVED, D.WENT)},
years AS (SELECT record_id, list_sort(list_distinct(list_transform(list_filter(coalesce(taxonomy.categories, []), lambda c: regexp_matches(c, '{D.EITHER}')), lambda c: CAST(regexp_extract(c, '{D.EITHER}', 1) AS INTEGER)))) AS ys FROM structured_records)"""
_FILLED = lambda c: f"len(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL AND trim(x) <> ''))"
_PART = "json_extract(facts, '$.{}')".format
_FIRST = lambda k: f"lower({_LIST(_PART('fields.' + k))}[1])"
_TRI = lambda k: f"CASE WHEN {_FIRST(k)} IN ('yes', 'true', 'y') THEN true WHEN {_FIRST(k)} IN ('no', 'false', 'n') THEN false END AS {k}"
_NUM = lambda c: f"(TRY_CAST(nullif(regexp_extract({c}, '^((?:19|20)\\d{{2}})', 1), '') AS INTEGER) * 10000 + 1231)"
ORACLE = {
    "record_types": f"WITH {_TYPES} SELECT record_id, array_to_string(types, ',') AS types, {_PRIMARY} AS primary FROM typed",
    "record_aliases": "WITH x AS (SELECT node_key, title, list_concat(flatten(list_transform(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL), lambda a: string_split_regex(a, ',\\s*'))), [label]) AS aa FROM page_nodes), y AS (SELECT node_key, list_filter(list_transform(list_filter(aa, lambda a: lower(trim(replace(a, '_', ' '))) <> lower(trim(replace(coalesce(title, ''), '_', ' ')))), lambda a: trim(regexp_replace(replace(a, '_', ' '), '[\\s\\p{Z}]+', ' ', 'g'))), lambda a: a <> '') AS aa FROM x) SELECT node_key, array_to_string(list_filter(aa, lambda a, i: list_position(aa, a) = i), '|') AS aliases FROM y",
    "record_actions": f"SELECT action, count(DISTINCT record_id) AS records FROM (SELECT record_id, trim(regexp_replace(replace(unnest(string_split_regex(a, '\\s*,\\s*')), '_', ' '), '\\s+', ' ', 'g')) AS action FROM (SELECT record_id, unnest({_LIST('j')}) AS a FROM (SELECT record_id, json_extract(facts, '$.actions') AS j FROM structured_records))) WHERE action <> '' GROUP BY 1",
    "lifecycle": f"WITH {_LIFE} SELECT record_id, a.value AS added_value, a.precision AS added_precision, a.source AS added_source, r.value AS removed_value, r.precision AS removed_precision, r.source AS removed_source, array_to_string(ys, ',') AS content_years FROM added a JOIN removed r USING (record_id) JOIN years USING (record_id)",
    "record_availability": f"WITH {_LIFE}, x AS (SELECT record_id, coalesce({_NUM('a.value')}, ys[1] * 10000 + 1231) AS came, {_NUM('r.value')} AS went FROM added a JOIN removed r USING (record_id) JOIN years USING (record_id)), y AS (SELECT record_id, CASE WHEN came IS NULL THEN 'unknown_added_date' WHEN came > 20120615 THEN 'added_after_cutoff' WHEN went <= 20120615 THEN 'removed_on_or_before_cutoff' ELSE 'available_at_cutoff' END AS reason FROM x) SELECT record_id, reason, reason = 'available_at_cutoff' AS kept FROM y",
    "equipment_bonuses": "SELECT record_id, k AS bonus, TRY_CAST(json_extract_string(b, '$.' || k) AS DOUBLE) AS value FROM (SELECT record_id, b, unnest(json_keys(b)) AS k FROM (SELECT record_id, json_extract(facts, '$.equipment.bonuses') AS b FROM structured_records) WHERE json_type(b) = 'OBJECT') WHERE TRY_CAST(json_extract_string(b, '$.' || k) AS DOUBLE) IS NOT NULL",
    "record_assembly": f"WITH {_LIFE}, {_TYPES} SELECT record_id, pageid, title, {_N('title')} AS normalized_title, 'page:' || {_N('title')} AS node, array_to_string(types, ',') AS types, {_PRIMARY} AS primary_type, {_TRI('members')}, {_TRI('tradeable')}, {_TRI('equipable')}, a.value AS date_added, r.value AS date_removed, {_FILLED('taxonomy.categories')} AS categories, {_FILLED('taxonomy.templates')} AS templates, coalesce(len(json_keys(facts, '$.fields')), 0) AS fields, {_FILLED(_LIST(_PART('actions')))} AS actions, json_extract_string(facts, '$.equipment.slot') AS slot, schema_version = 'wiki-structured-v4' AS current FROM structured_records JOIN typed USING (record_id) JOIN added a USING (record_id) JOIN removed r USING (record_id)",
    "infobox_links": "SELECT field, count(*) AS n FROM (SELECT DISTINCT source, field, target, label FROM graph_edges WHERE relation = 'infobox_link') GROUP BY 1",
    "fact_alternatives": "SELECT DISTINCT node_key, fact FROM (SELECT node_key, unnest(list_transform([primary_type, coalesce(types[1], 'none')], lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))) AS fact FROM page_nodes WHERE types IS NOT NULL AND primary_type IS NOT NULL) WHERE fact <> ''",
    "all_of_predicates": "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 40 AND p_partkey % 10 <> 7",
    "hunt_pipeline": "SELECT s_suppkey, count(c_custkey) AS n FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY' AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8)) c ON s_nationkey = c_nationkey GROUP BY 1",
    "visible_users": "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1), i AS (SELECT DISTINCT user_id, event_id * 31 % 150 AS other FROM events WHERE event_type = 'error') SELECT a.user_id, count(b.user_id) AS visible FROM l a LEFT JOIN l b ON a.kind = b.kind AND a.user_id <> b.user_id AND NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = a.user_id AND i.other = b.user_id) GROUP BY 1",
    "snapshot_text": "SELECT user_id, 'user ' || user_id || ': ' || count(*) || ' events, last ' || arg_max(event_type, (ts, event_id)) || ', best ' || CAST(floor(max(value)) AS BIGINT) AS line FROM events GROUP BY 1",
    "two_sums": "SELECT user_id, CAST(sum(floor(value)) AS BIGINT) AS xp, CAST(sum(floor(value / 50)) AS BIGINT) AS levels FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING sum(floor(value / 50)) >= 30",
    "search_context": f"""WITH h AS (SELECT * FROM ({searching.FOUND(6)})), fo AS (SELECT query, strong AS focused FROM h WHERE rn = 1), k AS (SELECT h.*, focused FROM h JOIN fo USING (query) WHERE NOT focused OR rn = 1), sd AS (SELECT query, node AS source FROM k WHERE rn <= 4),
b AS (SELECT source, target, rank FROM ({graphs.BEST_SQL} SELECT source, target, rank FROM best WHERE rn <= 14) WHERE rank IS NOT NULL), n AS (SELECT DISTINCT query, target AS node, rank FROM sd JOIN b USING (source) WHERE NOT EXISTS (SELECT 1 FROM sd x WHERE x.query = sd.query AND x.source = target)),
a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rank, 12) DESC, node) AS rn FROM n)
SELECT query, 'match' AS part, rn, node, score, focused FROM k UNION ALL SELECT query, 'neighbour', rn, node, NULL, focused FROM a JOIN fo USING (query) WHERE rn <= 14""",
}
