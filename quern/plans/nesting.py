"""Queries over markup, nested groups, sets of facts and inventory logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import markup as M
from quern.operators import inventory as I
from quern.operators import nested as N
from quern.runtime import table


def template_parse(spark: SparkSession, sf: str) -> DataFrame:
    found = M.explode_templates(table(spark, sf, "documents"), "doc_id", "text")
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("named")).alias("named"), F.sum(F.size("positional")).alias("positional"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    found = M.explode_sections(table(spark, sf, "documents"), "doc_id", "text")
    return found.where(F.col("level") > 1).groupBy("level", "heading").agg(F.count(F.lit(1)).alias("n"))


def plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return M.rendered(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.length("plain").alias("plain"), F.length("lead").alias("lead"))


def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "raw_pages").select("raw_id", F.transform("sections", lambda s: F.struct(s["level"].alias("level"), s["line"].alias("line"))).alias("s"))
    return N.heading_paths(pages.where(F.col("s").isNotNull()), "raw_id", "s")


def numbered_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as records with numbered parameters, turned into one row per variant."""
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in ("name1", "name2", "id2", "size10", "brand")]), F.array("p_name", "p_type", F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), "p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(M.numbered(F.map_filter(named, lambda k, v: v.isNotNull()))).alias("v"))
    return rows.select("p_partkey", F.col("v.index").alias("index"), F.try_element_at("v.fields", F.lit("name")).alias("name"), F.try_element_at("v.fields", F.lit("id")).alias("id"), F.try_element_at("v.fields", F.lit("size")).alias("size"))


def recipe_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots 1 to 10 of which 1 and 3 are filled for most parts; a gap is no end."""
    named = F.create_map(F.lit("mat1"), F.col("p_name"), F.lit("mat1quantity"), F.col("p_size").cast("string"), F.lit("mat3"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), F.lit("mat11"), F.col("p_brand"))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(M.slots(named, {"item": "mat{}", "quantity": "mat{}quantity"})).alias("s"))
    return rows.select("p_partkey", "s.slot", "s.item", "s.quantity")


def count_map(spark: SparkSession, sf: str) -> DataFrame:
    made = N.count_map(table(spark, sf, "events").withColumn("v", F.floor("value")), ["user_id"], "event_type", "v")
    return made.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def variant_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The first eighty events of each user by type, each type with the ids of its events."""
    made = N.variants(table(spark, sf, "events"), ["user_id"], ["event_type"], ["event_id"], "event_id", 80)
    flat = made.select("user_id", F.explode("variants").alias("v"))
    return flat.select("user_id", F.col("v.event_type").alias("event_type"), F.array_join(F.transform("v.instances", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


#: Kinds and arguments of predicates and effects that the parts are read as, by part number.
PREDICATES = ("has_item", "near_loc", "near_loc_option", "near_npc", "skill_at_least", "reachable", "unknown")
EFFECTS = ("item_added", "xp_gained", "near_loc", "reachable", "message_observed", "position_changed", "dialog_opened", "level_changed", "bank_changed", "unknown")


def state_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of states made of parts: an inventory, a place with options, a person, things on the ground, screens, a skill."""
    size, key = F.col("p_size"), F.col("p_partkey")
    made = N.state_facts(
        F.create_map(F.col("p_name"), size - 10, F.concat(F.lit("spare "), F.col("p_type")), F.lit(1)),
        F.array(F.struct(F.col("p_brand").alias("name"), F.when(size > 5, F.array("p_type", F.lit("Open Door"))).alias("options"))),
        F.when(size % 2 == 0, F.array("p_type")), F.array(F.struct(F.col("p_name").alias("name"), (size % 3).alias("count"))),
        F.create_map(F.lit("bank"), key % 2 == 0, F.lit("modal"), key % 5 == 0), F.array(F.struct(F.col("p_brand").alias("name"), size.alias("level"), (key % 2).alias("xp"))),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(made, "|").alias("facts"))


def _kinds(names: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))


def _args():
    either = F.concat_ws(" | ", "p_brand", F.lit("_"), "p_type")
    level = F.when(F.col("p_size") > 9, F.col("p_size").cast("string"))
    given = {"item": F.col("p_name"), "name": either, "loc": F.col("p_brand"), "option": either, "skill": F.col("p_type"), "level": level, "pattern": F.col("p_name")}
    return F.map_filter(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def predicate_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.predicate_facts(_kinds(PREDICATES), _args()), ",").alias("facts"))


def effect_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.effect_facts(_kinds(EFFECTS), _args()), ",").alias("facts"))


def map_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Map templates written around the names of parts: all fields, some, and one that is no number."""
    text = F.concat(F.lit("x {{Map|name=[["), F.col("p_name"), F.lit("]]|x="), F.col("p_partkey"), F.lit("|y="), F.col("p_size"), F.lit("|plane=1|r=5|mtype=pin}} and {{map|x=odd|"), F.col("p_brand"), F.lit("}} {{Other|x=1}}"))
    return M.explode_maps(table(spark, sf, "part").select("p_partkey", text.alias("t")), "p_partkey", "map", "t")


def action_preconditions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are of some kind and, if a monster, also tagged as one of two types."""
    groups = F.array(F.array(F.lit("item"), F.lit("monster"), F.lit("quest")), F.array(F.col("primary_type"), F.lit("equipment")))
    return table(spark, sf, "page_nodes").where(F.col("types").isNotNull() & F.col("primary_type").isNotNull()).where(N.may_act(F.col("types"), groups)).groupBy("primary_type").agg(F.count(F.lit(1)).alias("n"))


def symbolic_plan(spark: SparkSession, sf: str) -> DataFrame:
    """From nation to nation over regions: the shortest way by a domain of actions made from two tables."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.concat(F.lit("at:"), F.col("n_name"))
    hub = F.concat(F.lit("hub:"), F.col("r_name"))
    leave = home.select(F.concat(F.lit("leave "), F.col("n_name")).alias("name"), F.array(F.array(at)).alias("needs"), F.array(hub).alias("adds"), F.array(at).alias("removes"))
    enter = home.select(F.concat(F.lit("enter "), F.col("n_name")).alias("name"), F.array(F.array(hub)).alias("needs"), F.array(at).alias("adds"), F.array(hub).alias("removes"))
    fly = region.alias("a").select(F.col("r_name").alias("x"), ((F.col("r_regionkey") + 1) % 5).alias("k")).join(region, F.col("k") == F.col("r_regionkey"))
    fly = fly.select(F.concat(F.lit("fly "), F.col("x")).alias("name"), F.array(F.array(F.concat(F.lit("hub:"), F.col("x")))).alias("needs"), F.array(hub).alias("adds"), F.array(F.concat(F.lit("hub:"), F.col("x"))).alias("removes"))
    names = [r[0] for r in nation.orderBy("n_nationkey").select("n_name").collect()]
    found = N.plan([f"at:{names[0]}"], [f"at:{names[7]}"], leave.unionByName(enter).unionByName(fly), 8)
    return found.select("steps", F.array_join("actions", " > ").alias("actions"))


def word_mask(spark: SparkSession, sf: str) -> DataFrame:
    made = N.masked(table(spark, sf, "page_nodes").select("node_key", "label"), "label", ["hammer", "ring", "silver"], ["silver ring"])
    return made.select("node_key", "label")


def inventory_log(spark: SparkSession, sf: str) -> DataFrame:
    """Additions and removals of lines, in order, to inventories of three slots."""
    lines = table(spark, sf, "lineitem").withColumn("n", F.floor("l_quantity"))
    log = lines.select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 6).alias("item"), F.when(F.col("l_linenumber") % 3 == 0, -F.col("n")).otherwise(F.col("n")).alias("amount"), (F.col("l_linenumber") % 2 == 0).alias("all_or_nothing"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "n").alias("at"))
    return I.apply_log(log, "owner", "at", 3)


QUERIES = {f.__name__: f for f in (template_parse, sections, plain_text, heading_paths, numbered_variants, recipe_slots, count_map, variant_groups, state_facts, predicate_facts, effect_facts, map_templates, action_preconditions, symbolic_plan, word_mask, inventory_log)}
_F = r"regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')".format
_ANY = lambda prefix: f"'{prefix}:' || {_F('p_brand')} || ',{prefix}:' || {_F('p_type')}"
ORACLE = {
    "numbered_variants": "SELECT p_partkey, 1 AS index, p_name AS name, NULL AS id, NULL AS size FROM part UNION ALL SELECT p_partkey, 2, p_type, p_partkey::VARCHAR, NULL FROM part UNION ALL SELECT p_partkey, 10, NULL, NULL, p_size::VARCHAR FROM part WHERE p_size > 25",
    "recipe_slots": "SELECT p_partkey, 1 AS slot, p_name AS item, p_size::VARCHAR AS quantity FROM part UNION ALL SELECT p_partkey, 3, p_type, NULL FROM part WHERE p_size % 2 = 0",
    "count_map": "SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY 1, 2) GROUP BY 1",
    "variant_groups": "SELECT user_id, event_type, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 80 GROUP BY 1, 2",
    "state_facts": f"""WITH f AS (SELECT p_partkey, unnest([CASE WHEN p_size > 10 THEN 'has_item:' || {_F('p_name')} END, 'has_item:' || {_F("'spare ' || p_type")}, 'near_loc:' || {_F('p_brand')}, CASE WHEN p_size > 5 THEN 'near_loc_option:' || {_F('p_brand')} || ':' || {_F('p_type')} END, CASE WHEN p_size > 5 THEN 'near_loc_option:' || {_F('p_brand')} || ':open_door' END,
CASE WHEN p_size % 2 = 0 THEN 'near_npc:' || {_F('p_type')} END, CASE WHEN p_size % 3 > 0 THEN 'ground_item:' || {_F('p_name')} END, CASE WHEN p_partkey % 2 = 0 THEN 'ui:bank_open' END, CASE WHEN p_partkey % 5 = 0 THEN 'ui:modal_open' END, 'skill_at_least:' || {_F('p_brand')} || ':' || p_size, CASE WHEN p_partkey % 2 > 0 THEN 'has_xp:' || {_F('p_brand')} END]) AS f FROM part)
SELECT p_partkey, string_agg(DISTINCT f, '|' ORDER BY f) AS facts FROM f WHERE f IS NOT NULL GROUP BY 1""",
    "predicate_facts": f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'has_item:' || {_F('p_name')} WHEN 1 THEN {_ANY('near_loc')} WHEN 2 THEN 'near_loc_option:' || {_F('p_brand')} || ':' || {_F('p_brand')} || ',near_loc_option:' || {_F('p_brand')} || ':' || {_F('p_type')}
WHEN 3 THEN {_ANY('near_npc')} WHEN 4 THEN 'skill_at_least:' || {_F('p_type')} || ':' || CASE WHEN p_size > 9 THEN p_size ELSE 1 END WHEN 5 THEN {_ANY('reachable')} ELSE '' END AS facts FROM part""",
    "effect_facts": f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'has_item:' || {_F('p_name')} || ',item_gained:' || {_F('p_name')} WHEN 1 THEN 'xp_gained:' || {_F('p_type')} WHEN 2 THEN {_ANY('near_loc')} WHEN 3 THEN {_ANY('reachable')} WHEN 4 THEN 'message_observed:' || {_F('p_name')}
WHEN 5 THEN 'position_changed:' || {_F("p_brand || ' | _ | ' || p_type")} WHEN 6 THEN 'dialog_opened' WHEN 7 THEN 'level_changed:' || {_F('p_type')} WHEN 8 THEN 'bank_changed' ELSE '' END AS facts FROM part""",
    "map_templates": "SELECT p_partkey, 0 AS at, 'map' AS field, p_partkey::DOUBLE AS x, p_size::DOUBLE AS y, 1.0::DOUBLE AS plane, 5.0::DOUBLE AS radius, 'pin' AS type, p_name AS name FROM part UNION ALL SELECT p_partkey, 1, 'map', NULL, NULL, NULL, NULL, NULL, '' FROM part",
    "action_preconditions": "SELECT primary_type, count(*) AS n FROM page_nodes WHERE types IS NOT NULL AND primary_type IS NOT NULL AND list_has_any(types, ['item', 'monster', 'quest']) AND list_has_any(types, [primary_type, 'equipment']) GROUP BY 1",
    "word_mask": "SELECT node_key, regexp_replace(regexp_replace(regexp_replace(label, '\\bhammer\\b', '******', 'gi'), '\\bring\\b', '****', 'gi'), '\\bsilver\\b', '******', 'gi') AS label FROM page_nodes WHERE NOT contains(lower(label), 'silver ring') UNION ALL SELECT node_key, regexp_replace(label, '\\bhammer\\b', '******', 'gi') FROM page_nodes WHERE contains(lower(label), 'silver ring')",
}
