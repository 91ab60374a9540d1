"""Problem 3: the nested parts of structured_records as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.shredding import REST, Group, assemble, shred
from quern.runtime import table

MAP_LEAVES = ("field", "x", "y", "plane", "radius", "name")
ITEM_LEAVES = ("item", "quantity", "cost")
GROUPS = (
    Group("ids", (("facts", ("ids",)),), ("field", "value", "raw")),
    Group("maps", (("facts", ("maps",)),), MAP_LEAVES),
    Group("variants", (("facts", ("variants",)), ("variants", ())), ("index", "label", "name", "release", "id", "examine", "quest"), (Group("maps", leaves=MAP_LEAVES, key="maps"),)),
    Group("recipes", (("facts", ("recipes",)),), ("ticks", "members"), (
        Group("skills", leaves=("name", "level", "xp", "boostable"), key="skills"),
        Group("materials", leaves=ITEM_LEAVES, key="materials"),
        Group("outputs", leaves=ITEM_LEAVES, key="outputs"),
    )),
    Group("categories", (("taxonomy", ("categories",)),), scalar=True),
    Group("hidden_categories", (("taxonomy", ("hidden_categories",)),), scalar=True),
)
CHILDREN = {
    "variant": "variants", "variant_map": "variants.maps", "recipe": "recipes", "recipe_skill": "recipes.skills",
    "recipe_material": "recipes.materials", "recipe_output": "recipes.outputs", "fact_id": "ids", "fact_map": "maps",
    "category": "categories", "hidden_category": "hidden_categories",
}


def _records(spark: SparkSession, sf: str) -> DataFrame:
    names = F.struct("taxonomy.categories", "taxonomy.hidden_categories").alias("taxonomy")
    return table(spark, sf, "structured_records").select("record_id", "facts", "variants", names)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every child row with its place; one leaf per repeated group is enough for that."""
    leaves = [f"{path}.{REST}" for path in CHILDREN.values()]
    return assemble(shred(_records(spark, sf), "record_id", GROUPS, leaves), CHILDREN)


#: The typed columns of each child table; lists and objects are JSON text.
COLUMNS = {
    "variant": {"index": "int", "label": "string", "name": "string", "release": "string", "id": "bigint", "examine": "string", "quest": "string"},
    "variant_map": {"field": "string", "x": "int", "y": "int", "plane": "int", "radius": "int", "name": "string"},
    "recipe": {"ticks": "int", "members": "boolean"},
    "recipe_skill": {"name": "string", "level": "double", "xp": "double", "boostable": "boolean"},
    "recipe_material": {"item": "string", "quantity": "double", "cost": "string"},
    "recipe_output": {"item": "string", "quantity": "double", "cost": "string"},
    "fact_id": {"field": "string", "value": "bigint", "raw": "string"},
    "fact_map": {"field": "string", "x": "int", "y": "int", "plane": "int", "radius": "int", "name": "string"},
}
NAMES = {"category": "categories", "hidden_category": "hidden_categories"}


def _flat(child: str):
    """The flat table of one child: its place, its typed columns, the names of its null keys, and all else as JSON."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        path, columns = CHILDREN[child], COLUMNS.get(child, {})
        leaves = [f"{path}.{x}" for x in (*columns, REST)]
        made = assemble(shred(_records(spark, sf), "record_id", GROUPS, leaves), {child: path}, {child: (*columns, REST)})
        if child in NAMES:
            return made.select("record_id", "child_ord", F.col("attributes")[REST].alias("name"))
        typed = [F.expr(f"try_cast(attributes['{k}'] AS {kind})").alias(k) for k, kind in columns.items()]
        nulls = F.array_join(F.array_remove("nulls", REST), ",")
        return made.select("record_id", "parent_ord", "child_ord", *typed, nulls.alias("nulls"), F.col("attributes")[REST].alias("rest"))

    return query


def _plural(child: str) -> str:
    return f"p3_{child[:-1]}ies" if child.endswith("y") else f"p3_{child}s"


def p3_levels(spark: SparkSession, sf: str) -> DataFrame:
    """How often each definition level occurs in each leaf path: the shape of the shredded columns."""
    shredded = shred(_records(spark, sf), "record_id", GROUPS)
    pairs = [F.struct(F.lit(c.replace("__", ".")).alias("path"), F.col(f"`{c}`.d").alias("d")) for c in shredded.columns[1:]]
    flat = shredded.select(F.explode(F.array(*pairs)).alias("x")).select("x.path", F.explode("x.d").alias("definition_level"))
    return flat.groupBy("path", F.col("definition_level").cast("int").alias("definition_level")).agg(F.count(F.lit(1)).alias("triples"))


QUERIES = {"p3_found": p3_found, **{_plural(child): _flat(child) for child in CHILDREN}, "p3_levels": p3_levels}


def _json(j: str) -> str:
    """SQL: a JSON value that may itself be written as a string."""
    return f"(CASE WHEN json_type({j}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({j}, '$') AS JSON) ELSE {j} END)"


def _entries(j: str) -> str:
    """SQL: the entries of a list however it is written."""
    return (
        f"(CASE json_type({j}) WHEN 'ARRAY' THEN json_extract({j}, '$[*]') WHEN 'OBJECT' THEN CASE WHEN len(json_keys({j})) = 0 THEN [] "
        f"WHEN len(list_filter(json_keys({j}), lambda k: NOT regexp_matches(k, '^[0-9]+$'))) = 0 THEN list_transform(json_keys({j}), lambda k: json_extract({j}, '$.\"' || k || '\"')) "
        f"ELSE [{j}] END ELSE [] END)"
    )


def _level(source: str, keep: str, j: str) -> str:
    """SQL: the entries of j, one row each, with the zero-based position ``ord``."""
    return f"SELECT {keep}, e, CAST(ord - 1 AS INTEGER) AS ord FROM (SELECT {keep}, unnest(es) AS e, generate_subscripts(es, 1) AS ord FROM (SELECT {keep}, {_entries('j')} AS es FROM (SELECT {keep}, {_json(j)} AS j FROM {source}) a) b) c"


_FULL = "json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0"
_SUB = "SELECT record_id, ord AS parent, e FROM {} WHERE " + _FULL


def _child(child: str, source: str, key: str) -> str:
    inner = _level(f"({_SUB.format(source)})", "record_id, parent", f"json_extract(e, '$.{key}')")
    return f"SELECT record_id, '{child}' AS child, parent AS parent_ord, ord AS child_ord FROM ({inner}) WHERE {_FULL}"


def _top(child: str, source: str) -> str:
    return f"SELECT record_id, '{child}' AS child, -1 AS parent_ord, ord AS child_ord FROM {source} WHERE {_FULL}"


def _names(child: str, column: str) -> str:
    return f"SELECT record_id, '{child}' AS child, -1 AS parent_ord, CAST(ord - 1 AS INTEGER) AS child_ord FROM (SELECT record_id, unnest(taxonomy.{column}) AS e, generate_subscripts(taxonomy.{column}, 1) AS ord FROM structured_records) WHERE trim(e) <> ''"


_CTES = f"""
WITH docs AS (SELECT record_id, CAST(facts AS JSON) AS f, CAST(variants AS JSON) AS v FROM structured_records),
variants AS ({_level('docs', 'record_id', "json_extract(f, '$.variants')")} UNION ALL {_level('docs', 'record_id', 'v')}),
recipes AS ({_level('docs', 'record_id', "json_extract(f, '$.recipes')")}),
ids AS ({_level('docs', 'record_id', "json_extract(f, '$.ids')")}),
maps AS ({_level('docs', 'record_id', "json_extract(f, '$.maps')")})
"""
ORACLE: dict[str, str] = {
    "p3_found": _CTES + " UNION ALL ".join([
        _top("variant", "variants"), _child("variant_map", "variants", "maps"), _top("recipe", "recipes"), _child("recipe_skill", "recipes", "skills"),
        _child("recipe_material", "recipes", "materials"), _child("recipe_output", "recipes", "outputs"), _top("fact_id", "ids"), _top("fact_map", "maps"),
        _names("category", "categories"), _names("hidden_category", "hidden_categories"),
    ]),
}


def _values(child: str) -> str:
    """SQL for the flat table of one child."""
    source, key = {"variant": ("variants", ""), "variant_map": ("variants", "maps"), "recipe": ("recipes", ""), "recipe_skill": ("recipes", "skills"), "recipe_material": ("recipes", "materials"), "recipe_output": ("recipes", "outputs"), "fact_id": ("ids", ""), "fact_map": ("maps", "")}[child]
    rows = _level(f"({_SUB.format(source)})", "record_id, parent", f"json_extract(e, '$.{key}')") if key else f"SELECT record_id, -1 AS parent, e, ord FROM {source}"
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    columns, group = COLUMNS[child], CHILDREN[child]
    typed = ", ".join(f"TRY_CAST(json_extract_string(e, '$.{k}') AS {kinds[t]}) AS \"{k}\"" for k, t in columns.items())
    lists = {"variants": ["maps"], "recipes": ["skills", "materials", "outputs"]}.get(group, [])
    nulls = f"array_to_string(list_filter({list(columns)}, lambda k: json_type(e, '$.' || k) = 'NULL'), ',')"
    kept = f"list_filter(json_keys(e), lambda k: NOT list_contains({[*columns, *lists]}, k))"
    rest = f"CASE WHEN len({kept}) > 0 THEN '{{' || array_to_string(list_transform({kept}, lambda k: to_json(k)::VARCHAR || ':' || CAST(json_extract(e, '$.\"' || k || '\"') AS VARCHAR)), ',') || '}}' END"
    return f"{_CTES} SELECT record_id, parent AS parent_ord, ord AS child_ord, {typed}, {nulls} AS nulls, {rest} AS rest FROM ({rows}) WHERE {_FULL}"


ORACLE |= {_plural(child): _values(child) for child in COLUMNS}
ORACLE |= {_plural(child): f"SELECT record_id, child_ord, name FROM (SELECT record_id, CAST(ord - 1 AS INTEGER) AS child_ord, e AS name FROM (SELECT record_id, unnest(taxonomy.{c}) AS e, generate_subscripts(taxonomy.{c}, 1) AS ord FROM structured_records)) WHERE trim(name) <> ''" for child, c in NAMES.items()}
