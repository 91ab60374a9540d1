"""Text functions and keyword search over page_nodes, structured_records, raw_pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import search as S
from quern.operators.shredding import Group, assemble, shred
from quern.plans.ranks import PAGE_RANKS, page_ranks
from quern.runtime import cut, table

#: Recipes with only what a search looks at.
RECIPES = (Group("recipes", (("facts", ("recipes",)),), ("tools", "facilities"), (
    Group("skills", leaves=("name",), key="skills"), Group("materials", leaves=("item",), key="materials"), Group("outputs", leaves=("item",), key="outputs"),
)),)

ASKED = [("a", "the hammer of poxniknav"), ("b", "silver ring"), ("c", "burnt stew stew"), ("d", "no such thing"), ("e", "Anvil guard (2)"), ("f", ""), ("g", "where is cooking done with muddy fence"), ("h", "stew")]


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page: its first title and type, all its aliases and types, and the categories, fields and recipes of all
    records of its name."""
    nodes = table(spark, sf, "page_nodes").withColumn("node", X.normal_name(F.col("id")))
    pages = nodes.groupBy("node").agg(F.min_by("title", "node_key").alias("title"), F.min_by("primary_type", "node_key").alias("primary_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.min("node_key").alias("at"))
    records = table(spark, sf, "structured_records").where(F.col("title").isNotNull()).withColumn("node", X.page_id(F.col("title")))
    fields = F.flatten(F.map_values(F.transform_values(F.from_json(F.get_json_object("facts", "$.fields"), "map<string,string>"), lambda k, v: F.coalesce(X.listed(v), F.array().cast("array<string>")))))
    facts = records.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("taxonomy.categories")))).alias("categories"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(fields)))).alias("fields"))
    made = assemble_recipes(records).groupBy("node").agg(F.collect_list("parts").alias("recipes"))
    return pages.join(facts, "node", "left").join(made, "node", "left")


def assemble_recipes(records: DataFrame) -> DataFrame:
    """node, parts: the parts of each recipe of the records (node, record_id, facts), as array of struct<kind, name>."""
    leaves = ["recipes.tools", "recipes.facilities", "recipes.skills.name", "recipes.materials.item", "recipes.outputs.item"]
    shredded = shred(records.withColumn("key", F.concat_ws("\u0001", "node", "record_id")), "key", RECIPES, leaves)
    tables = {"recipe": "recipes", "skills": "recipes.skills", "materials": "recipes.materials", "outputs": "recipes.outputs"}
    flat = assemble(shredded, tables, {"recipe": ("tools", "facilities"), "skills": ("name",), "materials": ("item",), "outputs": ("item",)})
    none = F.array().cast("array<string>")
    plain = lambda kind: F.transform(F.coalesce(X.listed(F.col("attributes")[kind]), none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    own = F.array(F.struct(F.col("child").alias("kind"), F.coalesce(F.col("attributes")["name"], F.col("attributes")["item"], F.lit("")).alias("name")))
    parts = F.when(F.col("child") == "recipe", F.concat(plain("tools"), plain("facilities"))).otherwise(own)
    at = F.when(F.col("child") == "recipe", F.col("child_ord")).otherwise(F.col("parent_ord"))
    rows = flat.select("record_id", at.alias("at"), parts.alias("parts")).groupBy("record_id", "at").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return rows.select(F.substring_index("record_id", "\u0001", 1).alias("node"), "parts")


def _index(pages: DataFrame) -> DataFrame:
    """All parts that the tables have; none has leads."""
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    return S.postings(pages, "node", {"title": F.col("title"), "alias": text("aliases"), "primary_type": F.col("primary_type"), "types": text("types"), "category": text("categories"), "field": text("fields")})


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return _index(_pages(spark, sf))


def title_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every name that leads to a page, and the page."""
    return S.title_index(_pages(spark, sf))


def resolve_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that the requested titles of fetches lead to."""
    return S.resolve(table(spark, sf, "raw_pages").select("raw_id", "requested_title"), "requested_title", S.title_index(_pages(spark, sf))).select("raw_id", "node")


def found(spark: SparkSession, sf: str, k: int, ranks: DataFrame | None = None) -> DataFrame:
    """The k best pages of each question; pages, index and names are written once and read from there.

    ranks: those of ``page_ranks``, if they are there already.
    """
    ranks = page_ranks(spark, sf) if ranks is None else ranks
    pages = cut(_pages(spark, sf).join(ranks.select(F.col("id").alias("node"), "rank"), "node", "left"), "search-pages")
    queries = spark.createDataFrame(ASKED, "query string, text string")
    return S.search(queries, cut(_index(pages), "postings"), cut(S.title_index(pages), "names"), pages, k)


def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, 5)


def recipe_best(spark: SparkSession, sf: str) -> DataFrame:
    """The points of the best recipe of each page that has any for a question."""
    words, said = X.tokens(F.lit(ASKED[6][1])), X.phrase(F.lit(ASKED[6][1]))
    made = _pages(spark, sf).select("node", S.recipe_score(F.col("recipes"), words, said).alias("score"))
    return made.where(F.col("score") > 0)


def response_score(spark: SparkSession, sf: str) -> DataFrame:
    return S.response_score(table(spark, sf, "documents"), "text", ["level", "Tower", "hammer"], ["guide", "|-"]).select("doc_id", "hits", "bad", "score")


def title_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    return table(spark, sf, "raw_pages").select("raw_id", X.title_form(t).alias("title_form"), X.normal_name(t).alias("normal_name"), X.slug(t).alias("slug"), X.base_field(t).alias("base_field"))


def clip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 60).alias("clipped"))


def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(X.links(F.col("text"))).alias("at", "l"))
    return found.select("doc_id", "at", F.col("l.target").alias("target"), F.col("l.label").alias("label"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("tokens"))


def tri_state(spark: SparkSession, sf: str) -> DataFrame:
    """Members fields of the records: yes, no or neither."""
    text = F.get_json_object("facts", "$.fields.members[0]")
    return table(spark, sf, "structured_records").groupBy(X.tri_state(text).alias("members")).agg(F.count(F.lit(1)).alias("n"))


def unique_strings(spark: SparkSession, sf: str) -> DataFrame:
    names = X.unique_strings(F.col("taxonomy.categories"))
    return table(spark, sf, "structured_records").select("record_id", F.array_join(names, "|").alias("categories"), F.size(names).alias("n"))


def entity_decode(spark: SparkSession, sf: str) -> DataFrame:
    made = X.strip_comments(X.decode_entities(F.concat(F.lit("a&amp;lt;&nbsp;<!-- x\ny -->"), F.col("title"), F.lit("&#039;&gt;&#160;&apos;&quot;"))))
    return table(spark, sf, "raw_pages").where(F.col("title").isNotNull()).select("raw_id", made.alias("text"))


def article_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links to articles that are not marked as missing, per page; a missing mark passes."""
    kept = F.filter("links", lambda x: (x["ns"] == 0) & ~F.coalesce(~x["exists"], F.lit(False)))
    return table(spark, sf, "raw_pages").select("raw_id", F.coalesce(F.size(kept), F.lit(0)).alias("n"), F.array_join(F.transform(F.slice(kept, 1, 3), lambda x: x["title"]), "|").alias("first"))


def types_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The first type of the fixed order that a page has, article if none."""
    return table(spark, sf, "page_nodes").groupBy(F.coalesce(X.primary_type(F.col("types")), F.lit("article")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def number_parse(spark: SparkSession, sf: str) -> DataFrame:
    found = X.numbers_in(F.col("title"))
    return table(spark, sf, "raw_pages").select("raw_id", X.safe_number(F.regexp_extract("title", r"\((\d+)\)", 1)).alias("number"), F.coalesce(F.size(found), F.lit(0)).alias("n"))


def regex_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first page in key order whose label matches each pattern, whatever its case."""
    pattern = spark.createDataFrame([("hammer$",), ("^silver",), ("\\(2\\)",), ("zzzz",)], "pattern string")
    rows = table(spark, sf, "page_nodes").select("node_key", "label")
    hits = rows.withColumn("pattern", F.explode(F.array(*[F.lit(r[0]) for r in pattern.collect()]))).where(F.expr("regexp_like(lower(label), pattern)"))
    return hits.groupBy("pattern").agg(F.min("node_key").alias("node_key"), F.min_by("label", "node_key").alias("label"))


QUERIES = {f.__name__: f for f in (postings, title_names, resolve_titles, search_topk, recipe_best, response_score, title_normalize, clip, link_extract, token_counts, tri_state, unique_strings, entity_decode, article_links, types_by_priority, number_parse, regex_first)}

_TOK = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9''+_\\-]*'), lambda t: length(t) > 1)"
_N = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))".format
_PH = lambda c: f"trim(regexp_replace({_N("coalesce(" + c + ", '')")}, '[^a-z0-9]+', ' ', 'g'))"
_ALL = lambda c: f"list_sort(list_distinct(flatten(list({c}))))"
_ENT = "(CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN CASE WHEN len(json_keys({0})) = 0 THEN [] WHEN len(list_filter(json_keys({0}), lambda k: NOT regexp_matches(k, '^[0-9]+$'))) = 0 THEN list_transform(json_keys({0}), lambda k: json_extract({0}, '$.\"' || k || '\"')) ELSE [{0}] END ELSE [] END)".format
_UNQ = "(CASE WHEN json_type({0}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({0}, '$') AS JSON) ELSE {0} END)".format
_KIND = lambda kind, leaf: f"SELECT rec, pos, '{kind}' AS kind, {leaf} AS name FROM (SELECT rec, pos, unnest({_ENT('j')}) AS e FROM (SELECT rec, pos, {_UNQ("json_extract(r, '$." + kind + "')")} AS j FROM recipes))"
_PAGES = f"""nodes_ AS (SELECT {_N('id')} AS node, * EXCLUDE (id) FROM page_nodes),
base_pages AS (SELECT node, arg_min(title, node_key) AS title, arg_min(primary_type, node_key) AS primary_type, {_ALL('aliases')} AS aliases, {_ALL('types')} AS types, min(node_key) AS pos FROM nodes_ GROUP BY 1),
recs AS (SELECT 'page:' || {_N('title')} AS node, record_id AS rec, taxonomy.categories AS cats, facts FROM structured_records WHERE title IS NOT NULL),
rec_cats AS (SELECT node, {_ALL('cats')} AS categories FROM recs GROUP BY 1),
rec_fields AS (SELECT node, {_ALL('vs')} AS fields FROM (SELECT node, CAST(json_extract(facts, '$.fields.\"' || k || '\"') AS VARCHAR[]) AS vs FROM (SELECT node, facts, unnest(json_keys(facts, '$.fields')) AS k FROM recs)) GROUP BY 1),
recipes AS (SELECT rec, ord AS pos, r FROM (SELECT rec, unnest(es) AS r, generate_subscripts(es, 1) AS ord FROM (SELECT rec, {_ENT('j')} AS es FROM (SELECT rec, {_UNQ("json_extract(facts, '$.recipes')")} AS j FROM recs))) WHERE json_type(r) = 'OBJECT' AND len(json_keys(r)) > 0),
recipe_parts AS ({_KIND('tools', "json_extract_string(e, '$')")} UNION ALL {_KIND('facilities', "json_extract_string(e, '$')")} UNION ALL {_KIND('skills', "json_extract_string(e, '$.name')")} UNION ALL {_KIND('materials', "json_extract_string(e, '$.item')")} UNION ALL {_KIND('outputs', "json_extract_string(e, '$.item')")}),
pages AS (SELECT * FROM base_pages LEFT JOIN rec_cats USING (node) LEFT JOIN rec_fields USING (node))"""
_JOINED = "array_to_string(coalesce({}, []), ' ')".format
_POST = f"""{_PAGES}, post AS (SELECT token, node, sum(weight) AS weight FROM ({' UNION ALL '.join(f"SELECT unnest({_TOK(text)}) AS token, node, {w}::DOUBLE AS weight FROM pages" for text, w in (('title', 12.0), (_JOINED('aliases'), 10.0), ('primary_type', 4.0), (_JOINED('types'), 4.0), (_JOINED('categories'), 3.0), (_JOINED('fields'), 2.0)))}) GROUP BY 1, 2)"""
_NAMES = f"""names AS (SELECT name, arg_max(node, (pos, node)) AS node FROM (SELECT node, pos, {_N('x')} AS name FROM (SELECT node, pos, unnest(list_concat([title], coalesce(aliases, []))) AS x FROM pages) UNION ALL SELECT node, pos, {_PH('x')} FROM (SELECT node, pos, unnest(list_concat([title], coalesce(aliases, []))) AS x FROM pages)) WHERE name <> '' GROUP BY 1)"""
_ASKED = ", ".join(f"('{q}', '{t}')" for q, t in ASKED)
_SCORED = f"""q AS (SELECT query, text, {_N('text')} AS asked, {_PH('text')} AS said, {_TOK('text')} AS words FROM (VALUES {_ASKED}) v(query, text)),
part_points AS (SELECT query, rec, pos, CASE WHEN len(ws) = 0 THEN 0.0 WHEN length(ph) >= 4 AND contains(said, ph) THEN CASE kind WHEN 'outputs' THEN 40.0 ELSE 80.0 END WHEN len(list_intersect(ws, words)) = len(ws) THEN CASE kind WHEN 'outputs' THEN 25.0 ELSE 45.0 END WHEN len(list_intersect(ws, words)) > 0 AND len(list_intersect(ws, words)) * 2 >= len(ws) THEN 15.0 ELSE 0.0 END AS p
  FROM (SELECT *, list_distinct({_TOK('name')}) AS ws, {_PH('name')} AS ph FROM recipe_parts), q),
recipe_points AS (SELECT query, node, max(p) AS p FROM (SELECT query, rec, pos, sum(p) AS p FROM part_points GROUP BY 1, 2, 3) JOIN (SELECT DISTINCT rec, node FROM recs) USING (rec) GROUP BY 1, 2)"""
FOUND = lambda k: f"""WITH {_POST}, {_NAMES}, {_SCORED},
h AS (SELECT query, node, sum(weight) AS base FROM (SELECT query, unnest(words) AS token FROM q) JOIN post USING (token) GROUP BY 1, 2), ex AS (SELECT query, node FROM q JOIN names ON name = asked),
o AS (SELECT query, node, CASE WHEN asked <> '' AND contains({_N('title')}, asked) THEN 25 ELSE 0 END AS i, list_filter(list_transform(list_concat([title], coalesce(aliases, [])), lambda x: {_PH('x')}), lambda p: length(p) >= 4 AND contains(said, p))[1] AS f, CASE WHEN NOT list_contains(words, 'burnt') AND (contains({_PH('title')}, 'burnt') OR len(list_filter(coalesce(categories, []), lambda c: {_PH('c')} = 'burnt food')) > 0) THEN -90 ELSE 0 END AS b FROM pages, q),
s AS (SELECT query, node, round(coalesce(base, 0) + CASE WHEN ex.node IS NOT NULL THEN 100 ELSE 0 END + i + CASE WHEN contains(f, ' ') THEN 250 WHEN f IS NOT NULL THEN 40 ELSE 0 END + coalesce(p, 0) + b + 2 * ln(1 + coalesce(rank, 0) * 1e5), 6) AS score, ex.node IS NOT NULL OR f IS NOT NULL AS strong
  FROM o LEFT JOIN h USING (query, node) LEFT JOIN ex USING (query, node) LEFT JOIN recipe_points USING (query, node) LEFT JOIN ({PAGE_RANKS}) pr ON pr.id = node WHERE base IS NOT NULL OR ex.node IS NOT NULL OR i > 0 OR f IS NOT NULL OR coalesce(p, 0) > 0 OR b < 0)
SELECT * FROM (SELECT query, node, score, strong, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rn FROM s) WHERE rn <= {k}"""  # noqa: E731
ORACLE = {
    "postings": f"WITH {_POST} SELECT * FROM post",
    "title_names": f"WITH {_PAGES}, {_NAMES} SELECT * FROM names",
    "resolve_titles": f"WITH {_PAGES}, {_NAMES} SELECT raw_id, node FROM raw_pages LEFT JOIN names ON name = {_N('requested_title')}",
    "search_topk": FOUND(5),
    "recipe_best": f"WITH {_PAGES}, {_SCORED} SELECT node, p AS score FROM recipe_points SEMI JOIN pages USING (node) WHERE query = 'g' AND p > 0",
    "response_score": "WITH x AS (SELECT doc_id, contains(lower(text), 'level')::INT + contains(lower(text), 'tower')::INT + contains(lower(text), 'hammer')::INT AS hits, contains(lower(text), 'guide')::INT + contains(lower(text), '|-')::INT AS bad FROM documents) SELECT doc_id, hits, bad, hits - 2 * bad AS score FROM x",
    "title_normalize": r"SELECT raw_id, lower(trim(replace(title, '_', ' '))) AS title_form, lower(trim(regexp_replace(replace(title, '_', ' '), '[\s\p{Z}]+', ' ', 'g'))) AS normal_name, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'section') AS slug, trim(regexp_replace(lower(trim(regexp_replace(replace(title, '_', ' '), '[\s\p{Z}]+', ' ', 'g'))), '\d+$', '')) AS base_field FROM raw_pages",
    "clip": "WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substring(t, 1, 57), ' ') || '...' ELSE t END AS clipped FROM x",
    "link_extract": r"WITH m AS (SELECT doc_id, regexp_extract_all(text, '\[\[([^\[\]|#]*)(?:#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]', 1) AS ts, regexp_extract_all(text, '\[\[([^\[\]|#]*)(?:#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]', 2) AS ls FROM documents), u AS (SELECT doc_id, unnest(ts) AS t, unnest(ls) AS l, generate_subscripts(ts, 1) AS i FROM m), k AS (SELECT doc_id, trim(t) AS target, coalesce(nullif(trim(l), ''), trim(t)) AS label, i FROM u WHERE trim(t) <> '' AND NOT regexp_matches(trim(t), '^\s*(file|image|category)\s*:', 'i')) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS at, target, label FROM k",
    "token_counts": f"SELECT doc_id, len({_TOK('text')}) AS tokens FROM documents",
    "tri_state": "WITH x AS (SELECT lower(json_extract_string(facts, '$.fields.members[0]')) AS m FROM structured_records) SELECT CASE WHEN m IN ('yes', 'true', 'y') THEN true WHEN m IN ('no', 'false', 'n') THEN false END AS members, count(*) AS n FROM x GROUP BY 1",
    "unique_strings": "WITH x AS (SELECT record_id, list_transform(taxonomy.categories, lambda c: trim(regexp_replace(replace(c, '_', ' '), '[\\s\\p{Z}]+', ' ', 'g'))) AS cs FROM structured_records), f AS (SELECT record_id, list_filter(cs, lambda c: c IS NOT NULL AND c <> '') AS cs FROM x), u AS (SELECT record_id, list_filter(cs, lambda c, i: list_position(cs, c) = i) AS cs FROM f) SELECT record_id, array_to_string(cs, '|') AS categories, len(cs) AS n FROM u",
    "entity_decode": "SELECT raw_id, 'a< ' || title || chr(39) || '> ' || chr(39) || chr(34) AS text FROM raw_pages WHERE title IS NOT NULL",
    "article_links": "WITH x AS (SELECT raw_id, list_filter(links, lambda x: x.ns = 0 AND coalesce(x.exists, true)) AS k FROM raw_pages) SELECT raw_id, coalesce(len(k), 0) AS n, array_to_string(list_filter(list_transform(k[1:3], lambda x: x.title), lambda t: t IS NOT NULL), '|') AS first FROM x",
    "types_by_priority": f"SELECT coalesce(list_filter({list(X.TYPE_PRIORITY)}, lambda x: list_contains(types, x))[1], 'article') AS type, count(*) AS n FROM page_nodes GROUP BY 1",
    "number_parse": r"SELECT raw_id, TRY_CAST(nullif(regexp_extract(title, '\((\d+)\)', 1), '') AS DOUBLE) AS number, coalesce(len(regexp_extract_all(title, '\b\d+\b')), 0) AS n FROM raw_pages",
    "regex_first": r"WITH p AS (SELECT unnest(['hammer$', '^silver', '\(2\)', 'zzzz']) AS pattern) SELECT pattern, min(node_key) AS node_key, arg_min(label, node_key) AS label FROM page_nodes, p WHERE regexp_matches(lower(label), pattern) GROUP BY 1",
}
