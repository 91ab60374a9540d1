"""Keyword search over pages: title resolution, weighted postings, scored top-k with phrases and recipes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import normal_name, phrase, tokens

#: The weight of a token by the part of the page in which it stands.
WEIGHTS = {"title": 12.0, "alias": 10.0, "primary_type": 4.0, "types": 4.0, "category": 3.0, "lead": 2.0, "field": 2.0}
#: Points for the resolved page, the query in the title, a name of several words or of one in the query,
#: and for what is burnt while the query doesn't ask for it.
EXACT, IN_TITLE, PHRASE, WORD, BURNT = 100.0, 25.0, 250.0, 40.0, -90.0
#: Points of a part of a recipe that is in the query as a phrase, by all of its words, by half of them.
OUTPUT_POINTS, INPUT_POINTS, HALF_POINTS = (40.0, 25.0), (80.0, 45.0), 15.0


def _weighted(of: Column, weight: float) -> Column:
    return F.transform(of, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight")))


def postings(records: DataFrame, node_id: str, parts: dict[str, Column]) -> DataFrame:
    """token, node, weight; parts: name in WEIGHTS to a text. Every occurrence of a token in a part adds its weight."""
    entries = [_weighted(tokens(text), WEIGHTS[name]) for name, text in parts.items()]
    flat = records.select(F.col(node_id).alias("node"), F.explode(F.flatten(F.array(*entries))).alias("p"))
    return flat.groupBy(F.col("p.token").alias("token"), "node").agg(F.sum("p.weight").alias("weight"))


def title_index(pages: DataFrame) -> DataFrame:
    """name, node: every title and alias of the pages (node, title, aliases, at) in both its normal forms.

    Where several pages have a name the last one in the order of ``at`` has it.
    """
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    forms = F.flatten(F.transform(names, lambda x: F.array(normal_name(x), phrase(x))))
    flat = pages.select("node", "at", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))).alias("name"))
    return flat.groupBy("name").agg(F.max_by("node", F.struct("at", "node")).alias("node"))


def resolve(refs: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """refs with ``node``: the page that a name leads to, null if there is none."""
    found = refs.withColumn("_name", normal_name(F.col(name))).join(index.select(F.col("name").alias("_of"), "node"), F.col("_name") == F.col("_of"), "left")
    return found.drop("_name", "_of")


def recipe_parts(recipes: Column) -> Column:
    """What ``recipe_points`` looks at: the parts of recipes, as array of arrays of struct<out, words, text>."""
    one = lambda x: F.struct((x["kind"] == "outputs").alias("out"), F.array_distinct(tokens(x["name"])).alias("words"), phrase(x["name"]).alias("text"))
    return F.transform(F.coalesce(recipes, F.array().cast("array<array<struct<kind:string,name:string>>>")), lambda r: F.transform(r, one))


def recipe_points(parts: Column, asked_tokens: Column, asked_phrase: Column) -> Column:
    """The points of the best recipe, from its ``recipe_parts``; the words are compared only where any is shared."""

    def part(x: Column) -> Column:
        words, text, out = x["words"], x["text"], x["out"]
        shared = F.size(F.array_intersect(words, asked_tokens))
        points = lambda i: F.when(out, OUTPUT_POINTS[i]).otherwise(INPUT_POINTS[i])
        whole = (F.length(text) >= 4) & F.contains(asked_phrase, text)
        by_words = F.when(~F.arrays_overlap(words, asked_tokens), 0.0).when(shared == F.size(words), points(1)).when(shared * 2 >= F.size(words), HALF_POINTS)
        return F.when(F.size(words) == 0, 0.0).when(whole, points(0)).otherwise(F.coalesce(by_words, F.lit(0.0)))

    sums = F.transform(parts, lambda r: F.aggregate(r, F.lit(0.0).cast("double"), lambda acc, x: acc + part(x)))
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(sums), F.lit(0.0)))


def recipe_score(recipes: Column, asked_tokens: Column, asked_phrase: Column) -> Column:
    """The points of the best recipe: an array of arrays of struct<kind, name>, its parts; kind outputs counts less.

    A part counts as a phrase of four characters or more in the query, or else by the share of its words there.
    Repeated parts count again; a page without recipes has 0.
    """
    return recipe_points(recipe_parts(recipes), asked_tokens, asked_phrase)


def search(queries: DataFrame, index: DataFrame, names: DataFrame, pages: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """The k best pages of each query: query, node, score, strong, rn. Ties go to the smaller node.

    queries: query, text, of which there are at most ``most_queries`` (else an error). index: postings. names:
    title_index. pages: node, title, aliases, categories, recipes, rank. Every occurrence of a token in the query adds
    its posting weight. The page that the query names, the query in a title, the first title or alias in the query, the
    best recipe, and burnt things that were not asked for add theirs, as does the rank. A page with nothing of these is
    no result. strong: the page was named by the query, or its title or an alias is in it.

    The tokens are joined with the postings. All other points need each query against each page, so the queries are
    sent to the pages, which are read once and never shuffled; the window keeps k rows per query and task. What does not
    depend on a query, such as the words of recipes, is made once per page.
    """
    small = queries.limit(most_queries + 1).collect()
    if len(small) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    asked = queries.select("query", normal_name(F.coalesce("text", F.lit(""))).alias("asked"), phrase(F.col("text")).alias("said"), tokens(F.col("text")).alias("words"), F.col("text"))
    words = asked.select("query", F.explode("words").alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))
    base = words.join(index, "token").groupBy("query", "node").agg(F.sum(F.col("times") * F.col("weight")).alias("base"))
    exact = resolve(asked.select("query", "text"), "text", names).where(F.col("node").isNotNull()).select("query", "node", F.lit(EXACT).alias("exact"))
    none = F.array().cast("array<string>")
    own = pages.select("node", "rank", recipe_parts(F.col("recipes")).alias("_parts"), normal_name(F.col("title")).alias("_title"), phrase(F.col("title")).alias("_phrase"), F.transform(F.concat(F.array("title"), F.coalesce("aliases", none)), phrase).alias("_phrases"), F.exists(F.coalesce("categories", none), lambda c: F.coalesce(phrase(c) == "burnt food", F.lit(False))).alias("_burnt"))
    both = own.join(F.broadcast(asked.drop("text"))).withColumn("_first", F.try_element_at(F.filter("_phrases", lambda p: (F.length(p) >= 4) & F.contains(F.col("said"), p)), F.lit(1)))
    inside = F.when((F.col("asked") != "") & F.contains("_title", "asked"), IN_TITLE).otherwise(0.0)
    named = F.when(F.contains("_first", F.lit(" ")), PHRASE).when(F.col("_first").isNotNull(), WORD).otherwise(0.0)
    burnt = F.when(~F.array_contains("words", "burnt") & (F.contains("_phrase", F.lit("burnt")) | F.col("_burnt")), BURNT).otherwise(0.0)
    other = both.select("query", "node", "rank", F.coalesce(inside, F.lit(0.0)).alias("_in"), named.alias("_named"), recipe_points(F.col("_parts"), F.col("words"), F.col("said")).alias("_recipe"), F.coalesce(burnt, F.lit(0.0)).alias("_off"))
    joined = other.join(base, ["query", "node"], "left").join(exact, ["query", "node"], "left")
    found = F.col("base").isNotNull() | F.col("exact").isNotNull() | (F.col("_in") > 0) | (F.col("_named") > 0) | (F.col("_recipe") > 0) | (F.col("_off") < 0)
    score = F.coalesce("base", F.lit(0.0)) + F.coalesce("exact", F.lit(0.0)) + F.col("_in") + F.col("_named") + F.col("_recipe") + F.col("_off") + 2 * F.log1p(F.coalesce("rank", F.lit(0.0)) * 1e5)
    ranked = joined.where(found).withColumn("score", F.round(score, 6)).withColumn("strong", F.col("exact").isNotNull() | (F.col("_named") > 0))
    window = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    return ranked.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k).select("query", "node", "score", "strong", "rn")


def response_score(rows: DataFrame, text: str, expected: list[str], avoid: list[str]) -> DataFrame:
    """Adds hits, bad and score = hits - 2 bad: which terms are in the text, whatever their case."""
    low = F.lower(F.col(text))
    count = lambda terms: sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    return rows.withColumn("hits", count(expected)).withColumn("bad", count(avoid)).withColumn("score", F.col("hits") - 2 * F.col("bad"))


def catalog_score(query: str, name: Column, debug: Column, tags: Column) -> Column:
    """Points of an entry for each word of a query: 3 in its written key, 2 in its name, 1.5 in its tags; 12 more for the
    whole query in the name and 10 in the key. Words of one character do not count; without words there are no points."""
    words = [w for w in re.sub(r"[^a-z0-9]+", " ", query.lower()).split() if len(w) > 1]
    if not words:
        return F.lit(0.0)
    low, key, tag = phrase(name), F.lower(F.coalesce(debug, F.lit(""))), F.lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    points = lambda where, what, n: F.when(F.contains(where, F.lit(what)), n).otherwise(0.0)
    each = [points(key, w, 3.0) + points(low, w, 2.0) + points(tag, w, 1.5) for w in words]
    return sum(each, F.lit(0.0)) + points(low, " ".join(words), 12.0) + points(F.translate(key, "_", " "), " ".join(words), 10.0)
