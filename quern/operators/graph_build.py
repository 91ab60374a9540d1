"""Edges of a property graph from nested records, one rule per relation, each with its weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import normal_name, page_id, slug

#: The weight of an edge by its relation.
WEIGHTS = {
    "wiki_link": 1.0, "lead_link": 4.0, "infobox_link": 5.0, "in_category": 0.5, "has_action": 2.0, "equips_in_slot": 2.0, "uses_combat_style": 1.5, "requires_skill": 3.0,
    "requires_tool": 2.5, "uses_facility": 2.5, "requires_material": 3.0, "produces_item": 3.0, "variant_quest": 2.0, "variant_location": 2.0, "variant_action": 1.5,
}


def node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), normal_name(name) if kind in ("category", "page") else slug(name))


def edges_from(records: DataFrame, source: Column, rules: list[tuple[str, Column, str]], most_links: int = 100) -> DataFrame:
    """source, target, relation, weight; rules: relation, array of names, kind of the target.

    Only wiki_link is cut to its first ``most_links`` names. Null and blank names give no edge. All rules of a record
    are exploded in one pass.
    """
    parts = []
    for relation, names, kind in rules:
        real = F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != ""))
        kept = F.slice(real, 1, most_links) if relation == "wiki_link" else real
        parts.append(F.coalesce(F.transform(kept, _edge(relation, kind)), F.array().cast("array<struct<target:string,relation:string,weight:double>>")))
    return records.select(source.alias("source"), F.explode(F.flatten(F.array(*parts))).alias("e")).select("source", "e.*")


def _edge(relation: str, kind: str):
    return lambda x: F.struct(node_id(kind, x).alias("target"), F.lit(relation).alias("relation"), F.lit(WEIGHTS[relation]).alias("weight"))


def nodes_from(records: DataFrame, source: Column, edges: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """id, kind and columns: every record as a page node, and every target that is no record by its prefix."""
    pages = records.select(source.alias("id"), F.lit("page").alias("kind"), *[c.alias(k) for k, c in columns.items()])
    others = edges.select(F.col("target").alias("id")).distinct().join(pages.select("id"), "id", "left_anti")
    return pages.unionByName(others.withColumn("kind", F.substring_index("id", ":", 1)), allowMissingColumns=True)


def follow_redirects(refs: DataFrame, redirects: DataFrame, title: str, most_steps: int = 1) -> DataFrame:
    """Adds ``target``: the title a reference leads to by redirects (from, to), compared in normal form."""
    steps = redirects.select(normal_name(F.col("from")).alias("_f"), F.col("to").alias("_t")).where(F.col("_f").isNotNull()).groupBy("_f").agg(F.min("_t").alias("_t"))
    out = refs.withColumn("target", F.col(title))

    def once(rows: DataFrame, _: int) -> DataFrame:
        return rows.withColumn("_n", normal_name(F.col("target"))).join(steps, F.col("_n") == F.col("_f"), "left").withColumn("target", F.coalesce("_t", "target")).drop("_n", "_f", "_t")

    return reduce(once, range(most_steps), out)


def phrases_in(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, most_words: int = 6) -> DataFrame:
    """Pairs of a text and a phrase of whole words that it contains: an equi-join over the text's word windows.

    texts: id and the text. phrases: the phrase in search-token form. Every window of one to ``most_words`` words is
    a key, so no pair is tried that does not match; longer phrases are matched by their first ``most_words`` words
    and then compared in full.
    """
    from quern.functions.text import tokens

    words = tokens(F.col(text))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0))), lambda i: i + n <= F.size("_w")), lambda i: F.array_join(F.slice("_w", i + 1, n), " "))))
    keyed = texts.withColumn("_w", words).withColumn("_key", F.explode(F.array_distinct(windows)))
    normal = phrases.withColumn("_p", tokens(F.col(phrase))).where(F.size("_p") > 0).withColumn("_key", F.array_join(F.slice("_p", 1, most_words), " "))
    joined = keyed.join(normal, "_key")
    whole = F.contains(F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("_p", " "), F.lit(" ")))
    return joined.where(whole).drop("_w", "_key", "_p")
