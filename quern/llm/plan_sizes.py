"""Problems 6 and 7: the texts of documents by size in tokens, in containers and in a mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.mixing import Mix
from quern.llm.packing import fill, pack
from quern.llm.sizes import with_tokens
from quern.runtime import cut, table


def sized(spark: SparkSession, sf: str, keep: list[str]) -> DataFrame:
    """id, the columns ``keep``, n_tokens, slot and row; written once, as counting tokens is the costly part.

    slot, a hash of id and text, deals and shuffles, so that neither files nor cluster matter; row tells apart rows
    that are repeated.
    """
    docs = table(spark, sf, "documents").select("doc_id", *keep, "text").withColumn("slot", F.xxhash64(F.lit(29), "doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    return cut(with_tokens(docs, "text", ["doc_id", *keep, "slot", "row"]).withColumnRenamed("doc_id", "id"), "sized")


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack(sized(spark, sf, []), table(spark, sf, "pack_sizes"))
    return packed.withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill(pack(sized(spark, sf, []), table(spark, sf, "pack_sizes")))


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing, per capacity: documents, and how often each rule is broken.

    lost: documents whose pieces are not their tokens, each once and in order; overfull: containers above capacity;
    split: documents cut that would have fit; spread: containers whose fill, with that of another of the same group,
    would have fit into one (first fit leaves at most one container of a group at half its capacity or below).
    """
    sizes = sized(spark, sf, [])
    packed = cut(pack(sizes, table(spark, sf, "pack_sizes")), "packed")
    whole = sizes.groupBy("id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows"))
    docs = packed.groupBy("pack_name", "id").agg(F.sum("tokens").alias("got"), F.max("capacity").alias("capacity"), F.countDistinct("start_token", "piece").alias("places"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("piece") * F.col("capacity") != F.col("start_token")).alias("moved"))
    judged = docs.join(whole, "id", "full").groupBy("pack_name").agg(
        F.count("id").alias("documents"),
        F.sum(((F.col("got") != F.col("n")) | F.col("moved") | ((F.col("rows") == 1) & (F.col("places") != F.col("pieces")))).cast("bigint")).alias("lost"),
        F.sum(((F.col("pieces") > F.col("rows")) & (F.col("rows") == 1) & (F.col("n") <= F.col("capacity"))).cast("bigint")).alias("split"),
    )
    fills = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    over = fills.groupBy("pack_name").agg(F.sum((F.col("tokens") > F.col("capacity")).cast("bigint")).alias("overfull"))
    groups = fills.groupBy("pack_name", F.substring_index("container", "-", 1).alias("g")).agg(F.sum((F.col("tokens") * 2 <= F.col("capacity")).cast("bigint")).alias("low"))
    spread = groups.groupBy("pack_name").agg(F.sum(F.greatest(F.col("low") - 1, F.lit(0))).alias("spread"))
    return judged.join(over, "pack_name").join(spread, "pack_name").select("pack_name", "documents", "lost", "split", "overfull", "spread")


def _mix(spark: SparkSession, sf: str, of_all: bool = False) -> Mix:
    """The largest mix that meets every share or, with ``of_all``, one of as many tokens as all documents together."""
    sizes = sized(spark, sf, ["source"])
    budget = sizes.agg(F.sum("n_tokens")).first()[0] or 0 if of_all else None
    return Mix(sizes, table(spark, sf, "mix_targets"), budget)


def p7_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).selection().withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    mix = _mix(spark, sf)
    return mix.shares(mix.selection())


def p7_budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """A total budget of as many tokens as there are: small sources are repeated up to their cap, large ones fill up."""
    return _mix(spark, sf, True).selection().withColumnRenamed("id", "doc_id")


def p7_budgeted_shares(spark: SparkSession, sf: str) -> DataFrame:
    mix = _mix(spark, sf, True)
    return mix.shares(mix.selection())


def p7_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).filled()


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of both mixes, per source with a target, and how often each rule is broken.

    overused: documents used more than max_repeats times or twice under one number; skipped: documents used again
    before each one of the source was used; adrift: the source is further from its share than its largest document and
    the share of a full budget allow, though it is not exhausted (of the mix that meets all shares only).
    """
    parts = []
    for of_all in (False, True):
        mix = _mix(spark, sf, of_all)
        chosen = cut(mix.selection(), "chosen")
        per_doc = chosen.groupBy("source", "id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("use").alias("numbers"))
        caps = mix.targets.select(F.col("name").alias("source"), "share", "repeats", "key")
        uses = per_doc.join(caps, "source").groupBy("source").agg(F.sum(((F.col("uses") > F.col("repeats")) | (F.col("uses") != F.col("numbers"))).cast("bigint")).alias("overused"), (F.greatest(F.max("uses") - F.min("uses") - 1, F.lit(0))).alias("skipped"), F.count(F.lit(1)).alias("distinct_docs"))
        tokens = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
        largest = mix.queued.groupBy("key").agg(F.max("n_tokens").alias("largest"))
        slack = sum(r["largest"] for r in largest.collect())
        joined = caps.join(largest, "key").join(uses, "source", "left").join(tokens, "source", "left").na.fill(0)
        off = F.abs(F.col("tokens") - F.col("share") * F.lit(mix.budget)) > F.col("largest") + F.col("share") * F.lit(slack)
        parts.append(joined.select("source", F.lit(of_all).alias("budgeted"), F.col("repeats").alias("max_repeats"), "overused", "skipped", (off & F.lit(not of_all)).cast("bigint").alias("adrift")))
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_invariants, p7_mixed, p7_shares, p7_budgeted, p7_budgeted_shares, p7_filled, p7_invariants)}
ORACLE: dict[str, str] = {
    "p6_invariants": "SELECT pack_name, (SELECT count(*) FROM documents) AS documents, 0 AS lost, 0 AS split, 0 AS overfull, 0 AS spread FROM pack_sizes",
    "p7_invariants": r"""WITH k AS (SELECT lower(regexp_replace(coalesce(source, ''), '[\s\p{Z}_\-]+', '', 'g')) AS key, source, target_share, max_repeats FROM mix_targets WHERE target_share > 0 AND max_repeats > 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY target_share DESC, max_repeats DESC, source) AS rn FROM k) WHERE rn = 1),
d AS (SELECT DISTINCT lower(regexp_replace(coalesce(source, ''), '[\s\p{Z}_\-]+', '', 'g')) AS key FROM documents WHERE text <> '')
SELECT source, budgeted, max_repeats, 0 AS overused, 0 AS skipped, 0 AS adrift FROM t SEMI JOIN d USING (key), (VALUES (false), (true)) b(budgeted)""",
}
