"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a shuffled queue. Its virtual finish time is the number of tokens of its source
up to and with it, divided by the source's weight; a source that is used again goes on counting. Taken in the order
of the finish times, all sources have their share of the tokens at any point, so the mix is that order, sorted
globally by ranges and cut off at the total budget. The running token counts come from range partitions, so no
source, however large, meets in one task. Before the sort only those uses are left out that can't be within the
budget: every source is at most its largest document behind its share, so the budget is full once the budget and the
largest documents of all sources would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut, running_total


def source_key(source: Column) -> Column:
    """One spelling of a source name: case, white space, ``_`` and ``-`` do not count."""
    return F.lower(F.regexp_replace(F.coalesce(source, F.lit("")), r"[\s\p{Z}_\-]+", ""))


def finish_line(available: dict[str, int], share: dict[str, float], repeats: dict[str, int], budget: int | None) -> tuple[float, int]:
    """The virtual time at which the budget is used up, and the budget.

    Without a budget it is the largest mix in which every source still has its share: the first source that is
    exhausted ends it. With a larger budget the sources that are left go on, and the actual shares leave the targets.
    """
    ends = {s: available[s] * repeats[s] / w for s, w in share.items() if w > 0 and available.get(s, 0) > 0}
    if not ends:
        return 0.0, 0
    if budget is None:
        line = min(ends.values())
        return line, sum(round(min(line, ends[s]) * share[s]) for s in ends)
    used, line = 0.0, 0.0
    for end in sorted(set(ends.values())):
        rate = sum(share[s] for s in ends if ends[s] >= end)
        if used + rate * (end - line) >= budget:
            return line + (budget - used) / rate, budget
        used, line = used + rate * (end - line), end
    return line, min(budget, round(used))


class Mix:
    """A mix of sized documents (id, source, n_tokens, slot, row) to the targets (source, target_share, max_repeats).

    slot: a hash of the row; row: a number that is unique and fixed with the table. Shares are divided by their sum. Sources without a target,
    with a null or zero share or without tokens give nothing; documents without tokens are left out, as they have
    no place in a queue of tokens. Null ids and repeated rows are documents like any other. targets is a small
    table of the user's, one row per source, of which the driver holds up to ``most_sources``; a repeated source
    counts with its largest share. Empty tables give an empty mix.
    """

    def __init__(self, sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, most_sources: int = 10_000):
        rows = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select("source", source_key(F.col("source")).alias("key"), "target_share", "max_repeats").limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} sources have a target")
        first = {}
        for r in sorted(rows, key=lambda r: (r["key"], -r["target_share"], -r["max_repeats"], r["source"] or "")):
            first.setdefault(r["key"], r)
        whole = sum(r["target_share"] for r in first.values()) or 1.0
        self.share = {k: r["target_share"] / whole for k, r in first.items()}
        self.repeats = {k: int(r["max_repeats"]) for k, r in first.items()}
        self.names = {k: r["source"] for k, r in first.items()}
        spark = sized.sparkSession
        schema = "key string, name string, share double, repeats int"
        self.targets = spark.createDataFrame([(k, self.names[k], self.share[k], self.repeats[k]) for k in first], schema)
        keyed = sized.select("id", source_key(F.col("source")).alias("key"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "slot", "row").where(F.col("n_tokens") > 0)
        wanted = keyed.join(F.broadcast(self.targets), "key", "left_semi") if first else keyed.where(F.lit(False))
        self.queued = cut(running_total(wanted.withColumn("turn", F.xxhash64("slot", F.lit(seed))), ["key"], ["turn", "row"], "n_tokens", "upto"), "queued")
        totals = self.queued.groupBy("key").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("largest")).collect()
        self.available = {r["key"]: int(r["t"]) for r in totals}
        _, self.budget = finish_line(self.available, self.share, self.repeats, budget)
        self.line, _ = finish_line(self.available, self.share, self.repeats, self.budget + sum(int(r["largest"]) for r in totals))

    def selection(self) -> DataFrame:
        """id, source, use (0 for the first), n_tokens, finish, upto: the mix, to be read in the order of ``finish``.

        upto: tokens of the mix up to and with this document. The first document that would cross the budget ends the
        mix, so the budget is filled but for less than one document, unless the documents run out.
        """
        return self._ordered().where(F.col("upto") <= self.budget)

    def _ordered(self) -> DataFrame:
        limits = self.targets.join(self._totals(), "key")
        joined = self.queued.join(F.broadcast(limits), "key")
        # Use number u ends at (u * t + upto) / share; only uses that end by the line are made.
        last = F.floor((self.line * (1 + 1e-9) * F.col("share") - F.col("upto")) / F.col("t"))
        n = F.least(F.col("repeats"), last.cast("int") + 1)
        uses = joined.where(n > 0).withColumn("use", F.explode(F.sequence(F.lit(0), n - 1)))
        timed = uses.withColumn("finish", (F.col("use") * F.col("t") + F.col("upto")) / F.col("share"))
        slim = timed.select("id", F.col("name").alias("source"), "use", "n_tokens", "finish", "row")
        return running_total(slim, [], ["finish", "source", "row", "use"], "n_tokens", "upto").drop("row")

    def filled(self) -> DataFrame:
        """budget, tokens, unfilled, crossing: one row; crossing is the size of the document that the budget cut off."""
        ordered = self._ordered()
        inside = F.col("upto") <= self.budget
        got = ordered.agg(F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("tokens"), F.min_by(F.when(~inside, F.col("n_tokens")), F.when(~inside, F.col("upto"))).alias("crossing"))
        return got.select(F.lit(self.budget).cast("bigint").alias("budget"), "tokens", (F.lit(self.budget) - F.col("tokens")).alias("unfilled"), "crossing")

    def _totals(self) -> DataFrame:
        spark = self.queued.sparkSession
        return spark.createDataFrame(list(self.available.items()), "key string, t bigint") if self.available else spark.createDataFrame([], "key string, t bigint")

    def shares(self, selection: DataFrame) -> DataFrame:
        """source, target_share, tokens, actual_share, documents, most_uses, available: every source with a target."""
        got = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("id").alias("documents"), (F.max("use") + 1).alias("most_uses"))
        rows = self.targets.join(self._totals(), "key", "left").select(F.col("name").alias("source"), F.col("share").alias("target_share"), F.coalesce("t", F.lit(0)).alias("available"))
        joined = rows.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
        of_all = Window.partitionBy()  # one row per source with a target
        out = joined.withColumn("_whole", F.sum("tokens").over(of_all))
        return out.select("source", "target_share", "tokens", F.when(F.col("_whole") > 0, F.col("tokens") / F.col("_whole")).alias("actual_share"), "documents", "most_uses", "available")
