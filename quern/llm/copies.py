"""Duplicates hidden by formatting: records that are equal but for white space, case, punctuation or field order.

Each record gets a canonical key. Keys with very many rows are found exactly from partial counts and are treated
in two levels: their rows are spread over salts, aggregated per (key, salt), and the few partial results are
combined. All other keys take one shuffle, in which no group is larger than the bound of a cold key. The
representative of a class is its smallest id, so the result does not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import letters_digits
from quern.runtime import cut, hot_keys, salts_for


def canonical_json(text: Column) -> Column:
    """A JSON text in one spelling: keys sorted at every level, no white space, escapes resolved.

    Null and ``{}`` give ''. Text that is no JSON is compared as it is but for outer white space.
    """
    parsed = F.to_json(F.try_parse_json(text))
    made = F.coalesce(parsed, F.concat(F.lit("!"), F.trim(text)), F.lit(""))
    return F.when(made == "{}", F.lit("")).otherwise(made)


def keyed_records(records: DataFrame, record_id: str, text_fields: list[str], json_fields: list[str] = ()) -> DataFrame:
    """id, key: key is a 256-bit digest of the canonical forms of the fields.

    Text fields count by their letters and digits only, without case; null counts as empty, and so does a text
    without any letter or digit. Field boundaries are kept. Other columns, whatever their names, are not read.
    """
    parts = [letters_digits(F.col(f"`{c}`")) for c in text_fields] + [canonical_json(F.col(f"`{c}`")) for c in json_fields]
    return records.select(F.col(f"`{record_id}`").alias("id"), F.unhex(F.sha2(F.concat_ws("\u0001", *parts), 256)).alias("key"))


class CopyClasses:
    """The classes of copies of keyed records (id, key).

    Null ids count as copies but never represent a class unless it has no other id. Rows that repeat an id count
    as copies too. An empty table has no classes.
    """

    def __init__(self, keyed: DataFrame, max_hot: int = 2000, min_hot_rows: int = 1000, rows_per_salt: int = 50_000, label: str = "keyed"):
        self.keyed = cut(keyed, label)
        hot = hot_keys(self.keyed, ["key"], max_hot, min_hot_rows)
        self.hot = hot.select("key", salts_for(F.col("n_rows"), rows_per_salt).alias("salts"))

    def _hot_classes(self) -> DataFrame:
        rows = self.keyed.join(F.broadcast(self.hot), "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
        first = rows.groupBy("key", "salt").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        return first.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))

    def _cold(self) -> DataFrame:
        return self.keyed.join(F.broadcast(self.hot), "key", "left_anti")

    def collapsed(self) -> DataFrame:
        """first_id, copies: one row per distinct record."""
        cold = self._cold().groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        return cold.unionByName(self._hot_classes()).select("first_id", "copies")

    def members(self) -> DataFrame:
        """id, first_id, copies: every row with its class. Rows of hot keys are not shuffled: their few classes are sent to them."""
        of_key = Window.partitionBy("key")
        cold = self._cold().select("id", F.min("id").over(of_key).alias("first_id"), F.count(F.lit(1)).over(of_key).alias("copies"))
        hot = self.keyed.join(F.broadcast(self._hot_classes()), "key").select("id", "first_id", "copies")
        return cold.unionByName(hot)
