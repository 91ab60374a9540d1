"""Frequency of every distinct term: a global integer dictionary, blockwise count arrays, sums by identifier range.

1. ``block_counts``: each block (a task's share of the rows) counts its terms: occurrences, and rows that hold the
   term. A very frequent term leaves a block as one row, so no term is a hot key afterwards.
2. ``dictionary``: the distinct terms are range-sorted and numbered from 0 without gaps, in the order of their text;
   the numbers come from the sizes of the ranges, not from a sort in one task.
3. ``count_arrays``: the blocks are encoded with the dictionary and cut into identifier ranges; each block has, per
   range, arrays of identifiers, occurrences and row counts.
4. ``sum_ranges``: the arrays of each range are added up in dense arrays of ``range_size`` numbers, in two levels.

A null term does not count; a repeated row counts again; an empty table gives an empty result. Terms are compared as
they come in, so they should be in normal form. Memory is bounded by ``range_size`` and ``most_local`` terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut

BLOCKS = "block bigint, field string, term string, occurrences bigint, n_rows bigint"
SUMS = "range bigint, salt bigint, ids array<bigint>, occurrences array<bigint>, n_rows array<bigint>"


def block_counts(rows: DataFrame, fields: list[str], most_local: int = 500_000) -> DataFrame:
    """block, field, term, occurrences, n_rows; fields: columns of type array<string>, null arrays count as empty.

    A block that has met ``most_local`` distinct terms hands them on and starts anew, so a term may leave a block
    more than once; the sums are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local: dict[tuple[str, str], list[int]] = {}
        block = None

        def flush() -> pa.RecordBatch:
            keys = list(local)
            out = pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in local.values()], pa.int64()), pa.array([v[1] for v in local.values()], pa.int64())], names=["block", "field", "term", "occurrences", "n_rows"])
            local.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block")[0].as_py() if block is None else block
            for f in fields:
                lists = batch.column(f)
                flat = lists.flatten()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                there = codes >= 0
                codes, row = codes[there].astype(np.int64), row[there]
                names = coded.dictionary.to_pylist()
                size = max(1, len(names))
                occurrences = np.bincount(codes, minlength=size)
                present = np.bincount(np.unique(row * size + codes) % size, minlength=size)
                for name, n, m in zip(names, occurrences.tolist(), present.tolist(), strict=False):
                    if n:
                        counts = local.setdefault((f, name), [0, 0])
                        counts[0] += n
                        counts[1] += m
            if len(local) >= most_local:
                yield flush()
        if local:
            yield flush()

    return rows.select(F.spark_partition_id().cast("bigint").alias("block"), *[F.col(f"`{f}`").alias(f) for f in fields]).mapInArrow(run, BLOCKS)


def dictionary(blocks: DataFrame, partitions: int | None = None) -> DataFrame:
    """field, term, term_id: every distinct (field, term), numbered without gaps in the order of (field, term)."""
    partitions = partitions or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = blocks.select("field", "term").distinct().repartitionByRange(partitions, "field", "term").sortWithinPartitions("field", "term")
    ranked = distinct.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    made = cut(ranked, "dictionary")
    sizes = made.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return made.join(starts, "_part").select("field", "term", (F.col("_start") + F.col("_at")).alias("term_id"))


def count_arrays(blocks: DataFrame, terms: DataFrame, range_size: int) -> DataFrame:
    """block, range, ids, occurrences, n_rows: the count arrays of each block over each identifier range."""
    encoded = blocks.join(terms, ["field", "term"]).withColumn("range", F.floor(F.col("term_id") / range_size).cast("bigint"))
    entry = F.sort_array(F.collect_list(F.struct("term_id", "occurrences", "n_rows")))
    packed = encoded.groupBy("block", "range").agg(entry.alias("_e"))
    return packed.select("block", "range", F.col("_e.term_id").alias("ids"), F.col("_e.occurrences").alias("occurrences"), F.col("_e.n_rows").alias("n_rows"))


def sum_ranges(arrays: DataFrame, range_size: int, salts: int = 16) -> DataFrame:
    """term_id, occurrences, n_rows over all blocks, in two levels.

    First the arrays of a range from every ``salts``-th block are added up, as a stream into one dense array; then the
    sums of a range, at most ``salts`` of them whatever the number of blocks, are added up likewise.
    """
    salted = arrays.withColumn("salt", F.pmod("block", F.lit(salts)))
    first = salted.repartition("range", "salt").sortWithinPartitions("range", "salt").mapInArrow(_adder(range_size, ["range", "salt"]), SUMS)
    second = first.repartition("range").sortWithinPartitions("range").mapInArrow(_adder(range_size, ["range"]), SUMS)
    entries = F.arrays_zip("ids", "occurrences", "n_rows")
    return second.select(F.explode(entries).alias("e")).select(F.col("e.ids").alias("term_id"), "e.occurrences", "e.n_rows")


def _adder(range_size: int, keys: list[str]):
    """Adds up the arrays of consecutive rows with equal ``keys`` and gives one row of arrays for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((2, range_size), dtype=np.int64)

        def flush() -> pa.RecordBatch:
            ids = np.flatnonzero(sums[0])
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids + at[0] * range_size, sums[0][ids], sums[1][ids])]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[-1]], pa.int64()), *lists], names=["range", "salt", "ids", "occurrences", "n_rows"])

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            columns = [batch.column(c) for c in ("ids", "occurrences", "n_rows")]
            for i, k in enumerate(marks):
                if k != at:
                    if at is not None:
                        yield flush()
                    at = k
                    sums[:] = 0
                ids, occurrences, present = (c[i].values.to_numpy() for c in columns)
                np.add.at(sums[0], ids - k[0] * range_size, occurrences)
                np.add.at(sums[1], ids - k[0] * range_size, present)
        if at is not None:
            yield flush()

    return run


def term_frequencies(rows: DataFrame, fields: list[str], range_size: int = 4096) -> DataFrame:
    """field, term, term_id, occurrences, n_rows for every distinct term of the array columns ``fields``."""
    blocks = cut(block_counts(rows, fields), "blocks")
    terms = cut(dictionary(blocks), "terms")
    sums = sum_ranges(count_arrays(blocks, terms, range_size), range_size)
    return terms.join(sums, "term_id").select("field", "term", "term_id", "occurrences", "n_rows")


def with_mark(frequencies: DataFrame, all_rows: int, most_rare: int = 2, common_share: float = 0.25) -> DataFrame:
    """Adds ``mark``: rare (in at most ``most_rare`` rows), common (in more than ``common_share`` of all rows), else kept.

    A term that is both, which only a table of a few rows can have, is marked rare.
    """
    rare = F.when(F.col("n_rows") <= most_rare, "rare").when(F.col("n_rows") > F.lit(common_share) * F.lit(all_rows), "common")
    return frequencies.withColumn("mark", rare.otherwise("kept"))
