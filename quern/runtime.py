"""Building blocks that several operators share: written cut points, exact hot keys, distributed running totals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CUTS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or what setCheckpointDir named.

    Where neither is set, a local session gets a temporary folder, which is then the session's; on a cluster, whose
    machines share no such folder, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = named.get() if named.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all machines of the cluster share")
        made = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under the shared one; ``drop_cuts`` and ``scope`` remove it."""
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    _CUTS.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    The table is columnar, so later readers only fetch the columns they use. It is there until the ``scope`` in which
    it was made ends, or else the interpreter.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(since: int = 0) -> None:
    """Remove the written tables, stream folders included, but for the first ``since`` that are still there."""
    while len(_CUTS) > since:
        spark, path = _CUTS.pop()
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the JVM may be gone at exit
            return


@contextmanager
def scope() -> Iterator[None]:
    """Whatever is written inside is removed at the end: make a query *and* use its rows in one scope."""
    before = len(_CUTS)
    try:
        yield
    finally:
        drop_cuts(before)


atexit.register(drop_cuts)


def hot_keys(rows: DataFrame, key: list[str], max_hot: int = 2000, min_rows: int = 1000) -> DataFrame:
    """Every key with more than max(min_rows, rows / max_hot) rows, with its exact row count ``n_rows``.

    Partial counts are made before the shuffle, so a hot key moves one row per map task. There can be at most
    ``max_hot`` such keys whatever the data are, which is the bound that makes broadcasting the result safe. The
    number of all rows comes from the same counts (Spark reuses their exchange), so ``rows`` is read once, and the
    keys are written, so it is not read again.
    """
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = counted.agg(F.sum("n_rows").alias("n_rows")).where(F.col("n_rows").isNotNull()).withColumn("_all", F.lit(True))
    made = cut(counted.where(F.col("n_rows") > min_rows).withColumn("_all", F.lit(False)).unionByName(whole, allowMissingColumns=True), "hot")
    total = made.where("_all").agg(F.max("n_rows")).first()[0] or 0
    return made.where(~F.col("_all") & (F.col("n_rows") > total // max_hot)).drop("_all")


def salts_for(n_rows: Column, rows_per_salt: int) -> Column:
    return F.ceil(n_rows / F.lit(rows_per_salt)).cast("int")


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Running sum of the bigint column ``value`` per ``group`` in ``order``, without putting a group into one task.

    The rows are range-partitioned by (group, order), summed within each partition by numpy, written once, and
    shifted by the totals of the partitions before. Null values count as 0. ``order`` should be unique within a
    group: rows that tie on it stay in one partition and get their sums in an arbitrary order.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    ranged = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn(value, F.coalesce(F.col(f"`{value}`").cast("bigint"), F.lit(0)))
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])
    gcols = list(group)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for c in gcols:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(c)[0].as_py() for c in gcols)
            if first != last:
                carry = 0
            values = batch.column(value).to_numpy(zero_copy_only=False)
            total = np.cumsum(values)
            starts = np.flatnonzero(change)
            base = np.zeros(n, dtype=np.int64)
            base[: starts[0] if len(starts) else n] = -carry
            for i, s in enumerate(starts):
                base[s : starts[i + 1] if i + 1 < len(starts) else n] = total[s - 1]
            sums = total - base
            last, carry = tuple(batch.column(c)[n - 1].as_py() for c in gcols), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "_local"])

    made = cut(ranged.mapInArrow(local, schema), "running")
    sums = made.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), shift)
    cond = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_part") == F.col("_p")]
    joined = made.join(offsets, cond, "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_local") + F.col("_before")).alias(out))


def previous(rows: DataFrame, group: list[str], order: list[str], columns: list[str], hot_rows: int = 2_000_000, max_hot: int = 2000, partitions: int | None = None) -> DataFrame:
    """Adds ``prev_<column>``: the values of the row before in the order of its group, null for the first row.

    Groups of more than ``hot_rows`` rows (or total / max_hot, whichever is more) are cut into ranges of their order,
    looked at range by range, and joined at the seams with the last row of the range before. All other groups take
    one window. ``order`` should be unique in a group. A null group is a group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    plain = lambda df: df.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})
    hot = hot_keys(rows, group, max_hot, hot_rows).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    if hot.isEmpty():
        return plain(rows)
    is_hot = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    cold = plain(rows.join(F.broadcast(hot), is_hot, "left_anti"))
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.join(F.broadcast(hot), is_hot, "left_semi").repartitionByRange(partitions, *group, *order).withColumn("_part", F.spark_partition_id())
    made = cut(ranged, "ranged")
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    inner = made.withColumns({f"prev_{c}": F.lag(c).over(inside) for c in columns}).withColumn("_rn", F.row_number().over(inside))
    ends = made.groupBy("_part", *group).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    up = Window.partitionBy(*group).orderBy("_part")  # one row per range
    seams = ends.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.lag("_last").over(up).alias("_before"))
    joined = inner.join(seams, [F.col("_part") == F.col("_p"), *is_hot], "left")
    values = [F.when(F.col("_rn") == 1, F.col("_before")[c]).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in columns]
    return cold.unionByName(joined.select(*[F.col(f"`{c}`") for c in rows.columns], *values))
