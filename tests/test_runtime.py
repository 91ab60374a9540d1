import os
import subprocess
import sys
from itertools import accumulate

import pytest

from quern.operators.events import changed_only, step_delta
from quern.runtime import cut, hot_keys, previous, running_total, scope, shared_dir


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_totals_over_groups_and_partitions(spark, parts):
    rows = [(g, i, (i * 7) % 11 if i % 5 else None) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint").repartition(3)
    got = {(r.g, r.i): r.t for r in running_total(df, ["g"], ["i"], "v", "t", parts).collect()}
    for g in ("a", "b", None):
        mine = [(i, v or 0) for gg, i, v in rows if gg == g]
        assert [got[(g, i)] for i, _ in mine] == list(accumulate(v for _, v in mine))


def test_running_total_of_all_and_of_nothing(spark):
    df = spark.createDataFrame([(i, 1) for i in range(20)], "i int, v bigint")
    assert sorted(r.t for r in running_total(df, [], ["i"], "v", "t", 4).collect()) == list(range(1, 21))
    assert running_total(df.where("false"), [], ["i"], "v", "t", 4).count() == 0


def test_hot_keys_are_exact_and_bounded(spark):
    df = spark.createDataFrame([("h",)] * 50 + [(f"k{i}",) for i in range(50)], "k string").repartition(5)
    assert [(r.k, r.n_rows) for r in hot_keys(df, ["k"], max_hot=10, min_rows=5).collect()] == [("h", 50)]
    assert hot_keys(df, ["k"], max_hot=2, min_rows=5).count() == 0  # a key must have more than half of the rows
    assert hot_keys(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("hot", [5, 1000])
def test_rows_before_in_hot_and_cold_groups(spark, hot):
    rows = [(g, i, (i * 5) % 7 if i % 4 else None) for g, n in (("big", 60), ("small", 4), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(3)
    got = {(r.g, r.i): r.prev_v for r in previous(df, ["g"], ["i"], ["v"], hot_rows=hot, partitions=5).collect()}
    value = {(g, i): v for g, i, v in rows}
    assert got == {(g, i): value.get((g, i - 1)) for g, i, _ in rows}
    change = {(r.g, r.i) for r in changed_only(df, "g", ["i"], "v", hot).collect()}
    assert change == {k for k in value if value[k] != value.get((k[0], k[1] - 1))}
    delta = {(r.g, r.i): (r.delta, r.from_start) for r in step_delta(df.na.fill(0), "g", ["i"], "v", hot).collect() if r.g}
    assert all(d == ((value[k] or 0) - (value[(k[0], k[1] - 1)] or 0) if k[1] else None, value[k] or 0) for k, d in delta.items())


def test_scope_leaves_the_disk_empty(spark):
    base = f"{shared_dir(spark).removeprefix('file://')}/quern"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with scope():
        assert cut(spark.range(5), "scoped").count() == 5
        assert len(set(os.listdir(base)) - before) == 1
    assert set(os.listdir(base)) == before


UNSET = """
import sys
from pyspark.sql import SparkSession
from quern.runtime import cut, shared_dir
spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
try:
    found = shared_dir(spark)
    print("RESULT", found == shared_dir(spark), cut(spark.range(3), "x").count())
except RuntimeError as error:
    print("RESULT", error)
"""


def test_without_a_checkpoint_folder(tmp_path):
    """A local session gets a folder of its own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", UNSET, "local[2]"], capture_output=True, text=True, timeout=120, cwd=root, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)})
    assert "RESULT True 3" in done.stdout, done.stderr[-2000:]


def test_a_cluster_without_a_checkpoint_folder_is_an_error():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        master = "spark://a:7077"
        sparkContext = property(lambda self: self)
        getConf = lambda self: self.conf
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())
