from collections import Counter

import pytest

from quern.llm.terms import block_counts, term_frequencies, with_mark

ROWS = [(["a", "b", "a", None], ["x"], 1), (None, [], 2), (["a"], None, 3), ([None], ["x", "x", "y"], 4), (["a", ""], ["a"], 5), (["a", ""], ["a"], 5), (["t" * 100_000], ["x"], 6)]
SCHEMA = "cats array<string>, tmps array<string>, term_id int"


def brute(rows):
    occ, rec = Counter(), Counter()
    for cats, tmps, _ in rows:
        for f, names in (("cats", cats), ("tmps", tmps)):
            there = [t for t in names or [] if t is not None]
            occ.update((f, t) for t in there)
            rec.update({(f, t) for t in there})
    return {k: (occ[k], rec[k]) for k in occ}


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_counts_and_identifiers(spark, size):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = term_frequencies(rows, ["cats", "tmps"], range_size=size).collect()
    assert {(r.field, r.term): (r.occurrences, r.n_rows) for r in got} == brute(ROWS)
    assert [r.term_id for r in sorted(got, key=lambda r: (r.field, r.term))] == list(range(len(got)))


def test_blocks_that_start_anew_add_up(spark):
    rows = spark.createDataFrame(ROWS * 5, SCHEMA).coalesce(1)
    sums = Counter()
    for r in block_counts(rows, ["cats", "tmps"], most_local=1).collect():
        sums[(r.field, r.term)] += r.n_rows
    assert sums == Counter({k: v[1] for k, v in brute(ROWS * 5).items()})


def test_many_blocks_of_one_range(spark):
    rows = spark.createDataFrame(ROWS * 20, SCHEMA).repartition(70)
    got = term_frequencies(rows, ["cats", "tmps"], range_size=3).collect()
    assert {(r.field, r.term): (r.occurrences, r.n_rows) for r in got} == brute(ROWS * 20)


def test_marks_and_empty_table(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    marks = {(r.field, r.term): r.mark for r in with_mark(term_frequencies(rows, ["cats", "tmps"]), len(ROWS)).collect()}
    assert marks[("cats", "a")] == "common" and marks[("cats", "b")] == "rare" and marks[("tmps", "x")] == "common" and marks[("cats", "")] == "rare"
    assert term_frequencies(rows.where("false"), ["cats", "tmps"]).count() == 0
