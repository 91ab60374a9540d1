import random

import pytest

from quern.llm.mixing import Mix, finish_line

TARGETS = [("big_one", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 5), ("zero", 0.0, 1), ("absent", 0.1, 2)]


def sized(spark):
    random.seed(5)
    rows = [(i, random.choice(["big_one", "Big One", " BIG-ONE"]), random.randint(1, 40)) for i in range(2000)]
    rows += [(5000 + i, "small", random.randint(1, 40)) for i in range(300)] + [(7000 + i, "TINY", random.randint(1, 40)) for i in range(100)]
    rows += [(9000, "untargeted", 50), (9001, None, 50), (9002, "small", 0), (9003, "small", None), (None, "small", 5)]
    return spark.createDataFrame([(*r, i * 7919 % 2503, i) for i, r in enumerate(rows)], "id bigint, source string, n_tokens bigint, slot bigint, row bigint").repartition(3)


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("budget", [None, 3000])
def test_shares_repeats_and_budget(spark, budget):
    mix = Mix(sized(spark), targets(spark), budget)
    rows = mix.selection().collect()
    total = sum(r.n_tokens for r in rows)
    assert mix.budget - 40 < total <= mix.budget and (budget is None or mix.budget == budget)
    filled = mix.filled().first()
    assert (filled.tokens, filled.unfilled) == (total, mix.budget - total) and (filled.crossing is None or filled.crossing > filled.unfilled)
    share = {s: sum(r.n_tokens for r in rows if r.source == s) / total for s in ("big_one", "small", "tiny")}
    whole = 0.5 + 0.3 + 0.2
    assert all(abs(share[s] - w / whole) < 0.03 for s, w in (("big_one", 0.5), ("small", 0.3), ("tiny", 0.2)))
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.id), set()).add(r.use)
    assert all(len(u) == max(u) + 1 and len(u) <= {"big_one": 1, "small": 3, "tiny": 5}[s] for (s, _), u in uses.items())
    upto = 0
    for r in sorted(rows, key=lambda r: r.upto):
        upto += r.n_tokens
        assert r.upto == upto
    report = {r.source: r for r in mix.shares(mix.selection()).collect()}
    assert set(report) == {"big_one", "small", "tiny", "absent"} and report["absent"].tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_a_larger_budget_uses_up_the_scarce_sources(spark):
    mix = Mix(sized(spark), targets(spark), 10**9)
    rows = mix.selection().collect()
    for s, most in (("big_one", 1), ("small", 3), ("tiny", 5)):
        assert sum(r.n_tokens for r in rows if r.source == s) == most * mix.available[s.replace("_", "")]


def test_many_repeats_are_not_made_before_they_are_needed(spark):
    """A cap of a billion uses costs no more rows than the budget has room for."""
    rows = spark.createDataFrame([(1, "a", 10, 1, 1), (2, "b", 10, 2, 2)], "id bigint, source string, n_tokens bigint, slot bigint, row bigint")
    mix = Mix(rows, targets(spark, [("a", 0.5, 10**9), ("b", 0.5, 1)]), 100)
    assert sorted((r.source, r.use) for r in mix.selection().collect()) == [("a", u) for u in range(9)] + [("b", 0)]


def test_the_shuffle_does_not_depend_on_files(spark):
    a, b = sized(spark), sized(spark).coalesce(1)
    assert sorted((r.source, r.id or 0, r.use) for r in Mix(a, targets(spark), 3000).selection().collect()) == sorted((r.source, r.id or 0, r.use) for r in Mix(b, targets(spark), 3000).selection().collect())


def test_finish_line():
    assert finish_line({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, None) == (40.0, 40)
    assert finish_line({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 60) == (80.0, 60)
    assert finish_line({}, {"a": 1.0}, {"a": 1}, 5) == (0.0, 0)


def test_empty_tables(spark):
    assert Mix(sized(spark).where("false"), targets(spark)).selection().count() == 0
    assert Mix(sized(spark), targets(spark, [])).selection().count() == 0
