import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quern.llm.packing import fill, first_fit_decreasing, pack
from quern.llm.sizes import TOKENIZERS, VOCABULARY, with_tokens


def slow_first_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= sizes[i]
        out[i] = at
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    assert first_fit_decreasing(sizes, 50) == slow_first_fit(sizes, 50)


def test_too_large_an_item_is_an_error():
    with pytest.raises(ValueError):
        first_fit_decreasing([5], 4)


def test_whole_texts_in_containers(spark):
    random.seed(3)
    rows = [(i, random.choice([0, 3, 64, 65, 200, None, random.randint(1, 90)]), i) for i in range(300)] + [(None, 7, 900), (5, 9, 901)]
    sized = spark.createDataFrame(rows, "id bigint, n_tokens bigint, slot bigint").withColumn("row", F.col("slot"))
    packs = spark.createDataFrame([("s", 64), ("l", 150), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    got = pack(sized, packs, group_items=100).collect()
    for name, capacity in (("s", 64), ("l", 150)):
        mine = [r for r in got if r.pack_name == name]
        bins = {}
        for r in mine:
            bins[r.container] = bins.get(r.container, 0) + r.tokens
        assert max(bins.values()) <= capacity and sum(bins.values()) == sum(n or 0 for _, n, _ in rows)
        for i in range(300):
            if i != 5:
                parts = sorted((r.start_token, r.tokens) for r in mine if r.id == i)
                n = rows[i][1] or 0
                assert len(parts) == max(1, -(-n // capacity)) and sum(t for _, t in parts) == n and parts[0][0] == 0
    report = {r.pack_name: r for r in fill(pack(sized, packs, group_items=10_000)).collect()}
    assert set(report) == {"s", "l"} and all(r.containers <= 1.25 * r.least_containers + 1 for r in report.values())


def test_rows_that_are_the_same_have_containers_of_their_own(spark):
    rows = spark.createDataFrame([(1, 64, 5, k) for k in range(4)] + [(1, 10, 6, 9), (1, 10, 6, 10)], "id bigint, n_tokens bigint, slot bigint, row bigint")
    packs = spark.createDataFrame([("s", 32)], "pack_name string, capacity_tokens int")
    sums = {}
    for r in pack(rows, packs).collect():
        sums[r.container] = sums.get(r.container, 0) + r.tokens
    assert sorted(sums.values()) == [20] + [32] * 8


def test_empty_table(spark):
    packs = spark.createDataFrame([("s", 64)], "pack_name string, capacity_tokens int")
    assert pack(spark.createDataFrame([], "id bigint, n_tokens bigint, slot bigint, row bigint"), packs).count() == 0
    some = spark.createDataFrame([(1, 5, 1, 1, "clash")], "id bigint, n_tokens bigint, slot bigint, row bigint, capacity string")
    assert pack(some, packs.where("false")).count() == 0 and pack(some, packs).count() == 1


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/{VOCABULARY}"), reason="no vocabulary files here")
def test_token_counts(spark):
    from quern.llm.sizes import encoder

    rows = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "x " * 50_000), (5, "<|endoftext|>")], "id int, text string")
    got = {r.id: r.n_tokens for r in with_tokens(rows, "text", ["id"]).collect()}
    exact = encoder(f"{TOKENIZERS}/{VOCABULARY}").encode_ordinary
    assert got == {1: 2, 2: 0, 3: 0, 4: len(exact("x " * 50_000)), 5: len(exact("<|endoftext|>"))} and got[5] > 1
