import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import basketyield as by
from basketyield.operators import bounds, projection
from basketyield.plans import miner, subtree
from basketyield.stage import Stage
from tests.conftest import Plain, as_dict, brute_force, six_cells

WIDE = {"trim_secondary": False}
PLAIN = {"trim_secondary": False, "subtree_pruning": False}


@pytest.mark.parametrize(
    ("min_util", "options"),
    [
        (20, {**WIDE, "strategy": "subtree"}),
        (20, {**PLAIN, "strategy": "subtree"}),
        (30, WIDE),
        (30, PLAIN),
        (30, {}),
        (43, WIDE),
        (90, PLAIN),
    ],
)
def test_six_transactions(six, min_util, options):
    result = by.mine(six, min_util, **options)
    assert as_dict(result.itemsets) == brute_force(six_cells(), min_util)
    # tasks that finish sub-trees trim in any case
    trim = options.get("trim_secondary", True) or options.get("strategy") == "subtree"
    plain = Plain(six_cells(), min_util).candidates(options.get("subtree_pruning", True), trim)
    if not trim or options == {}:
        assert sorted(tuple(r["prefix"]) for r in result.nodes.collect()) == sorted(plain)
    else:
        assert set(plain) <= {tuple(r["prefix"]) for r in result.nodes.collect()}


def test_stats(six):
    result = by.mine(six, 30, trim_secondary=False)
    stats = [tuple(r) for r in by.mining_stats(result).collect()]
    scored, found = Plain(six_cells(), 30).candidates(True, False), brute_force(six_cells(), 30)
    sizes = range(1, max(map(len, scored)) + 1)
    assert [r[:3] for r in stats] == [(k, sum(len(c) == k for c in scored), sum(len(f) == k for f in found)) for k in sizes]
    assert all(len(r) == 4 for r in stats)
    result.discard()


@pytest.mark.parametrize("options", [{}, {"merging": False}, {"subtree_pruning": False}])
def test_counters_do_not_depend_on_the_strategy(spark, options):
    cells = [(t, i, u) for t, i, u in cells_of(3, transactions=80, items=6, longest=5)]
    found = []
    for more in ({}, {"strategy": "subtree"}, {"strategy": "subtree", "max_group_cells": 30}, {"strategy": "subtree", "max_task_work": 600}):
        result = by.mine(by.from_local(spark, cells), 120, counters=True, **options, **more)
        found.append([tuple(r) for r in by.mining_stats(result).collect()])
    assert all(f == found[0] for f in found)
    assert any(r[5] for r in found[0]) == options.get("merging", True)
    assert found[0][-1][4] == 0  # the last level has no rows


@pytest.mark.parametrize(
    "cells",
    [[(1, 5, 10), (1, 6, -8), (2, 5, 3)], [(1, 5, None), (1, 6, 2)], [(None, 5, 1)], [(1, None, 1)]],
)
def test_bad_cells_fail(spark, cells):
    df = spark.createDataFrame(cells, "tid long, item long, utility long")
    with pytest.raises(Exception, match="whole number"):
        by.mine(df, 6)


@pytest.mark.parametrize("items, utils", [([5, 6], [1, -1]), ([5, 6], [1]), ([5, 5], [1, 2]), ([5, None], [1, 2]), (None, [1]), ([5], [None])])
def test_bad_arrays_fail(spark, items, utils):
    df = spark.createDataFrame([(1, items, utils, 3)], "tid long, items array<long>, utils array<long>, tu long")
    with pytest.raises(Exception, match="different items"):
        by.mine(df, 1)


def test_raw_cells_are_summed(spark):
    cells = [(1, 5, 3.0), (1, 5, 4.0), (2, 6, 1.0)]
    df = spark.createDataFrame(cells, "tid long, item long, utility double")
    assert as_dict(by.mine_high_utility_itemsets(df, 7)) == {(5,): 7}


def test_totals_of_array_rows_are_not_trusted(spark):
    df = spark.createDataFrame([(1, [5, 6], [2, 3], 0)], "tid long, items array<long>, utils array<long>, tu long")
    assert as_dict(by.mine_high_utility_itemsets(df, 5)) == {(5, 6): 5}


def tables(root):
    return {os.path.relpath(p, root) for p, d, files in os.walk(root) if any(f.endswith(".parquet") for f in files)}


def test_tables_of_a_run(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    cells = by.from_local(spark, cells_of(4))
    before = tables(root)
    itemsets = by.mine_high_utility_itemsets(cells, 150)
    assert {os.path.basename(t) for t in tables(root) - before} == {"itemsets"}
    itemsets.collect()
    before = tables(root)
    result = by.mine(cells, 150, counters=True)
    left = {os.path.basename(t).rstrip("0123456789") for t in tables(root) - before}
    assert left <= {"promising", "nodes_", "counted_"} and "nodes_0" not in {os.path.basename(t) for t in tables(root) - before}
    result.discard()
    assert tables(root) == before
    with pytest.raises(Exception, match="whole number"):
        by.mine(spark.createDataFrame([(1, 2, -1)], "tid long, item long, utility long"), 1)
    assert tables(root) == before


def cells_of(seed, transactions=60, items=9, longest=7):
    rng = random.Random(seed)
    return [
        (t, i, rng.randint(1, 20))
        for t in range(transactions)
        for i in rng.sample(range(items), rng.randint(1, longest))
    ]


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"merging": False},
        {"subtree_pruning": False},
        {"trim_secondary": False, "merging": False},
        {"strategy": "subtree"},
        {"strategy": "subtree", "max_group_cells": 20},
        {"strategy": "subtree", "max_task_work": 1},
        {"strategy": "subtree", "merging": False, "subtree_pruning": False, "max_group_cells": 60},
    ],
)
def test_flags_do_not_change_the_result(spark, options):
    cells = cells_of(1)
    # Item 0 and unsorted, repartitioned input included.
    df = by.from_local(spark, cells).repartition(7, "utility")
    result = by.mine(df, 150, **options)
    assert as_dict(result.itemsets) == brute_force(cells, 150)
    if not options:
        assert result.nodes.count() <= by.mine(df, 150, subtree_pruning=False).nodes.count()


def test_a_task_hands_back_what_it_has_no_time_for(spark):
    cells = cells_of(5, transactions=40)
    rows = by.root_projection(by.to_array_form(by.revise_transactions(df := by.from_local(spark, cells), by.item_rank(by.item_twu(df)))))
    options = {"merging": True, "subtree_pruning": False}
    whole = subtree.finish_subtrees(rows, 1, **options).collect()
    want = {tuple(r["prefix"]): (r["utility"], r["n"]) for r in whole if r["utility"] is not None}
    assert not any(r["items"] for r in whole)
    found, rounds = {}, 0
    while rows.count():
        done = subtree.finish_subtrees(rows, 1, work=1, **options).checkpoint()
        got = {tuple(r["prefix"]): (r["utility"], r["n"]) for r in done.where("utility is not null").collect()}
        rounds += 1
        # one node a call: its children, and no candidate twice
        assert {len(p) for p in got} == {rounds} and not set(got) & set(found)
        found |= got
        rows = done.where("items is not null").select(*subtree.ROW)
    assert found == want and rounds == max(map(len, want))


@pytest.mark.parametrize("listed", [0, 128])
def test_paths_for_large_sizes(spark, monkeypatch, listed):
    """Shuffled node sets, range-ranked items, split rows, chunked merging, and sets of ranks as lists or with a directory."""
    cells = cells_of(2, transactions=30, items=30, longest=9)
    monkeypatch.setattr(miner, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(bounds, "SMALL_DICTIONARY", 0)
    monkeypatch.setattr(projection, "LONG_ROW", 3)
    monkeypatch.setattr(projection, "CHUNK", 2)
    monkeypatch.setattr(projection, "WIDE_CHUNK", 3)
    monkeypatch.setattr(projection, "SPARSE", -1)
    monkeypatch.setattr(projection, "LISTED", -1 if listed == 0 else listed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert as_dict(by.mine(by.from_local(spark, cells), 60).itemsets) == brute_force(cells, 60)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_item_and_hot_transaction(spark):
    cells = [(t, 7, 3) for t in range(3000)] + [(5, i, 2) for i in range(100, 112)] + [(t, 100, 1) for t in range(50)]
    table = spark.createDataFrame(cells * 3, "t int, i int, u int")
    found = as_dict(by.mine(by.from_table(table, "t", "i", "u"), 70).itemsets)
    summed = [(t, i, 3 * u) for t, i, u in cells]
    assert found == brute_force(summed, 70)


def test_text_items_and_wide_sums(spark):
    rows = [(1, "b", 2**33), (1, "a", 2**34), (2, "a", 1), (2, "c", 1)]
    df = spark.createDataFrame(rows, "tid long, item string, utility long")
    found = as_dict(by.mine_high_utility_itemsets(df, 2**33))
    assert found == {("a",): 2**34 + 1, ("b",): 2**33, ("a", "b"): 2**33 + 2**34}


@pytest.mark.parametrize("options", [{}, {"strategy": "subtree"}])
def test_nothing_to_find(spark, options):
    empty = by.from_local(spark, [])
    assert as_dict(by.mine_high_utility_itemsets(empty, 1, **options)) == {}
    low = by.from_local(spark, [(1, 1, 2), (2, 2, 3)])
    assert as_dict(by.mine_high_utility_itemsets(low, 10, **options)) == {}
    assert by.mining_stats(by.mine(low, 10, **options)).count() == 0


def test_one_item(spark):
    one = by.from_local(spark, [(1, 4, 2), (2, 4, 3)])
    assert as_dict(by.mine_high_utility_itemsets(one, 5)) == {(4,): 5}


def test_bad_strategy(six):
    with pytest.raises(ValueError):
        by.mine(six, 5, strategy="depth")


small_db = st.lists(
    st.dictionaries(st.integers(0, 5), st.integers(0, 9), min_size=1, max_size=5), min_size=1, max_size=6
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(db=small_db, min_util=st.integers(1, 25), strategy=st.sampled_from(["level", "subtree"]))
def test_random_databases(spark, db, min_util, strategy):
    cells = [(t, i, u) for t, held in enumerate(db) for i, u in held.items()]
    found = as_dict(by.mine_high_utility_itemsets(by.from_local(spark, cells), min_util, strategy=strategy))
    assert found == brute_force(cells, min_util)


@pytest.mark.parametrize("options", [{}, {"merging": False}, {"subtree_pruning": False}, {"strategy": "subtree"}, {"max_group_cells": 30, "strategy": "subtree"}])
@pytest.mark.parametrize("min_util", [1, 40])
def test_children_with_one_row_are_finished_from_it(spark, monkeypatch, min_util, options):
    """A child's only row needs no further level, up to a length, and no shuffle of candidates."""
    cells = cells_of(6, transactions=40, items=60, longest=6)
    found = []
    for longest in (16, 1, -1):
        monkeypatch.setattr(miner, "LONE_ITEMS", longest)
        monkeypatch.setattr(subtree, "LONE_ITEMS", longest)
        result = by.mine(by.from_local(spark, cells), min_util, counters=True, **options)
        stats = [tuple(r) for r in by.mining_stats(result).collect()]
        nodes = {tuple(r["prefix"]): (r["utility"], r["n"]) for r in result.nodes.collect()}
        assert len(nodes) == result.nodes.count()
        found.append((stats, nodes, as_dict(result.itemsets)))
        levels = {t for t in tables(result.stage.root) if t.startswith("nodes_")}
        # only the nodes of two rows or more go through levels of their own
        assert longest != 16 or options or min_util > 1 or len(levels) < max(map(len, nodes))
        result.discard()
    assert found[0] == found[1] == found[2]
    assert found[0][2] == brute_force(cells, min_util)


def test_equal_transactions_are_one_row_from_the_start(spark):
    cells = [(t, i, i + t) for t in range(50) for i in (1, 2, 3)]
    written, write = [], Stage.write

    def counted(stage, df, name):
        table = write(stage, df, name)
        written.append((name, table.count()))
        return table

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Stage, "write", counted)
        found = as_dict(by.mine_high_utility_itemsets(by.from_local(spark, cells), 1))
    assert dict(written)["rows_0"] == 1 and found == brute_force(cells, 1)


def test_decoding_place_by_place(spark):
    dictionary = spark.createDataFrame([("c", 1), ("a", 2), ("b", 3)], "item string, rk long")
    nodes = spark.createDataFrame([([1, 3], 5), ([2], 7), ([1, 2, 3], 9)], "prefix array<int>, utility long")
    want = sorted(map(str, by.decode_itemsets(nodes, dictionary).collect()))
    short = by.decode_itemsets(nodes, dictionary, 3, 3)
    assert sorted(map(str, short.collect())) == want and len(want) == 3
    assert "hashpartitioning(prefix" not in short._jdf.queryExecution().executedPlan().toString()
