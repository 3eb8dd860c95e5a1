import pytest
from pyspark.sql import functions as F

import basketyield as by
from basketyield import model
from basketyield.operators import bounds, transactions
from basketyield.operators.ranking import global_row_number
from tests.conftest import Plain, six_cells


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# By hand: the utilities of the transactions that hold the item, added up.
TWU = [(2, 69), (4, 94), (5, 48), (6, 92), (9, 89), (11, 78)]


def test_twu_of_both_forms(six):
    assert pairs(by.item_twu(six), "item", "twu") == TWU
    cells = by.explode_transactions(six)
    assert pairs(by.item_twu(cells), "item", "twu", "support") == pairs(by.item_twu(six), "item", "twu", "support")
    assert pairs(by.promising_items(cells, 78), "item") == [(4,), (6,), (9,), (11,)]
    assert by.max_item(six).first()["max_item"] == 11
    profile = by.db_profile(six).first().asDict()
    assert profile == {"n_transactions": 6, "n_items": 6, "max_item": 11, "total_utility": 124}


@pytest.mark.parametrize("min_util", [30, 69, 80, 93])
def test_before_the_search(six, min_util):
    plain = Plain(six_cells(), min_util)
    dictionary = by.item_rank(by.item_twu(six), min_util)
    assert [i for _, i in pairs(dictionary, "rk", "item")] == plain.order
    revised = by.revise_transactions(six, dictionary, len(plain.order))
    root = by.root_subtree_utility(revised)
    su = plain.root_su()
    assert [u for _, u in pairs(root, "rk", "su")] == su
    assert pairs(by.root_subtree_utility(by.to_array_form(revised)), "rk", "su") == pairs(root, "rk", "su")
    assert [k for k, in pairs(by.primary_items(root, min_util), "rk")] == [k for k, u in enumerate(su, 1) if u >= min_util]


def test_reverse_lex_order(six):
    revised = by.revise_transactions(six, by.item_rank(by.item_twu(six), 30))
    ordered = by.reverse_lex_order(by.to_array_form(revised)).orderBy("pos").collect()
    rows = [(list(row), list(row.values())) for row in Plain(six_cells(), 30).revised]
    expected = sorted(rows, key=lambda r: [-i for i in reversed(r[0])])
    assert [(r["items"], r["utils"]) for r in ordered] == expected
    assert [r["pos"] for r in ordered] == [1, 2, 3, 4, 5, 6]


def test_ties_and_large_dictionaries_rank_alike(spark, monkeypatch):
    cells = by.from_local(spark, [(t, i, 1 + i % 3) for t in range(40) for i in range(60) if (t + i) % 7])
    twu = by.item_twu(cells)
    expected = pairs(by.item_rank(twu), "rk", "item", "twu")
    assert expected == sorted((n + 1, i, w) for n, (w, i) in enumerate(sorted((w, i) for _, i, w in expected)))
    monkeypatch.setattr(bounds, "SMALL_DICTIONARY", 3)
    assert pairs(by.item_rank(twu), "rk", "item", "twu") == expected
    dictionary = by.item_rank(twu)
    assert by.revise_transactions(cells, dictionary, 60).count() == cells.count()


def test_suffix_sums_across_blocks(spark, monkeypatch):
    revised = spark.createDataFrame(
        [(t, f"i{k}", k, t + k) for t in range(3) for k in range(1, 50) if (t + k) % 4], "tid int, item string, rk long, utility long"
    )
    expected = pairs(by.suffix_utilities(revised, max_rank=49), "tid", "rk", "sfx")
    for t, k, sfx in expected:
        assert sfx == sum(t + j for j in range(k, 50) if (t + j) % 4)
    monkeypatch.setattr(bounds, "BLOCK", 8)
    assert pairs(by.suffix_utilities(revised), "tid", "rk", "sfx") == expected
    assert pairs(by.root_subtree_utility(revised), "rk") == [(k,) for k in range(1, 50)]


def test_emptied_transactions(spark):
    cells = by.from_local(spark, [(1, 1, 50), (2, 2, 1), (3, 2, 1), (3, 1, 2)])
    revised = by.revise_transactions(cells, by.item_rank(by.item_twu(cells), 10))
    assert pairs(by.emptied_transactions(cells, revised), "tid") == [(2,)]
    assert pairs(by.emptied_transactions(by.to_transactions(cells), revised), "tid") == [(2,)]


def test_from_table(spark):
    raw = [(1, 5, 2.0), (1, 5, 3.0), (1, 6, 0.0), (2, 5, -1.0), (2, 6, 1.5), (None, 6, 1.0), (3, None, 1.0), (3, 1, None)]
    df = spark.createDataFrame(raw, "t int, i int, u double")
    good = spark.createDataFrame(raw[:3], df.schema)
    assert pairs(by.from_table(good, "t", "i", "u"), "tid", "item", "utility") == [(1, 5, 5), (1, 6, 0)]
    assert by.from_table(good, "t", F.col("i"), "u", unique=True).count() == 3
    with pytest.raises(Exception, match="whole number"):
        by.from_table(df, "t", "i", "u").collect()
    assert by.from_table(df, "t", "i", "u", on_invalid="quarantine").count() == 2
    assert by.from_table(df, "t", "i", "u", on_invalid="only").count() == 5
    with pytest.raises(ValueError):
        by.from_table(df, "t", "i", "u", on_invalid="ignore")


def test_first_transactions(spark, monkeypatch):
    cells = by.from_local(spark, [(t, i, 1) for t in range(10) for i in range(3)])
    assert {r["tid"] for r in by.first_transactions(cells, 4).collect()} == {0, 1, 2, 3}
    assert by.first_transactions(cells, 0).count() == 30
    monkeypatch.setattr(transactions, "SMALL_LIMIT", 2)
    assert {r["tid"] for r in by.first_transactions(cells, 4).collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("bad", [0, -1, 1.5, "3", True, None])
def test_threshold_must_be_positive(six, bad):
    with pytest.raises(ValueError):
        by.promising_items(six, bad)
    with pytest.raises(ValueError):
        by.mine(six, bad)


def test_global_row_number(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(5)
    got = global_row_number(df, ["k"], "n", by.Stage(spark)).collect()
    assert all(r["n"] == r["k"] + 1 for r in got) and len(got) == 1000


def test_partitions_grow_with_the_cells(spark, monkeypatch):
    # Before, as many as spark.sql.shuffle.partitions, so that a task held more and more cells.
    monkeypatch.setattr(model, "PARTITION_ROWS", 40)
    rows = [(t, i, 1) for t in range(50) for i in range(4)] * 2
    table = spark.createDataFrame(rows, "t bigint, i bigint, u bigint")
    cells = by.from_table(table, "t", "i", "u")
    assert cells.rdd.getNumPartitions() == 10
    assert by.from_table(table, "t", "i", "u", rows=800).rdd.getNumPartitions() == 20
    assert by.from_table(table, "t", "i", "u", rows=80).rdd.getNumPartitions() == 3
    assert pairs(cells, "tid", "item", "utility") == [(t, i, 2) for t in range(50) for i in range(4)]
    assert pairs(by.item_twu(cells, 200), "item", "twu", "support") == [(i, 400, 50) for i in range(4)]
    revised = by.revise_transactions(cells, by.item_rank(by.item_twu(cells)), 4)
    arrays = by.to_array_form(revised, 200)
    assert arrays.rdd.getNumPartitions() == 5
    assert pairs(arrays, "tid", "items", "utils") == [(t, [1, 2, 3, 4], [2] * 4) for t in range(50)]


def test_a_search_asks_for_partitions_by_its_cells(spark, monkeypatch):
    asked = []
    frame = type(spark.range(1))
    inner = frame.repartition
    monkeypatch.setattr(model, "PARTITION_ROWS", 10)
    monkeypatch.setattr(frame, "repartition", lambda df, n, *keys: asked.append((n, keys)) or inner(df, n, *keys))
    repeated = spark.createDataFrame([(t, i, 1) for t in range(50) for i in range(4)] * 2, "tid bigint, item bigint, utility bigint")
    found = by.mine_high_utility_itemsets(repeated, 100)
    assert found.count() == 15
    assert asked[:3] == [(40, ("tid", "item")), (40, ("tid",)), (40, ("tid",))]
    asked.clear()
    arrays = model.to_transactions(by.from_table(repeated, "tid", "item", "utility"))
    assert by.mine_high_utility_itemsets(arrays, 100).count() == 15
    assert asked[:2] == [(40, ("tid", "item")), (20, ("tid",))]
