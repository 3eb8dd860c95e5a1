from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import basketyield as by
from basketyield.functions import set_has
from basketyield.operators import projection
from basketyield.operators.projection import candidate_bounds, keep_secondary, node_bounds, node_state
from basketyield.operators.transactions import to_array_form


def transactions(seed, rows, width, items):
    """``(items, utils)`` lists, some of them repeated."""
    rng = np.random.default_rng(seed)
    lists = [sorted(rng.choice(np.arange(1, items + 1), rng.integers(1, width + 1), False).tolist()) for _ in range(rows)]
    lists += lists[: rows // 2]
    return [(x, rng.integers(1, 50, len(x)).tolist()) for x in lists]


def root(spark, db, keep_dropped=False):
    df = spark.createDataFrame([(n, i, u, sum(u)) for n, (i, u) in enumerate(db)], "tid int, items array<int>, utils array<bigint>, tu bigint")
    return by.root_projection(df, keep_dropped)


def children(db):
    """Plain projections: prefix item -> [(suffix, utils, prefix utility)]."""
    out = defaultdict(list)
    for items, utils in db:
        for p, e in enumerate(items):
            out[e].append((tuple(items[p + 1 :]), utils[p + 1 :], utils[p]))
    return out


def merged(db):
    out = {}
    for e, rows in children(db).items():
        for suffix, utils, pu in rows:
            total, n, sums = out.get((e, suffix), (0, 0, [0] * len(suffix)))
            out[e, suffix] = (total + pu, n + 1, [a + b for a, b in zip(sums, utils)])
    return out


def collected(df):
    rows = df.collect()
    found = {}
    for r in rows:
        sfx = r["sfx"] + [0]
        utils = [sfx[i] - sfx[i + 1] for i in range(len(r["items"]))]
        found[r["prefix"][0], tuple(r["items"])] = (r["prefix_util"], r["n"], utils)
    return found, len(rows)


@pytest.mark.parametrize(("width", "known", "chunk"), [(6, 5, 64), (6, None, 64), (40, None, 64), (40, 39, 7)])
def test_project_and_merge(spark, monkeypatch, width, known, chunk):
    monkeypatch.setattr(projection, "WIDE_CHUNK", chunk)
    db = transactions(3, 60, width, 45)
    rows = by.project_on_items(root(spark, db), width=known)
    assert rows.count() == sum(len(i) for i, _ in db)
    expected = merged(db)
    found, n = collected(by.merge_transactions(rows, width=known))
    assert n == len(expected)
    assert found == expected


def test_long_equal_rows_merge(spark):
    items = list(range(1, 1501))
    db = [(items, [1] * 1500)] * 4 + [(items[:-1] + [1600], [2] * 1500)] + [(items[:40], [3] * 40)]
    got = by.merge_transactions(root(spark, db)).collect()
    assert sorted((len(r["items"]), r["n"], r["sfx"][0]) for r in got) == [(40, 1, 120), (1500, 1, 3000), (1500, 4, 6000)]
    assert {tuple(r["items"]) for r in got} == {tuple(i) for i, _ in db}


def test_equal_long_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(projection, "LONG_ROW", 8)
    db = [(list(range(1, 25)), [1] * 24)] * 60
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        spread = by.project_on_items(root(spark, db)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(r["count"] for r in spread) == 60 * 24 and len(spread) >= 3


def test_long_rows_are_split_by_position(spark, monkeypatch):
    db = transactions(5, 20, 40, 45)
    plain = sorted(map(str, by.project_on_items(root(spark, db, True), width=40).collect()))
    monkeypatch.setattr(projection, "LONG_ROW", 7)
    assert sorted(map(str, by.project_on_items(root(spark, db, True)).collect())) == plain


def test_bounds(spark):
    db = transactions(6, 50, 8, 12)
    lu, su, exact = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, rows in children(db).items():
        for suffix, utils, pu in rows:
            exact[e] += pu
            for i, z in enumerate(suffix):
                lu[e, z] += pu + sum(utils)
                su[e, z] += pu + sum(utils[i:])
    rows = by.project_on_items(root(spark, db))
    for frame in (rows, by.merge_transactions(rows)):
        got = {(r["prefix"][0], r["z"]): (r["lu"], r["su"]) for r in by.extension_bounds(frame).collect()}
        assert got == {k: (lu[k], su[k]) for k in lu}
        assert all(su <= lu for lu, su in got.values())
        assert {r["prefix"][0]: r["utility"] for r in by.itemset_utilities(frame).collect()} == exact


@pytest.mark.parametrize("keep_dropped", [False, True])
@pytest.mark.parametrize("width", [40, None])
def test_bounds_from_the_rows_above(spark, monkeypatch, keep_dropped, width):
    monkeypatch.setattr(projection, "LONG_ROW", 40 if width else 7)
    rows = root(spark, transactions(8, 40, 30, 45), keep_dropped)
    kept = [i for i in range(1, 46) if i % 3]
    sets = [sum(1 << i for i in items) for items in (kept, kept[::2])]
    nodes = spark.createDataFrame([([], 0, sets[:1], sets[1:], 15)], "prefix array<int>, first_word int, secondary array<bigint>, primary array<bigint>, n_primary int")
    for held in (None, nodes):
        got = candidate_bounds(rows, held, width=width)
        want = node_bounds(by.project_on_items(rows, held, width=width))
        own = [sorted(map(str, df.select(sorted(want.columns)).collect())) for df in (got, want)]
        assert own[0] and own[0] == own[1]


def test_no_array_is_cut_for_the_bounds(spark):
    """Candidates are scored without the rows that projecting would make."""
    plan = candidate_bounds(root(spark, transactions(8, 5, 5, 9)), width=5)._jdf.queryExecution().optimizedPlan().toString()
    scored = plan[: plan.index("Generate")]
    assert "slice(" not in scored and "transform(" not in scored


def held_by(bits, first):
    """The members of a set of ranks, in any of its three shapes."""
    if first is None or first == -1:
        return set(bits)
    if first < -1:
        n = bits[0]
        words = {}
        for block, (used, place) in enumerate(zip(bits[1 : n + 1], bits[n + 1 : 2 * n + 1], strict=True)):
            for k, b in enumerate([b for b in range(64) if used >> b & 1]):
                words[64 * (block - first - 2) + b] = bits[place + k]
        assert len(bits) == 1 + 2 * n + len(words)
    else:
        words = {first + i: x for i, x in enumerate(bits)}
    return {64 * w + b for w, x in words.items() for b in range(64) if x >> b & 1}


@pytest.mark.parametrize(
    ("m", "sparse", "listed"), [(1, 4, 128), (150, 4, 128), (400, 4, 128), (1, 0, 128), (150, 0, 128), (1, 0, 0), (150, 1000000, 1000000)]
)
def test_node_state(spark, monkeypatch, m, sparse, listed):
    monkeypatch.setattr(projection, "SPARSE", sparse)
    monkeypatch.setattr(projection, "LISTED", listed)
    db = transactions(7, 50, 8, 300)
    bounds = node_bounds(by.project_on_items(root(spark, db)))
    want = defaultdict(lambda: (set(), set()))
    for r in bounds.where("z > 0").collect():
        if r["lu"] >= m:
            want[r["prefix"][0]][0].add(r["z"])
        if r["su"] >= m:
            want[r["prefix"][0]][1].add(r["z"])

    for r in node_state(bounds, m).collect():
        secondary, primary = want[r["prefix"][0]]
        assert held_by(r["secondary"], r["first_word"]) == secondary
        assert held_by(r["primary"], r["first_word"]) == primary
        assert r["n_primary"] == len(primary)


@pytest.mark.parametrize("m", [1, 150, 400])
def test_nodes_know_whether_they_keep_all_items(spark, m):
    bounds = node_bounds(by.project_on_items(root(spark, transactions(7, 50, 8, 300))))
    kept = defaultdict(lambda: True)
    for r in bounds.collect():
        kept[r["prefix"][0]] &= r["z"] == 0 or r["lu"] >= m
    assert {r["prefix"][0]: r["whole"] for r in node_state(bounds, m).collect()} == kept


def test_sums_and_lists_keep_the_number_of_partitions(spark):
    """Merged partitions would hold more and more cells of a larger table."""
    lines = spark.range(60).selectExpr("id div 6 as tid", "id % 5 as item", "id as u")
    cells = by.from_table(lines, "tid", "item", "u")
    arrays = to_array_form(cells.selectExpr("tid", "item as rk", "utility"))
    for df, rows in ((cells, 50), (arrays, 10)):
        assert df.count() == rows
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize(("step", "listed"), [(20, False), (700, False), (4097, False), (9000, True)])
def test_sets_of_far_apart_ranks(spark, step, listed):
    """10,000 ranks: no list to go through, few words a rank, and exact answers at and around every member."""
    rng = np.random.default_rng(step)
    ranks = np.unique(np.arange(10_000) * step + rng.integers(0, step, 10_000) + 50_000).tolist()
    spark.createDataFrame([(x,) for x in ranks], "z int").createOrReplaceTempView("far_apart")
    bounds = spark.sql("""
        select array(1) as prefix, z, 9L as lu, if(z % 2 = 0, 9L, 0L) as su, 1L as n, 1L as cells, 1 as width from far_apart
        union all select array(1), 0, 0L, 7L, 1L, 1L, 1""")
    state = node_state(bounds, 5)
    r = state.first()
    even = {x for x in ranks if x % 2 == 0}
    assert held_by(r["secondary"], r["first_word"]) == set(ranks) and held_by(r["primary"], r["first_word"]) == even
    assert (r["utility"], r["n_primary"]) == (7, len(even))
    assert (r["first_word"] == -1) == listed and len(r["secondary"]) <= 6 * len(ranks)
    if listed:
        return
    asked = sorted({x + d for x in ranks for d in (-4096, -64, -1, 0, 1, 64, 4096)} | {0, 1, 63, 64, 2**31 - 1})
    values = spark.createDataFrame([(x,) for x in asked if x >= 0], "x int")
    has = [set_has(name, "first_word", "x") for name in ("secondary", "primary")]
    got = values.crossJoin(F.broadcast(state)).selectExpr("x", f"{has[0]} as s", f"{has[1]} as p").collect()
    assert {r["x"] for r in got if r["s"]} == set(ranks) and {r["x"] for r in got if r["p"]} == even


def test_dropped_items_still_count_in_the_wide_bound(spark):
    db = [([1, 2, 3, 4], [5, 6, 7, 8])] * 3 + [([2, 4], [1, 1])]
    rows = root(spark, db, keep_dropped=True)
    # Item 3 is not secondary, so it leaves the rows but not their rest.
    nodes = spark.createDataFrame([([], 0, [0b10110], [0b00110], 2)], "prefix array<int>, first_word int, secondary array<bigint>, primary array<bigint>, n_primary int")
    got = {(tuple(r["prefix"]), tuple(r["items"])): r for r in by.merge_transactions(by.project_on_items(rows, nodes)).collect()}
    assert set(got) == {((1,), (2, 4)), ((2,), (4,))}
    first, second = got[(1,), (2, 4)], got[(2,), (4,)]
    assert (first["prefix_util"], first["sfx"], first["rest"]) == (15, [42, 24], 63)
    assert (second["prefix_util"], second["sfx"], second["rest"], second["n"]) == (19, [25], 46, 4)


def test_rows_are_cut_to_secondary_items(spark):
    db = [([1, 2, 3, 4], [5, 6, 7, 8]), ([3], [1]), ([2, 4], [1, 1])]
    nodes = spark.createDataFrame([([], 0, [0b10110], [0b00110], 2)], "prefix array<int>, first_word int, secondary array<bigint>, primary array<bigint>, n_primary int")
    rows = keep_secondary(root(spark, db), nodes)
    assert sorted((r["items"], r["sfx"]) for r in rows.collect()) == [([1, 2, 4], [19, 14, 8]), ([2, 4], [2, 1])]
    once = sorted(map(str, by.project_on_items(rows, nodes, trimmed=True).collect()))
    assert once == sorted(map(str, by.project_on_items(root(spark, db), nodes).collect()))


def test_projected_rows_as_text(spark):
    rows = by.project_on_items(root(spark, [([1, 2, 4], [5, 6, 8])]))
    got = {tuple(r["prefix"]): r["value"] for r in by.format_transactions(rows).collect()}
    assert got == {
        (1,): "2[6] 4[8]  Remaining Utility:14 Prefix Utility:5",
        (2,): "4[8]  Remaining Utility:8 Prefix Utility:6",
        (4,): " Remaining Utility:0 Prefix Utility:8",
    }
