import numpy as np

from basketyield.functions import merge_duplicate_items, set_has, strict_int, suffix_sums, utilities_of


def test_suffix_sums_and_back(spark):
    rng = np.random.default_rng(1)
    values = [[int(x) for x in rng.integers(0, 2**40, n)] for n in (0, 1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    for v, sfx, back in df.selectExpr("v", f"{suffix_sums('v')} as s").selectExpr("v", "s", utilities_of("s")).collect():
        assert sfx == [sum(v[i:]) for i in range(len(v))]
        assert back == v


def test_set_has(spark):
    members = {5, 63, 64, 127, 200}
    words = [0] * 4
    for x in members:
        words[x // 64] |= 1 << (x % 64)
    words = [w - (1 << 64) if w >= 1 << 63 else w for w in words]
    df = spark.createDataFrame([(words, words[1:], sorted(members))], "a array<bigint>, b array<bigint>, c array<bigint>")
    has = df.selectExpr(
        f"filter(sequence(0, 400), x -> {set_has('a', '0', 'x')})",
        f"filter(sequence(0, 400), x -> {set_has('b', '1', 'x')})",
        f"filter(sequence(0, 400), x -> {set_has('c', '-1', 'x')})",
    ).first()
    assert set(has[0]) == set(has[2]) == members
    assert set(has[1]) == {x for x in members if x >= 64}


def test_duplicates_and_strict_int(spark):
    df = spark.createDataFrame([([3, 1, 3], [5, 2, 7]), ([1, 2], [9, 9])], "i array<int>, u array<bigint>")
    got = [tuple(r) for r in df.selectExpr("array_distinct(i)", merge_duplicate_items("i", "u")).collect()]
    assert got == [([3, 1], [12, 2]), ([1, 2], [9, 9])]
    tokens = spark.createDataFrame([("7",), ("+7",), ("-7",), (" 7",), ("7x",), ("",), ("99999999999",)], "t string")
    assert [r[0] for r in tokens.selectExpr(strict_int("t", "int")).collect()] == [7, 7, -7, None, None, None, None]
