import pytest

import basketyield as by
from basketyield import stage as stage_module
from tests.conftest import brute_force


@pytest.fixture(scope="module")
def itemsets(spark):
    rows = [([2], 1, 9), ([10], 1, 7), ([2, 3], 2, 8), ([1, 10], 2, 6), ([1, 2, 3], 3, 5)]
    return spark.createDataFrame(rows, "itemset array<int>, size int, utility bigint")


def test_report(itemsets):
    got = [tuple(r) for r in by.itemset_report(itemsets).orderBy("pattern").collect()]
    assert [(p, i) for p, _, i, _ in got] == [(0, [2]), (1, [10]), (2, [1, 10]), (3, [2, 3]), (4, [1, 2, 3])]


def test_level_counts(itemsets):
    assert {r["size"]: r["n"] for r in by.itemset_level_counts(itemsets).collect()} == {1: 2, 2: 2, 3: 1, None: 5}


def test_without_item(itemsets):
    got = {tuple(r["itemset"]): r["rest"] for r in by.without_item(itemsets, 2).collect()}
    assert got == {(2,): [], (2, 3): [3], (1, 2, 3): [1, 3]}


def test_text(spark, itemsets, tmp_path):
    path = str(tmp_path / "out")
    by.write_itemsets_text(itemsets, path)
    lines = {r["value"] for r in by.read_lines(spark, path).collect()}
    assert lines == {"2 #UTIL: 9", "10 #UTIL: 7", "2 3 #UTIL: 8", "1 10 #UTIL: 6", "1 2 3 #UTIL: 5"}


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage_module.stage_folder(Session())


def test_folder_comes_from_the_session(spark):
    assert by.Stage(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_brute_force_itself():
    cells = [(1, 1, 2), (1, 2, 3), (2, 2, 1)]
    assert brute_force(cells, 1) == {(1,): 2, (2,): 4, (1, 2): 5}
