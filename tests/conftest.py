import itertools
import os
import sys
from collections import defaultdict

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Six transactions: items : transaction utility : utilities.
SIX = """2 6 9:17:3 9 5
4 6 9 11:26:7 4 8 7
2 4 5 11:19:2 9 6 2
5 9:13:1 12
2 4 6 9 11:33:8 3 6 11 5
4 5 6:16:5 5 6
"""


def six_cells():
    lines = [line.split(":") for line in SIX.splitlines()]
    return [(t, int(i), int(u)) for t, (items, _, utils) in enumerate(lines) for i, u in zip(items.split(), utils.split())]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def six(spark, tmp_path_factory):
    """The six transactions, read from text."""
    import basketyield as by

    path = tmp_path_factory.mktemp("data") / "six.txt"
    path.write_text(SIX)
    return by.read_utility_transactions(spark, str(path))


def brute_force(cells, min_util):
    """Utility of every subset of every transaction, without any pruning."""
    transactions = defaultdict(lambda: defaultdict(int))
    for tid, item, utility in cells:
        transactions[tid][item] += utility
    totals = defaultdict(int)
    for held in transactions.values():
        for size in range(1, len(held) + 1):
            for itemset in itertools.combinations(sorted(held), size):
                totals[itemset] += sum(held[i] for i in itemset)
    return {k: v for k, v in totals.items() if v >= min_util}


def as_dict(itemsets):
    rows = itemsets.collect()
    found = {tuple(r["itemset"]): r["utility"] for r in rows}
    assert len(found) == len(rows)
    assert all(r["size"] == len(r["itemset"]) for r in rows)
    return found


class Plain:
    """The steps of the search in plain Python, one transaction after the other."""

    def __init__(self, cells, min_util):
        self.min_util = min_util
        self.rows = defaultdict(dict)
        for tid, item, utility in cells:
            self.rows[tid][item] = self.rows[tid].get(item, 0) + utility
        self.twu = defaultdict(int)
        for held in self.rows.values():
            for item in held:
                self.twu[item] += sum(held.values())
        self.order = sorted((i for i in self.twu if self.twu[i] >= min_util), key=lambda i: (self.twu[i], i))
        rank = {item: n for n, item in enumerate(self.order, 1)}
        ranked = ({rank[i]: u for i, u in held.items() if i in rank} for held in self.rows.values())
        self.revised = [dict(sorted(row.items())) for row in ranked if row]

    def root_su(self):
        return [sum(u for row in self.revised if z in row for y, u in row.items() if y >= z) for z in range(1, len(self.order) + 1)]

    def candidates(self, subtree_pruning, trim):
        """Nodes that the search scores; without ``trim`` dropped items still count in the local utility."""
        found = []

        def below(prefix, rows):
            lu, su = defaultdict(int), defaultdict(int)
            for full, row, own in rows:
                follows = sum(row.values()) if trim else sum(u for y, u in full.items() if not prefix or y > prefix[-1])
                for z in row:
                    lu[z] += own + follows
                    su[z] += own + sum(u for y, u in row.items() if y >= z)
            kept = {z for z in lu if lu[z] >= self.min_util or not (prefix or trim)}
            for e in sorted(z for z in kept if not subtree_pruning or su[z] >= self.min_util):
                found.append((*prefix, e))
                left = [(full, {z: u for z, u in row.items() if z > e and z in kept}, own + row[e]) for full, row, own in rows if e in row]
                below((*prefix, e), left)

        below((), [(row, row, 0) for row in self.revised])
        return found
