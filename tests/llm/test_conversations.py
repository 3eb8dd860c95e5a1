import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from basketyield.llm import conversations as c

SF = "/root/testdata/sf0.001"


def best_repair(initials, faults):
    """Cost and audit by the best way to every row and state, one row after the other."""
    best = {c.START: (0, "")}

    def with_inserts(held):
        for _ in range(4):
            for q, (cost, audit) in list(held.items()):
                way = (cost + 3, audit + "I")
                held[c.MADE[q]] = min(held.get(c.MADE[q], way), way)
        return held

    for initial, fault in zip(initials, faults, strict=True):
        after = {}
        for q, (cost, audit) in with_inserts(best).items():
            ways = [(q, 4, "D")]
            if fault not in "bd":
                more = 3 * (fault == "t")
                ways.append((c.MADE[q], 3 + more, "R"))
                ways += [(r, more, "K") for (p, i), r in c.KEPT.items() if (p, i) == (q, initial)]
            for r, step, letter in ways:
                way = (cost + step, audit + letter)
                after[r] = min(after.get(r, way), way)
        best = after
    ends = with_inserts(best)
    return min(ends[q] for q in (c.START, c.ASSISTANT) if q in ends)


def cases():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("bt.", repeat=n):
                yield "".join(initials), "".join(faults)
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(4, 30)
        yield "".join(rng.choices("suax", (1, 6, 6, 1), k=n)), "".join(rng.choices("bdt.", (1, 1, 2, 6), k=n))


def test_search_finds_the_cheapest_and_least():
    for initials, faults in cases():
        assert c.repair_of(initials, faults) == best_repair(initials, faults), (initials, faults)


def test_every_repair_reads_as_it_should():
    for initials, faults in cases():
        _, audit = c.repair_of(initials, faults)
        turns = "".join(role[0] if role else initials[row] for row, _, _, role in c.edited(audit, initials))
        rest = turns.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and (turns == "" or rest)


def repaired(rows, **options):
    reports, turns = c.repair(rows, **options)
    out = c.digests(reports, turns)
    order = sorted(out.columns)
    return sorted(tuple(r[x] for x in order) for r in out.collect()), turns


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeats, one long conversation, one that is nothing but copies, and columns with clashing names."""
    rng = random.Random(7)
    roles, texts = ("user", "assistant", "system", "tool", "", None), ("Yes.", "No", "", " \t", None, "Why?", "x" * 3000 + ".")
    rows = [(7, k // 3 if k % 11 else None, rng.choice(roles[:3]), rng.choice(texts)) for k in range(300)]
    rows += [(8, None, "user", "Again.")] * 90
    rows += [(k % 9 + 20, rng.randrange(5), rng.choice(roles), rng.choice(texts)) for k in range(60)]
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (40, 1, None, None), (41, None, None, "a.")]
    rows += [(50, 3, "assistant", f"{k}.") for k in range(40)] + [(51, k, "system", f"{k}.") for k in range(40)]
    columns = "conv_id long, turn long, role string, text string, pos string, block string, fault string, present string"
    return spark.createDataFrame([(*r, "x", "x", "x", None) for r in rows], columns).repartition(5)


@pytest.mark.parametrize("damaged", [True, False])
def test_blocks_give_what_one_go_gives(odd, damaged):
    rows = c.damage(odd) if damaged else c.undamaged(odd)
    whole, turns = repaired(rows)
    kinds = {r["conv_id"]: 0 for r in turns.collect()}
    assert len(whole) == odd.select("conv_id").distinct().count() and kinds
    for max_rows, fan in ((3, 2), (16, 4)):
        assert repaired(rows, max_rows=max_rows, fan=fan)[0] == whole


def test_report_of_a_small_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 4, "user", "So"), (1, None, "tool", " ")]
    reports, turns = c.repair(c.undamaged(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    (report,) = c.digests(reports, turns).collect()
    # blank, s, u, again, truncated: an assistant's turn costs 6 as a new role of the truncated one, 3 as an insert after its deletion
    assert report["audit"] == "DKKDR" and report["cost"] == 14
    assert (report["gaps"], report["blank"], report["duplicate"], report["truncated"], report["illegal"]) == (2, 1, 1, 1, 3)
    said = "system:Be kind.\nuser:Hi?\nassistant:So"
    assert report["repaired_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_empty_table(odd):
    assert repaired(c.damage(odd.limit(0)))[0] == []
    assert repaired(c.damage(odd.where("conv_id = 41").withColumn("turn", F.lit(None).cast("long"))))[0]


def test_nothing_left(spark):
    rows = spark.createDataFrame([(5, 1, "user", "x."), (5, 2, "user", "y.")], "conv_id long, turn long, role string, text string")
    reports, turns = c.repair(c.undamaged(rows).withColumn("present", F.lit(False)))
    (report,) = c.digests(reports, turns).collect()
    assert (report["cost"], report["audit"], report["gaps"]) == (0, "", 0)
    assert report["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    reports, turns = c.repair(c.undamaged(rows).withColumn("present", F.lit(False)), max_rows=1)
    assert c.digests(reports, turns).collect() == [report]
