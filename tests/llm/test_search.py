"""Nearest neighbours, connected components and the pipeline."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from basketyield.llm import ann, simhash_dedup
from basketyield.llm.components import components
from basketyield.stage import Stage

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
EMBEDDINGS = "vec_id long, embedding array<float>, label int, leaf string, v string"


def brute_nearest(rows, is_query, k):
    """Every query against every row."""
    table = {}
    for vec_id, v in rows:
        table.setdefault(vec_id, []).append(np.array(v, dtype=np.float64))
    out = {}
    for q in table:
        if is_query(q):
            scored = [(-max(float((a * b).sum()) for a in table[q] for b in vs), i) for i, vs in table.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.4 * rng.normal(size=d)]) for i in range(n)]


def test_all_leaves_give_the_exact_answer(spark):
    rows = vectors(600, 8, 1)
    rows += [(1000 + i, [8 * x for x in rows[0][1]]) for i in range(30)]  # copies tie, the smaller ids win
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], EMBEDDINGS)
    got = ann.nearest(frame, "vec_id % 20 = 0", k=20, trees=2, depth=3, probes=16).orderBy("query_id", "rank").collect()
    expected = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    for q, best in expected.items():
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], [s for _, s in best], rtol=0, atol=1e-12)
        if q == 0:
            assert [r.vec_id for r in mine] == list(range(1000, 1020))
        assert len({r.vec_id for r in mine}) == 20 and q not in {r.vec_id for r in mine}


def test_blocks_of_a_full_leaf_change_nothing(spark, monkeypatch):
    rows = vectors(400, 8, 2) + [(900 + i, [1.0] * 8) for i in range(100)]
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], EMBEDDINGS)
    answers = []
    for size in (10**6, 16):
        monkeypatch.setattr(ann, "BLOCK_ROWS", size)
        answers.append(sorted(tuple(r) for r in ann.nearest(frame, "vec_id % 50 = 0", 5, trees=3, depth=3, probes=6).collect()))
    assert answers[0] == answers[1]


def test_queue_visits_leaves_in_order_of_the_least_boundary():
    sample = np.random.default_rng(3).normal(size=(500, 6))
    forest = ann.Forest.fit(sample, float(np.linalg.norm(sample, axis=1).max()), trees=3, depth=4)
    query = sample[7]
    found = forest.search(query, 3 * 16)
    assert sorted(found) == [(t, leaf) for t in range(3) for leaf in range(16)]
    point = np.append(query / np.linalg.norm(query) * forest.norm, 0.0)

    def crossed(tree, leaf):
        node, worst = leaf + 15, -np.inf
        while node:
            parent = (node - 1) // 2
            margin = forest.direction[tree, parent] @ point - forest.split[tree, parent]
            worst = max(worst, margin if node == 2 * parent + 1 else -margin)
            node = parent
        return worst

    costs = [crossed(t, leaf) for t, leaf in found]
    assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:]))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, []), (8, [2.0, 1.0]), (9, [2.0, 1.0]), (9, [2.0, 1.0])]
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], EMBEDDINGS)
    got = ann.nearest(frame, "vec_id % 2 = 0", 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 8, 4.0), (0, 2, 9, 4.0), (8, 1, 9, 5.0), (8, 2, 0, 4.0)]
    assert ann.nearest(frame.where("vec_id = 0")).count() == 0
    assert ann.nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 15, 21, 40])
def test_small_tables_are_answered_whole(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(n)]
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], EMBEDDINGS)
    got = ann.nearest(frame, "vec_id % 5 = 0").orderBy("query_id", "rank").collect()
    for q, best in brute_nearest(rows, lambda i: i % 5 == 0, 20).items():
        assert [r.vec_id for r in got if r.query_id == q] == [i for i, _ in best]


def test_search_goes_on_until_enough_rows_are_met():
    sample = np.random.default_rng(4).normal(size=(200, 6))
    forest = ann.Forest.fit(sample, float(np.linalg.norm(sample, axis=1).max()), trees=2, depth=6)
    held = np.stack([np.bincount(leaves, minlength=64) for leaves in forest.leaves(sample[:40]).T])
    found = forest.search(sample[3], 4, held, 21)
    assert all(held[tree, leaf] for tree, leaf in found)
    assert max(sum(held[t, leaf] for t, leaf in found if t == tree) for tree in range(2)) >= 21


def test_blocks_of_a_leaf_that_many_ask(spark, monkeypatch):
    rows = vectors(300, 8, 6) + [(900 + i, [1.0] * 8) for i in range(100)]
    rows += [(7, [2.0] * 8)]  # an id with two vectors
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], EMBEDDINGS)
    rerank, sizes, answers = ann._rerank, spark.sparkContext.accumulator(0), []
    for size in (10**6, 8):
        monkeypatch.setattr(ann, "ASKED_ROWS", size)
        if size == 8:

            def spied(k):
                inner = rerank(k)

                def run(asked, entries):
                    if asked.num_rows > 40 or len({tuple(q) for q in asked.column("q").to_pylist()}) < asked.num_rows:
                        sizes.add(1)
                    return inner(asked, entries)

                return run

            monkeypatch.setattr(ann, "_rerank", spied)
        answers.append(sorted(tuple(r) for r in ann.nearest(frame, "vec_id % 1 = 0", 5, trees=2, depth=2, probes=8).collect()))
    assert answers[0] == answers[1] and sizes.value == 0
    expected = {(q, i) for q, best in brute_nearest(rows, lambda i: True, 5).items() for i, _ in best}
    assert {(q, i) for q, _, i, _ in answers[0]} == expected


@needs_tables
def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 20 == 0, 20)
    assert np.mean([len(got[q] & {i for i, _ in best}) / 20 for q, best in expected.items()]) >= 0.9


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(260)]
    pairs += [(7, 7), (5, 6), (6, 5)]
    root = {n: n for p in pairs for n in p}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    got = components(spark.createDataFrame(pairs, "a long, b long"), Stage(spark)).collect()
    assert {(r.node, r.component) for r in got} == {(n, top(n)) for n in root if top(n) != n}
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark)).count() == 0


# --- the pipeline -----------------------------------------------------------------------------


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_take_any_rows(spark, docs, no_docs, null_ids, stage, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, step = stage
    for frame in (docs, no_docs, null_ids):
        out = step(spark, frame, str(tmp_path))
        assert out.count() <= frame.count() or name == "packing"
        if name != "packing":
            assert out.columns == frame.columns


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage, frames = Stage(spark), {}
    for name, step in corpus_pipeline.STAGES:
        frames[name] = docs = stage.write(step(spark, docs, SF), name)
    kept = {r.doc_id for r in frames["quality"].collect()}
    assert np.mean([i in kept for i, r in labels.items() if r.quality == 1]) > 0.9
    assert np.mean([i in kept for i, r in labels.items() if r.quality == 0]) < 0.2
    clean = {r.doc_id for r in frames["toxicity"].collect()}
    judged = [r for i, r in labels.items() if i in kept]
    assert np.mean([r.doc_id in clean for r in judged if r.toxic == 0]) > 0.95
    assert np.mean([r.doc_id in clean for r in judged if r.toxic == 1] or [0]) < 0.5
    before = frames["toxicity"].select("doc_id", "text").collect()
    smallest = {}
    for r in before:
        smallest[r.text] = min(smallest.get(r.text, r.doc_id), r.doc_id)
    one = {r.doc_id for r in frames["near_dedup"].collect()}
    assert one <= set(smallest.values())
    texts = {r.doc_id: r.text for r in before}
    for i in set(smallest.values()) - one:
        assert max(simhash_dedup.similarity(texts[i], t, 5) for k, t in texts.items() if k != i and t != texts[i]) >= 0.8
    redacted = {r.doc_id: r for r in frames["pii"].collect()}
    assert redacted.keys() == one
    from basketyield.llm.pii import base_spans

    for r in frames["near_dedup"].collect():
        new = redacted[r.doc_id]
        assert not base_spans(new.text) and new.n_chars == len(new.text)
        assert new.text == r.text or "[" in new.text
    assert {r.doc_id for r in frames["packing"].collect()} == one
    assert frames["packing"].columns[:3] == ["doc_id", "piece", "start"]
