import random

import numpy as np
import pytest

from basketyield.llm import minhash_dedup as m


def brute_components(rows, words, percent):
    """Smallest id reachable by comparing all texts with each other."""
    sets = [m.shingle_set(text, words) for _, text in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def families(rng, n_words=4000):
    """Texts, and edits of them at the start, at the end and all over, so that many pairs are close to the limit."""
    words = [f"w{k}" for k in range(n_words)]
    rows, doc_id = [], 100
    for size in (1, 2, 3, 4, 5, 6, 9, 20, 60, 150, 400):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for change in (0, 0, 0.02, 0.05, 0.08, 0.1, 0.11, 0.12, 0.15, 0.2, 0.3):
                text = list(base)
                k = int(change * size)
                kind = rng.randrange(3)
                if kind == 0:
                    text = text[: size - k] + [rng.choice(words) for _ in range(k)]
                elif kind == 1:
                    text = [rng.choice(words) for _ in range(k)] + text
                else:
                    for at in rng.sample(range(size), k):
                        text[at] = rng.choice(words)
                rows.append((doc_id, " ".join(text).upper() if rng.random() < 0.3 else "\n".join(text)))
                doc_id += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80)])
def test_against_all_pairs(spark, words, percent):
    rows = families(random.Random(words))
    rows += [(1, None), (2, ""), (3, " \t"), (None, "a b c d e f g"), (None, "lonely text without id"), (4, "A b c d e f g"), (4, "A b c d e f g")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, node string, entry long, signature int").repartition(7)
    found = m.near_duplicates(docs, words, percent).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key)
    assert got == sorted(brute_components(rows, words, percent), key=key)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_unlike_texts_that_share_an_entry_are_all_compared(spark, monkeypatch):
    """With one entry for everything, only the comparison across components finds the pairs."""
    monkeypatch.setattr(m, "entries", lambda classes: classes.selectExpr("0L as entry", "node", "int(n_shingles) as size"))
    monkeypatch.setattr(m, "distance_limit", lambda *_: m.CHUNKS * m.CHUNK)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))) for k in range(80)]
    found = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted(brute_components(rows, 2, 80))


def test_pairs_within_the_distance_share_an_entry():
    rng = np.random.default_rng(1)
    within = m.CHUNKS * (m.ERRORS + 1) - 1
    for _ in range(300):
        one = rng.integers(0, 1 << 16, m.CHUNKS * m.CHUNK, dtype=np.uint16)
        two = one.copy()
        two[rng.choice(len(one), within, replace=False)] ^= np.uint16(1)
        a, b = m.entries_of(np.stack([one, two]))
        assert (a == b).any()


def test_bounds_of_the_signature():
    assert m.missed(0.8) < 1.2e-7 and m.missed(0.9) < 1e-12
    assert 23 <= m.distance_limit(0.8) <= 34
    hashes, rng = m.Hashes(), np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    equal = (hashes.signature(pool[:900]) == hashes.signature(pool[100:1000])).mean()
    assert abs(equal - 0.8) < 0.17
    assert not hashes.signature(pool[:0]).any()


def test_empty_table_and_very_long_text(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "lorem ipsum dolor " * 40_000
    rows = [(1, long), (2, long + "sit"), (3, "other words here")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == {1: (3, 1), 2: (4, 2), 3: (2, 3)}
