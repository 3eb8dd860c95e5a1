import random
import re
from collections import Counter

import numpy as np

from basketyield.llm import lexical_search as s

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    """Every document scored for every item."""
    found = [(i, TERM.findall(lowered(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, terms in found for t in set(terms))
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, terms in found:
            tf, m = Counter(terms), 100 - 25 + (25 * len(terms) * n_docs) // max(n_terms, 1)
            score = sum(
                s.weight(n_docs, df[t]) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in TERM.findall(lowered(text)) if tf[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return out


def corpus(rng, n):
    words = [f"w{k}" for k in range(300)] + ["Ünder", "ÜNDER", "naïve", "x1", "A", "don't", "日本"]
    rows = []
    for k in range(n):
        weights = [1 / (i + 1) for i in range(len(words))]
        text = " ".join(rng.choices(words, weights, k=rng.choice((1, 3, 20, 80))))
        rows.append((k, rng.choice((text, text.upper(), text.replace(" ", "-")))))
    rows += [(n + k, rows[3][1]) for k in range(60)]  # copies, ties
    return rows + [(5, None), (6, ""), (7, " \n"), (8, "..."), (None, rows[3][1]), (9, rows[9][1]), (9, rows[9][1])]


def listed(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_against_all_documents(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_DOCS", 64)
    rng = random.Random(4)
    docs = corpus(rng, 400)
    items = [(k, " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.choice((1, 5, 30))))) for k in range(12)]
    items += [(20, None), (21, ""), (22, "neverseen"), (23, docs[3][1]), (23, docs[3][1]), (None, "w1 w2"), (24, "W1 w1 w1-w1 ünder")]
    table = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, terms string, n long, tf string").repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, no int")
    # null and empty texts of one id are one item
    want = sorted(brute(docs, items, 7), key=str)
    assert listed(s.search(table, asked, k=7)) == want
    assert listed(s.search(table, asked, k=7, item_block=5)) == want


def test_pruning_drops_nothing_and_saves_work():
    rng = np.random.default_rng(6)
    n, v, k = 3000, 400, 20
    rows = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % v) for _ in range(n)]
    rows += [rows[5]] * 100
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms, tf = np.concatenate(rows), rng.integers(1, 5, ends[-1])
    m = rng.integers(75, 400, len(rows))
    tree = s.Tree(list(range(len(rows))), m, ends, terms, tf)
    gains = s.gain(tf, np.repeat(m, np.diff(ends)))
    visited = 0
    for _ in range(30):
        weights = np.zeros(v, dtype=np.int64)
        weights[rng.choice(v, 12, replace=False)] = rng.integers(0, 9000, 12)
        held = []
        visited += tree.search(weights, held, k)
        scores = np.add.reduceat(weights[terms] * gains, ends[:-1])
        want = sorted(((int(x), -i) for i, x in enumerate(scores) if x > 0), reverse=True)[:k]
        assert sorted(held, reverse=True) == want
    assert visited < 0.7 * 30 * len(rows)


def test_long_text_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 50_000), (2, "alpha"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta")], "item_id long, text string")
    assert listed(s.search(docs, items)) == sorted(brute([(1, "alpha beta " * 50_000), (2, "alpha"), (3, None)], [(1, "Alpha"), (2, "beta")], 20), key=str)
    assert listed(s.search(docs.limit(0), items)) == []
    assert listed(s.search(docs, items.limit(0))) == []
