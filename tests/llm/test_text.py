"""Toxicity, quality, near-duplicates, personal data, fingerprints and sharding against brute force."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from basketyield.llm import common, fingerprints, pii, quality, sharding, simhash_dedup, toxicity
from basketyield.llm.alike import pairs_of
from basketyield.llm.common import logistic_1d
from basketyield.stage import Stage
from pyspark.sql import functions as F

# --- toxicity -------------------------------------------------------------------------


def test_isolated_words_take_linear_time():
    began = time.process_time()
    places = [(10 * i, 1.0) for i in range(100_000)]
    assert toxicity.maximal_segments(places, -0.5) == [(p, p, 1.0) for p, _ in places]
    assert time.process_time() - began < 10


def maximal_by_definition(scores):
    """Maximal segments by recursion: the best one, then left and right of it."""
    best, span = 0.0, None
    for i, j in itertools.combinations(range(len(scores) + 1), 2):
        total = sum(scores[i:j])
        if total > best + 1e-9 or (span and abs(total - best) < 1e-9 and j - i < span[1] - span[0]):
            best, span = total, (i, j)
    if not span:
        return []
    i, j = span
    right = [(a + j, b + j, s) for a, b, s in maximal_by_definition(scores[j:])]
    return maximal_by_definition(scores[:i]) + [(i, j, best)] + right


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        hits = sorted(rng.sample(range(n), rng.randint(0, n)))
        listed = [(i, rng.choice([0.7, 1.3, 2.9])) for i in hits]
        scores = [dict(listed).get(i, -0.53) for i in range(n)]
        got = toxicity.maximal_segments(listed, -0.53)
        expected = maximal_by_definition(scores)
        assert [(a, b + 1) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])


@pytest.fixture(scope="module")
def marked(spark):
    """Documents with bad words in every fifth, and their labels."""
    rng = random.Random(4)
    words = [a + b for a in "ba ke lo mi nu ra ti so".split() for b in "fel gor hat jun pim vox".split()]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if i % 5 == 0:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randint(0, len(text)), rng.choice(["vilegit", "vilegot", "grumble"]) + rng.choice(["", ".", "!"]))
        if i % 7 == 0:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 7 > 0), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learned(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels, "doc_id % 2 = 0")
    assert model.lexicon and model.drift < 0 < model.rate
    rows = toxicity.score(docs, model).collect()
    right = [(r.toxicity >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0) for r in rows]
    assert sum(right) >= 0.97 * len(right)
    for r in rows:
        for p in r.passages:
            assert re.search("vileg|grumble", r.text[p.begin : p.end].lower()) and p.expected <= toxicity.EXPECTED
            assert (p.begin == 0 or r.text[p.begin - 1] == " ") and (p.end == len(r.text) or r.text[p.end] == " ")


def test_toxicity_edge_rows(docs, no_docs, null_ids, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert len({r.toxicity for r in rows if r.doc_id in (3, 4, 9)}) == 1
    named = toxicity.score(docs, model, ("p", "q"))
    assert named.columns == [*docs.columns, "p", "q"]
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert all(r.toxicity < 1e-6 for r in toxicity.score(null_ids, toxicity.fit(null_ids, labels.limit(0))).collect())


def test_logistic_curve():
    x, y, w = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1.0]), np.ones(4)
    a, b = logistic_1d(x, y, w)
    loss = lambda a, b: float(w @ (np.logaddexp(0, a * x + b) - y * (a * x + b))) + a * a / 2
    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))
    assert logistic_1d(x, y, 0 * w)[0] == 0


# --- quality ---------------------------------------------------------------------------------


def test_quality_is_learned(marked):
    docs, labels = marked
    model = quality.fit(docs, labels, "doc_id % 2 = 0")
    rows = quality.score(docs, model).collect()
    right = [(r.quality_score >= quality.THRESHOLD) == (r.doc_id % 7 > 0) for r in rows]
    assert sum(right) >= 0.98 * len(right)


def test_weights_by_brute_force(marked):
    docs, labels = marked
    model = quality.fit(docs, labels)
    texts = ["a b a", None, "", "Kefel kefel!! 12", "one"]
    together, _ = model.weights(texts)
    for text, weight in zip(texts, together):
        grams, ends = quality.ngram_buckets([text])
        assert ends.tolist() == [3 * len((text or "").split())]
        assert math.isclose(weight, sum(model.log_ratio[g] for g in grams), abs_tol=1e-9)


def test_raw_counts_cover_every_document(marked):
    docs, _ = marked
    counted = quality._bucket_counts(docs.select("text", F.lit(False))).agg(F.sum("raw"), F.sum("target")).first()
    assert tuple(counted) == (sum(3 * len(r.text.split()) for r in docs.collect()), 0)


def test_gumbel_top_k(spark):
    rows = [(i, float(i % 4)) for i in range(2000)] + [(5, 1.0), (None, 0.0)]
    drawn = quality.resample(spark.createDataFrame(rows, "doc_id long, log_weight double"), 0.25).collect()
    assert len(drawn) == 2002 and sum(r.selected for r in drawn) == math.ceil(0.25 * 2002)
    assert min(r.gumbel_key for r in drawn if r.selected) >= max(r.gumbel_key for r in drawn if not r.selected)
    share = [np.mean([r.selected for r in drawn if r.doc_id and r.doc_id % 4 == k]) for k in range(4)]
    assert share[0] < share[1] < share[2] < share[3]
    noise = np.array([r.gumbel_key - r.log_weight for r in drawn])
    assert abs(noise.mean() - 0.577) < 0.1 and abs(noise.std() - 1.28) < 0.1


def test_rows_are_worked_out_once_before_they_are_ranked(spark):
    done = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            done.add(part.num_rows)
            yield part

    rows = spark.range(500).selectExpr("id as doc_id", "double(id % 4) as log_weight")
    drawn = quality.resample(rows.mapInArrow(run, rows.schema), 0.5)
    assert drawn.where("selected").count() == 250 and done.value == 500


def test_shapes_by_pattern():
    words = ["word", "Word,", "WORD!!", "A", "a_", "_", "", "x9", "9x,", "don't", "x́", "ê&&&", "ΣΑΣ…", "²x", "x²", "Ⅷ", "12.", "a.b", "I'", "ǅa", "%%%"]
    for word in words:
        letters = "A" if word.isupper() and len(word) > 1 else "C" if word[:1].isupper() else "a"
        assert quality.shape(word) == re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", letters, word))[:4]


def test_quality_edge_rows(docs, no_docs, null_ids, labels):
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and {r.log_weight for r in rows if r.doc_id in (3, 4, 9)} == {0.0}
    assert quality.score(no_docs, quality.fit(no_docs, labels)).count() == 0
    kept = quality.score(null_ids, quality.fit(null_ids, labels.limit(0))).where("quality_score >= 0.5")
    assert kept.count() == 4  # nothing is known, nothing is rejected


# --- SimHash near-duplicates -----------------------------------------------------------------------


def brute_fingerprint(text, words):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(20)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame(list(enumerate(signed)), "node long, fingerprint long")
    for radius, segments in ((1, 16), (2, 16), (2, 8), (3, 8)):
        got = sorted(tuple(r) for r in simhash_dedup.links(table, radius, segments).collect())
        expected = [(i, j) for i, j in itertools.combinations(range(len(signed)), 2) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= radius]
        assert got == expected


def test_near_duplicates_by_brute_force(spark, docs):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(60):
        words = base[i % 8].split()
        if i % 3:
            words[rng.randrange(len(words))] = "new"
        rows.append((100 - i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for words in (3, 5):
        got = simhash_dedup.near_duplicates(frame, words).collect()
        prints = [(r.doc_id, brute_fingerprint(r.text, words)) for r in frame.collect()]
        assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{f:016x}") for i, f in prints)
        linked = [(a, b) for (a, f), (b, g) in itertools.combinations(prints, 2) if (f ^ g).bit_count() <= 2]
        root = brute_components({i for i, _ in prints}, linked)
        assert {(r.doc_id, r.component_id) for r in got} == set(root.items())


def test_near_duplicates_edge_tables(no_docs, null_ids):
    assert simhash_dedup.near_duplicates(no_docs).count() == 0
    assert simhash_dedup.near_duplicates(null_ids).count() == 4


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written from here on, as Spark makes them from its own sizes."""
    seen, write = [], Stage.write

    def noted(self, df, name):
        seen.append(plan_of(df))
        return write(self, df, name)

    monkeypatch.setattr(Stage, "write", noted)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def uncounted_broadcasts(plans):
    """Broadcast joins but those of rows left out or kept by keys that were counted."""
    return [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and not re.search("LeftAnti|LeftSemi", line)]


def test_near_duplicates_broadcast_nothing_by_the_size_of_a_file(spark, docs, plans):
    plans.append(plan_of(simhash_dedup.near_duplicates(docs)))
    assert len(plans) > 5 and not uncounted_broadcasts(plans)


def test_keep_one_broadcasts_nothing_by_the_size_of_a_file(spark, docs, plans):
    plans.append(plan_of(simhash_dedup.keep_one(docs)))
    assert len(plans) > 20 and not uncounted_broadcasts(plans)


def test_keys_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    rows, keys = spark.range(100), spark.range(50)
    for most, broadcast in ((50, True), (49, False)):
        monkeypatch.setattr(common, "SMALL_KEYS", most)
        joined = rows.join(common.broadcast_if_small(keys), "id", "left_anti")
        assert ("BroadcastHashJoin" in plan_of(joined)) == broadcast and joined.count() == 50


def test_keep_one(spark, docs, no_docs, null_ids):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 11, 13]  # 3, 4 and 9 have no words
    assert sorted(r.text or "" for r in simhash_dedup.keep_one(null_ids).collect()) == ["", "another", "one text"]
    assert simhash_dedup.keep_one(no_docs).count() == 0
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    edited = [text[:i] + ["other"] + text[i + 1 :] for i in (5, 100, 399)]
    far = [w if i % 4 else "x" for i, w in enumerate(text)]  # many words alike, few shingles
    rows = [(i, " ".join(t), "k") for i, t in enumerate([*edited, text, [f"v{rng.randrange(10**6)}" for _ in range(400)], far])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(frame).collect()) == [0, 4, 5]


def kept_by_brute_force(rows):
    """The smallest id of each group that links of 0.8 reach."""
    linked = [(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if simhash_dedup.similarity(s, t, 5) >= 0.8]
    return sorted(set(brute_components({i for i, _ in rows}, linked).values())), linked


def test_keep_one_finds_contiguous_and_scattered_edits(spark):
    rng = random.Random(9)
    word = lambda: f"w{int(20_000 ** rng.random())}"  # noqa: E731  few frequent words, many rare ones
    rows, base_ids = [], set()
    for base in range(24):
        text = [word() for _ in range(rng.randrange(60, 400))]
        base_ids.add(len(rows))
        rows.append((len(rows), " ".join(text)))
        for aim in (0.82, 0.87, 0.93):
            more = int(len(text) * (1 / aim - 1)) - 2
            tail = int(len(text) * (1 - aim) / (1 + aim)) - 2
            swaps = set(rng.sample(range(len(text)), max(1, int(len(text) * (1 - aim) / (1 + aim) / 5))))
            copies = (text + [word() for _ in range(more)], text[:-tail] + [word() for _ in range(tail)] if tail > 0 else text[:-1])
            for copy in (*copies, [word() if i in swaps else w for i, w in enumerate(text)]):
                rows.append((len(rows), " ".join(copy)))
    expected, linked = kept_by_brute_force(rows)
    assert len(linked) > 150 and base_ids <= set(expected)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(frame).collect()) == expected


def test_keep_one_compares_texts_of_one_word_set(spark):
    rng = random.Random(10)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(40)]
    rows = []
    for _ in range(12):  # unlike each other, but with the same words
        rng.shuffle(lines)
        moved = [*lines[1:], lines[0]]
        rows += [(len(rows), "\n".join(lines)), (len(rows) + 1, "\n".join(moved))]
    expected, _ = kept_by_brute_force(rows)
    assert len(expected) == 12
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(frame).collect()) == expected


def test_texts_of_one_passage_make_no_pairs(spark):
    """A shingle that many unlike texts share in its place costs no row for each two of them."""
    rng = random.Random(11)
    rows, sets = [], []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 170)))
        hashes = np.unique(simhash_dedup.shingle_hashes(f"a passage of five words {text}", 5, 42))
        rows += [(s, i, len(hashes), 0, i, simhash_dedup.parity(hashes).tolist()) for s in (1, 2)]
        sets.append(set(hashes.tolist()))
    near = [w for w in sorted(sets[0])]
    near[:10] = range(10)  # alike: 144 or more of at most 180
    hashes = np.unique(np.array(near, dtype=np.uint64))
    rows.append((1, 60, len(hashes), 0, 60, simhash_dedup.parity(hashes).tolist()))
    entries = spark.createDataFrame(rows, "shingle long, node long, size int, place int, label long, parity array<long>")
    assert {(r.a, r.b) for r in pairs_of(entries, 0.8).collect()} == {(0, 60)}
    assert pairs_of(entries.drop("parity"), 0.8).count() > 1500


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(12)
    for size in (0, 1, 7, 100, 900, 5000):
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for changed in (0, 1, size // 9, size // 2):
            y = np.concatenate([x[changed:], rng.integers(0, 1 << 63, changed // 2, dtype=np.uint64)])
            bits = sum(int(v).bit_count() for v in (simhash_dedup.parity(x) ^ simhash_dedup.parity(y)).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y)) and (bits - len(np.setxor1d(x, y))) % 2 == 0


def test_similarity():
    assert simhash_dedup.similarity("a b c d e f", "a b c d e g", 5) == 1 / 3
    assert simhash_dedup.similarity(None, " ", 5) == simhash_dedup.similarity("A b", "a  b", 5) == 1.0
    assert simhash_dedup.similarity("a", "", 5) == 0.0


# --- personal data -------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            valid = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if valid:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(2)
    for alphabet, most in (("a1.@-+ ()%_é5\n", 30), ("0123456789 -.+(", 60), ("0.", 25)):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))
            assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    n = len(pii.TAGS)
    crf = pii.Crf(rng.normal(size=(pii.FEATURES, n)), rng.normal(size=(n, n)), rng.normal(size=n))
    sequences = [rng.integers(0, pii.FEATURES, (size, pii.N_FEATURES)) for size in (1, 3, 4, 2)]
    for ids, tags in zip(sequences, crf.viterbi(sequences)):
        emit = crf.emit[ids].sum(axis=1)
        total = lambda path: crf.begin[path[0]] + sum(emit[t, q] for t, q in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        assert math.isclose(total(tags), max(total(p) for p in itertools.product(range(n), repeat=len(ids))))


def test_crf_spans_anywhere_in_a_long_island():
    crf = pii.train([pii.marked_example(e) for e in pii.EXAMPLES] * 4)
    spelt, texts = "ann (at) city (dot) info", []
    filler = [w for _ in range(50) for w in ("see", "item", "[12]", "today")]
    for at in range(200):
        texts.append(" ".join([*filler[:at], "contact", spelt, "soon", *filler[at:]]))
    for text, (_, found) in zip(texts, pii.find_spans(texts, crf, {})):
        start = text.index(spelt)
        assert ("email", start, start + len(spelt)) in found, start
    words = pii.islands(texts[7])[0]
    whole = pii.feature_ids([texts[7][a:b] for a, b in words], {})
    assert (pii.sequence_ids(texts[7], words, {}, part=16) == whole).all()


def test_training_raises_the_likelihood_and_finds_held_out_forms():
    crf = pii.train([pii.marked_example(e) for e in pii.EXAMPLES] * 4)
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.find_spans([text], crf, {})[0][1]]
    assert found("please write bob (at) example.org soon") == [("email", "bob (at) example.org")]
    assert found("then call (212) 555-0199 now") == [("phone", "(212) 555-0199")]
    assert found("the address 10[.]1[.]2[.]3 was new") == [("ip", "10[.]1[.]2[.]3")]
    for clean in ("see part 12 (and 3.4) there", "on 2024-05-06 he paid 1200", "no digits at all", "", None):
        assert pii.find_spans([clean], crf, {}) == [([], [])]


def test_personal_data_rows(docs, no_docs, null_ids):
    crf = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.digests(pii.find(docs, crf)).collect()}
    for r in docs.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r.text))
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[r.doc_id].spans.split(","))
    clean = pii.redact(docs, crf)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[5].endswith("call [PHONE] or mail [EMAIL]") or "[PHONE] or mail [EMAIL]" in texts[5]
    assert not any(brute_spans(t) for t in texts.values()) and texts[3] is None and texts[11] == "same text here for ties"
    assert pii.find(no_docs, pii.fit(no_docs)).count() == 0 and pii.redact(null_ids, crf).count() == 4
    assert pii.redact_text("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


# --- fingerprints --------------------------------------------------------------------------------------------


def test_edit_study(spark, docs):
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect()}, reverse=True)
    got = {r.doc_id: r for r in fingerprints.edit_study(docs).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        after = got[rows[(i + 1) % len(rows)][0]]
        alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint) and r.near_next == alike(r.fingerprint, after.fingerprint)
        assert r.fingerprint == f"{brute_pairs(spark, text):016x}"
    assert got[11].fingerprint == got[12].fingerprint and got[3].fingerprint == "0" * 16


def brute_pairs(spark, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)[:5000] if len(text) < 10000 else None
    if words is None:  # the long text repeats three words
        words = text.split()[:300]
    values = [(w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)]
    if not values:
        return 0
    hashes = [r.h & (1 << 64) - 1 for r in spark.createDataFrame(values, "a string, b string").selectExpr("xxhash64(a, b) h").collect()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_edit_study_edge_tables(no_docs, null_ids, docs):
    assert fingerprints.edit_study(no_docs).count() == 0
    assert fingerprints.edit_study(null_ids).count() == 3
    (only,) = fingerprints.edit_study(docs.where("doc_id = 5")).collect()
    assert only.near_next == 1.0


def test_near_fingerprints(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(10)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(15)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    for radius, blocks in ((2, 4), (3, 5), (3, 6)):
        got = sorted(tuple(r) for r in fingerprints.near_fingerprints(table, radius, blocks).collect())
        assert got == [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]


# --- sharding ----------------------------------------------------------------------------------------------------


def brute_shards(rows, limit):
    """Split a bucket on its next bit until it fits."""
    out = {}

    def split(bucket, prefix):
        if sum(n for _, n, _ in bucket) <= limit or len(bucket) == 1:
            out.update({key: prefix for key, _, _ in bucket})
            return
        for bit in "01":
            if part := [r for r in bucket if r[2][len(prefix)] == bit]:
                split(part, prefix + bit)

    split([(k, n, f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}") for k, n in rows], "")
    return out


@pytest.mark.parametrize("limit", [50, 700, 20_000, 10**9])
def test_shards_by_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = [(i * 7, rng.choice([0, 1, 10, 40, 60, 900])) for i in range(500)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "k long, n long"), "k", F.col("n"), limit).collect()
    assert {r.k: r["shard"] for r in got} == brute_shards(rows, limit)
    for shard, group in itertools.groupby(sorted(got, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        group = list(group)
        size = sum(r.n_bytes for r in group)
        assert {(r.depth, r.shard_bytes, r.shard_rows) for r in group} == {(len(shard), size, len(group))}
        assert size <= limit or len(group) == 1


def test_one_key_over_the_limit_is_split(spark):
    rows = [("hot", 10)] * 300 + [("cold", 10), (None, 10), (None, None)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "k string, n long").repartition(3), "k", F.col("n"), 100).collect()
    assert len(got) == 303 and all(r.shard_bytes <= 100 for r in got) and max(r.depth for r in got) > sharding.KEY_BITS


def test_written_shards(spark, docs, no_docs, tmp_path):
    one = docs.dropDuplicates(["doc_id"])
    sharding.write_shards(one, "doc_id", F.octet_length("text"), str(tmp_path / "s"), 100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in one.collect())
    assert sharding.assign_shards(no_docs, "doc_id", F.octet_length("text")).count() == 0


def test_batches_of_long_texts_stay_small(spark):
    # Before, only their rows were bounded: all 20 texts came in one batch.
    from basketyield.llm import common

    names = [f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    held = [spark.conf.get(name) for name in names]

    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], names=["n", "size"])

    try:
        common.small_batches(spark)
        texts = spark.range(0, 20, 1, 1).select("id", F.expr("repeat('x', 1000000)").alias("text"))
        seen = texts.mapInArrow(run, "n long, size long").collect()
        assert sum(r["n"] for r in seen) == 20
        assert max(r["size"] for r in seen) <= common.BATCH_BYTES + 1_100_000
        spark.conf.set(names[1], "64k")
        common.small_batches(spark)
        assert spark.conf.get(names[1]) == "64k"
    finally:
        for name, value in zip(names, held, strict=True):
            spark.conf.set(name, value)


def test_pairs_of_long_texts_are_compared_whole(spark):
    from basketyield.llm.simhash_dedup import similar_pairs

    long = [" ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(2990)), " ".join(f"v{i}" for i in range(3000))]
    texts = spark.createDataFrame(list(enumerate([*long, ""])), "node long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3)], "a long, b long")
    assert [tuple(r) for r in similar_pairs(pairs, texts, 5, 0.8).collect()] == [(0, 1)]
    assert similar_pairs(pairs.where("a > 5"), texts, 5, 0.8).collect() == []
