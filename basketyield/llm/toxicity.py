"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words in lower case without punctuation at their ends, and word
starts of four and five letters, which also know a new word of a known stem.
The log-odds of a token between toxic and clean text have an informative
Dirichlet prior, the token's share of all text; a token enters the lexicon if
they exceed zero by ``MIN_Z`` standard deviations, with one deviation taken
off.  All other tokens share one score, the log-odds of not being listed,
which is negative, so a text drifts down and toxic passages stand out.

One pass from left to right finds all maximal segments of a text (each is the
best of its surroundings and none can be extended).  Their scores follow an
extreme-value law: with ``lambda`` from the score distribution of clean text
and ``K`` from clean documents, a text of ``n`` words has ``K n exp(-lambda
S)`` segments of score ``S`` or more by chance.  The evidence of a document is
the sum of ``lambda S - log(K n)`` over its significant segments, and a logistic
curve through the labelled documents turns it into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_ROWS, batches, distinct_texts, labelled_sample, logistic_1d, schema_with, with_labels

PRIOR = 10_000.0
MIN_Z = 2.0
MIN_LOG_ODDS = 1.0
#: Tokens in a lexicon at most, the most significant ones; a bound of the model, not of the texts.
LEXICON = 65_536
#: Different words that a token must follow in toxic text, of 64 classes: a word of one passage, however often copied, is no sign.
MIN_CONTEXTS = 5
THRESHOLD = 0.3
#: A segment counts if fewer than this many are expected by chance.
EXPECTED = 0.05
HELD_TOKENS = 200_000
_EDGES = ".,;:!?\"'()[]{}<>*_~#$%&|/\\-+=«»“”„‘’¿¡…"
_EULER = 0.5772156649
_COUNTS = pa.schema([("token", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("contexts", pa.int64())])
_EVIDENCE = pa.schema([("label", pa.int32()), ("n_words", pa.int64()), ("segments", pa.list_(pa.float64()))])


def tokens_of(word: str) -> list[str]:
    """The token of a lower-case word, then its longer and shorter start."""
    bare = word.strip(_EDGES)
    if len(bare) < 2:
        return [bare] if bare else []
    return [bare] + [bare[:n] + "*" for n in (5, 4) if len(bare) > n]


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a text, in linear time.

    ``scores`` has the places of the listed words with their (positive)
    scores; every other word scores ``drift`` < 0.
    """
    out: list[tuple[int, int, float]] = []
    # first, last, total before, total after, the last one before it with a lower total before
    held: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for place, score in scores:
        before = total + drift * (place - at)
        total, at = before + score, place + 1
        first, last, low, high = place, place, before, total
        j = len(held) - 1
        # join with those before it while the sum over all of them is a new maximum
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0:  # nothing that follows can join with those before it
                out += [(f, e, h - g) for f, e, g, h, _ in held]
                held.clear()
                break
            if held[j][3] >= high:
                break
            first, _, low, _, before_it = held[j]
            del held[j:]
            j = before_it
        held.append((first, last, low, high, j))
    return out + [(f, e, h - g) for f, e, g, h, _ in held]


@dataclass
class Model:
    lexicon: dict[str, float]
    drift: float
    rate: float  # lambda
    log_k: float
    slope: float
    intercept: float

    def __post_init__(self):
        self._held: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "_held": {}}

    def word_score(self, word: str) -> float:
        lexicon = self.lexicon
        return next((lexicon[t] for t in tokens_of(word) if t in lexicon), 0.0)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments in words."""
        words = (text or "").lower().split()
        held, hits = self._held, []
        for i, word in enumerate(words):
            score = held.get(word)
            if score is None:
                score = self.word_score(word)
                if len(held) >= HELD_TOKENS:
                    held.clear()
                held[word] = score
            if score:
                hits.append((i, score))
        return len(words), maximal_segments(hits, self.drift) if hits else []

    def excess(self, n_words: int, score: float) -> float:
        """Minus the logarithm of the number of such segments expected by chance."""
        return self.rate * score - self.log_k - math.log(max(n_words, 1))

    def evidence(self, n_words: int, scores) -> float:
        least = -math.log(EXPECTED)
        return sum(e for s in scores if (e := self.excess(n_words, s)) > least)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.intercept))))


def token_counts(labelled: DataFrame) -> DataFrame:
    """``token, toxic, clean, contexts`` of ``label, text``; the empty token has the numbers of words.

    ``contexts`` has a bit for each of 64 classes of words before the token in toxic text.
    """

    def run(parts):
        def rows():
            counted, follows = (Counter(), Counter()), {}

            def settle():
                tokens: dict[str, list[int]] = {}
                for label, counter in enumerate(counted):
                    for word, n in counter.items():
                        for token in ["", *tokens_of(word)]:
                            held = tokens.setdefault(token, [0, 0, 0])
                            held[label] += n
                            held[2] |= follows.get(word, 0)
                    counter.clear()
                follows.clear()
                for token, (clean, toxic, contexts) in tokens.items():
                    yield token, toxic, clean, contexts - (1 << 64) if contexts >> 63 else contexts

            for part in parts:
                for label, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = (text.as_py() or "").lower().split()
                    counted[label].update(words)
                    before = 0
                    for word in words if label else ():
                        follows[word] = follows.get(word, 0) | 1 << (before & 63)
                        before = zlib.crc32(word.encode())
                    if len(counted[0]) + len(counted[1]) > HELD_TOKENS:
                        yield from settle()
            yield from settle()

        yield from batches(_COUNTS, rows(), max_rows=16_384)

    partial = labelled.select("label", "text").mapInArrow(run, "token string, toxic long, clean long, contexts long")
    return partial.groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("contexts")).alias("contexts")
    )


def _rate(share: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    excess = lambda r: float(share @ np.exp(np.minimum(r * score, 700))) - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, where: str = "true", max_rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of ``labels(doc_id, toxic)`` that satisfy ``where``.

    Fitted on about ``max_rows`` labelled rows at most and one of each
    different text among them.  Without labels of both kinds, no text is toxic.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = distinct_texts(docs, labelled_sample(labels, "toxic", max_rows, where)).cache()
    try:
        labelled = with_labels(docs, sample, "inner")
        counts = token_counts(labelled).cache()
        totals = counts.where("token = ''").first()
        if totals is None or not totals["toxic"] or not totals["clean"]:
            return Model({}, -1.0, 1.0, 0.0, 0.0, -20.0)
        n_t, n_c = totals["toxic"], totals["clean"]
        # in doubles: the quotient of two decimals has six digits, and a rare word in much text would count as none
        a = f"({PRIOR}D * (toxic + clean) / {n_t + n_c}D)"
        odds = (
            f"ln((toxic + {a}) / ({n_t} + {PRIOR}D - toxic - {a})) - ln((clean + {a}) / ({n_c} + {PRIOR}D - clean - {a}))"
        )
        listed = (
            counts.where(f"token <> '' and toxic > 0 and contexts >= {MIN_CONTEXTS}")
            .selectExpr("token", "toxic", "clean", f"{odds} as odds", f"sqrt(1 / (toxic + {a}) + 1 / (clean + {a})) as sd")
            .where(f"odds > {MIN_LOG_ODDS} and odds > {MIN_Z} * sd")
            .orderBy(F.desc(F.expr("odds / sd")), "token")
            .limit(LEXICON)
            .toPandas()
        )
        counts.unpersist()
        score = np.clip(listed["odds"] - listed["sd"], 0.5, 12.0).to_numpy()
        lexicon = dict(zip(listed["token"], score.tolist(), strict=True))
        words = ~listed["token"].str.endswith("*").to_numpy(dtype=bool) if len(listed) else np.zeros(0, dtype=bool)
        toxic, clean = listed["toxic"].to_numpy(dtype=float)[words], listed["clean"].to_numpy(dtype=float)[words]
        drift = min(-1e-3, math.log1p(-min(0.5, toxic.sum() / n_t)) - math.log1p(-min(0.5, clean.sum() / n_c)))
        share = (clean + 0.5) / (n_c + 0.5 * len(clean))
        rate = _rate(np.append(share, 1 - share.sum()), np.append(score[words], drift)) if len(clean) else 1.0
        model = Model(lexicon, drift, min(rate, 4.0), 0.0, 0.0, 0.0)
        seen = _evidence(labelled, model).cache()
        best = F.coalesce(F.array_max("segments"), F.lit(0.0))
        mean = seen.where("label = 0").agg(F.avg(F.lit(model.rate) * best - F.ln(F.greatest("n_words", F.lit(1))))).first()[0]
        model.log_k = (mean or 0.0) - _EULER
        model.slope, model.intercept = _calibrate(seen, model)
        seen.unpersist()
        return model
    finally:
        sample.unpersist()


def _evidence(labelled: DataFrame, model: Model) -> DataFrame:
    def run(parts):
        def rows():
            for part in parts:
                for label, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    n, found = model.segments(text.as_py())
                    yield label, n, [s for _, _, s in found]

        yield from batches(_EVIDENCE, rows())

    return labelled.select("label", "text").mapInArrow(run, "label int, n_words long, segments array<double>")


def _calibrate(seen: DataFrame, model: Model) -> tuple[float, float]:
    """A logistic curve through the labelled documents, by evidence in half units."""
    x = f"transform(segments, s -> {model.rate}D * s - ({model.log_k}D) - ln(greatest(n_words, 1)))"
    total = f"aggregate(filter({x}, e -> e > {-math.log(EXPECTED)}D), 0D, (a, e) -> a + e)"
    bins = seen.selectExpr("label", f"round(least({total}, 100D) * 2) / 2 as x").groupBy("x", "label").count().toPandas()
    return logistic_1d(bins["x"].to_numpy(dtype=float), bins["label"].to_numpy(dtype=float), bins["count"].to_numpy(dtype=float))


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
_WORD = re.compile(r"\S+")


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("toxicity", "passages")) -> DataFrame:
    """All columns of ``docs``, with ``toxicity`` (0 to 1) and ``passages``, the significant segments.

    Columns of these names are replaced; ``names`` gives others.

    A passage has its first and last character (end exclusive), its score and the
    number of such passages expected by chance.  Null and empty texts have no
    passage and the probability of texts without any.
    """
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(parts):
        for part in parts:
            scores, passages = [], []
            for text in part.column(at).to_pylist():
                n, found = model.segments(text)
                scores.append(model.probability(model.evidence(n, [s for _, _, s in found])))
                kept = [(a, b, s) for a, b, s in found if model.excess(n, s) > -math.log(EXPECTED)]
                if kept:
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                    passages.append(
                        [{"begin": spans[a][0], "end": spans[b][1], "score": s, "expected": math.exp(-model.excess(n, s))} for a, b, s in kept]
                    )
                else:
                    passages.append([])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array(passages, _SPANS)], names=[*part.schema.names, *names]
            )

    passage = "array<struct<begin: long, end: long, score: double, expected: double>>"
    return docs.mapInArrow(run, schema_with(docs, **{names[0]: "double", names[1]: passage}))
