"""Toxic passages by maximum-scoring segments.

Tokens score their log-odds between toxic and other texts under an informative Dirichlet prior. A linear-time scan finds all
maximal-scoring segments of a text; an extreme-value distribution says how significant a segment is in a text of that length; what
the significant segments amount to becomes a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillframe.llm.common import small_batches

TOKEN = re.compile(r"\w+")


def segments(marks: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a sequence that scores -drift but at the marks (place, score > 0).

    Linear in the marks: a segment begins and ends at a mark, and between two of them scores only fall. Candidates are kept on a
    stack with the sums left and right of them; a candidate merges with the last one whose left sum is lower, if its right sum is
    no higher.
    """
    stack: list[list] = []  # first, last, left sum, right sum, link to the last one below with a lower left sum
    total, at = 0.0, 0
    for place, score in marks:
        left = total - drift * (place - at)
        total, at = left + score, place + 1
        new = [place, place, left, total, -1]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= new[3]:
                new[4] = k
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3], -1]
            del stack[k:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def log_odds(toxic: np.ndarray, other: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each token and its z-score; the prior is the counts of both together, scaled to `strength`."""
    both = toxic + other
    prior = strength * both / max(both.sum(), 1.0)
    a, b = toxic + prior, other + prior
    na, nb = toxic.sum() + strength, other.sum() + strength
    delta = np.log(a / np.maximum(na - a, 1e-9)) - np.log(b / np.maximum(nb - b, 1e-9))
    return delta, delta / np.sqrt(1 / a + 1 / b)


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    drift: float
    rate: float  # lambda of the extreme-value distribution
    scale: float  # its K
    weights: tuple[float, ...]
    significant: float = 0.05

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[str]]:
        tokens = TOKEN.findall(text.lower()) if text else []
        scores = self.scores
        marks = [(k, scores[w]) for k, w in enumerate(tokens) if w in scores]
        return len(tokens), segments(marks, self.drift) if marks else [], tokens

    def expected(self, n: int, score: float) -> float:
        """How many segments of that score or more a text of n harmless tokens has."""
        return self.scale * n * math.exp(-self.rate * score)

    def features(self, n: int, segs: list[tuple[int, int, float]]) -> tuple[float, ...]:
        """Surprise at the best segment, at all significant ones together, and the share of the text that they cover."""
        e = [self.expected(n, s) for _, _, s in segs]
        best = -math.log(-math.expm1(-min(e)) + 1e-30) if e else 0.0
        good = [(a, b, x) for (a, b, _), x in zip(segs, e, strict=True) if x < self.significant]
        rest = sum(math.log(self.significant / max(x, 1e-30)) for _, _, x in good)
        return min(best, 50.0) / 10, math.log1p(rest) / 3, math.sqrt(sum(b - a + 1 for a, b, _ in good) / max(n, 1))

    def probability(self, features: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, other = Counter(), Counter()
    for b in batches:
        for text, label in zip(b["text"], b["toxic"], strict=True):
            (toxic if label else other).update(set(TOKEN.findall(text.lower())))
    names = list(toxic | other)
    for k in range(0, len(names), 20_000):
        part = names[k : k + 20_000]
        yield pd.DataFrame({"token": part, "toxic": [toxic[w] for w in part], "other": [other[w] for w in part]})


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(rate * values)) = 1; the mean of values is negative."""
    low, high = 1e-6, 1.0
    value = lambda r: float(np.dot(weights, np.exp(np.minimum(r * values, 700.0))))
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, ...]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, part of at most `most` labelled training documents, taken by a hash of doc_id. part: 0 counts, 1 calibrates."""
    key = F.col("doc_id").cast("string")
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(key.cast("binary")) % 5 != 0).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most)
    chosen = F.broadcast(known.select("doc_id", "toxic", (F.pmod("_h", F.lit(10)) >= 7).cast("int").alias("part")))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "toxic", "part")


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, least_count: int = 3, strength: float = 0.1, by_chance: float = 5.0, least_odds: float = 1.5, drift: float = 0.25) -> Model:
    """Learns from at most `most` labelled rows whose crc32(doc_id) mod 5 is not 0; lang, source and doc_id are no inputs.

    Seven tenths of the sample give the token counts, the rest the extreme-value distribution and the logistic weights. A token counts
    once a text, as a burst in one text says little. The prior weighs `strength` of all counts. A token scores if its z-score is one
    that at most by_chance of all tokens tested would reach by chance, and its log-odds are least_odds or more. The bound keeps what reaches the driver (tokens of the sample with least_count occurrences, and the calibration texts' features) and the
    model itself at a size that doesn't depend on the corpus. Without labels of both kinds the model scores everything 0 or so.
    """
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, most)
    counted = sample.filter("part = 0").mapInPandas(_counts, "token string, toxic long, other long")
    counted = counted.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = counted.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    rows = counted.filter(F.col("toxic") >= least_count).toPandas()
    # tokens that only harmless texts use can't score; the rest of the counts enters as one token
    toxic = np.append(rows["toxic"].to_numpy(float), (totals["toxic"] or 0) - rows["toxic"].sum())
    other = np.append(rows["other"].to_numpy(float), (totals["other"] or 0) - rows["other"].sum())
    delta, z = log_odds(toxic, other, strength * (toxic.sum() + other.sum())) if toxic.sum() and other.sum() else (np.zeros(len(toxic)), np.zeros(len(toxic)))
    least = NormalDist().inv_cdf(1 - min(0.5, by_chance / max(len(rows), 1)))
    good = (z[:-1] >= least) & (delta[:-1] >= least_odds)
    scores = {w: float(min(d, 8.0)) for w, d, g in zip(rows["token"], delta[:-1], good, strict=True) if g}

    bare = Model(scores, drift, 1.0, 1.0, (0.0,) * 4)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [bare.found(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"].astype("int64"), "n": [n for n, _, _ in got], "at": pd.Series([[float(v) for s in segs for v in s] for _, segs, _ in got], dtype=object), "hits": pd.Series([[scores[w] for w in tokens if w in scores] for _, _, tokens in got], dtype=object)})

    held = sample.filter("part = 1").mapInPandas(measured, "toxic long, n long, at array<double>, hits array<double>").toPandas()
    triples = [[(int(a[k]), int(a[k + 1]), a[k + 2]) for k in range(0, len(a), 3)] for a in held["at"]]
    y, n = held["toxic"].to_numpy(float), held["n"].to_numpy(float)
    calm = [k for k in range(len(held)) if not y[k]]
    hits = np.array([h for k in calm for h in held["hits"].iloc[k]])
    length = max(1.0, sum(n[k] for k in calm))
    # a half of an occurrence of the strongest token keeps the root finite where harmless texts have none
    strongest = max(scores.values(), default=1.0)
    values = np.concatenate([hits, [strongest, -drift]])
    mass = np.concatenate([np.full(len(hits), 1 / length), [0.5 / length, 1 - (len(hits) + 0.5) / length]])
    rate = _rate(values, mass) if mass @ values < 0 else 0.05
    top = np.array([max((s for _, _, s in triples[k]), default=0.0) for k in calm])
    weight = sum(n[k] * math.exp(-rate * t) for k, t in zip(calm, top, strict=True))
    scale = len(calm) / weight if weight > 0 else 1.0
    model = Model(scores, drift, rate, scale, (0.0,) * 4)
    if len(held) and 0 < y.sum() < len(y):
        x = np.array([model.features(int(m), t) for m, t in zip(n, triples, strict=True)])
        weights = _logistic(x, y)
    else:
        weights = (-5.0, 1.0, 1.0, 1.0)
    return Model(scores, drift, rate, scale, weights)


def scorer(model: Model):
    """The score and, four numbers each, the significant passages (start, end, score, expected) of each text, in one flat array."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            n, segs, _ = model.found(text)
            row = [model.probability(model.features(n, segs))]
            good = [(a, b, s, e) for a, b, s in segs if (e := model.expected(n, s)) < model.significant]
            if good:
                spans = [m.span() for m in TOKEN.finditer(text.lower())]
                for a, b, s, e in good:
                    row += [float(spans[a][0]), float(spans[b][1]), s, e]
            out.append(row)
        return pd.Series(out, dtype=object)

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1), predicted (1 from score 0.5 on) and passages: the significant toxic passages as spans of the lower-cased text.

    Whole texts are scanned. Null and empty texts have no passages and get the score of a text without any. Rows pass through one to
    one: repeated rows, null ids and other columns stay (columns named score, predicted or passages are replaced); an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "passages", "_toxicity")]
    out = docs.select(*kept, scorer(model)(F.coalesce("text", F.lit(""))).alias("_toxicity"))
    at = lambda k: F.element_at("_toxicity", k)
    passage = lambda i: F.struct(at(4 * i + 2).cast("int").alias("start"), at(4 * i + 3).cast("int").alias("end"), at(4 * i + 4).alias("score"), at(4 * i + 5).alias("expected"))
    n = ((F.size("_toxicity") - 1) / 4).cast("int")
    passages = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), passage)
    return out.select(*kept, at(1).alias("score"), (at(1) >= 0.5).cast("int").alias("predicted"), passages.alias("passages"))
