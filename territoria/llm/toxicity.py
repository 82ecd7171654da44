"""Toxic passages: token log-odds with Dirichlet priors, maximum-scoring segments, extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, giving_back, tidy

#: The classifier learns from about so many labelled rows of a class at most, chosen by a hash of doc_id; counts for the
#: prior, and all else, read all rows.
TRAINING_ROWS = 20_000
#: Words count with their first STEM letters as a token of their own, so that unseen inflections score.
STEM = 4
#: Weight of the prior (in documents), and the least z-score and log-odds of a token that scores.
PRIOR, Z, ODDS = 50.0, 4.0, 1.5
#: Score of a token that says nothing: it ends a passage after a while. Where clean text holds so many scoring tokens
#: that sums would grow by chance, it is doubled until they don't.
DRIFT = -0.25
#: Passages whose expected number in clean text of that length is below this are significant.
E_VALUE = 1.0

WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """A token's score by its word or `stem*`; the extreme-value parameters; the logistic curve over the evidence."""

    scores: dict
    decay: float
    scale: float
    slope: float
    shift: float
    drift: float = DRIFT


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(words) -> set[str]:
    found = set(words)
    return found | {w[:STEM] + "*" for w in found if len(w) >= STEM}


def segments(scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence of (position, score, drift since the last one
    scored), in one pass. A stack holds candidates with the sums before and after them, and where the nearest one with a
    smaller sum before it stands; a new one joins those to its left that it extends."""
    stack: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for at, score, gap in scores:
        total += gap
        start, lo, hi = at, total, total + score
        total = hi
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= lo:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= hi:
                break
            start, lo = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, at + 1, lo, hi, k))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def passages(text: str, model_scores: dict, drift: float = DRIFT) -> tuple[list[tuple[int, int, float]], int, list[float]]:
    """Scoring segments of a text's tokens, the number of tokens, and the scores of those that have one."""
    words = tokens(text)
    get, hits, last = model_scores.get, [], 0
    for k, w in enumerate(words):
        s = get(w)
        if s is None:
            s = get(w[:STEM] + "*") if len(w) >= STEM else None
        if s is not None:
            hits.append((k, s, drift * (k - last)))
            last = k + 1
    return (segments(hits) if hits else []), len(words), [s for _, s, _ in hits]


def evidence(found: list[tuple[int, int, float]], n: int, decay: float, scale: float) -> float:
    """How far a text's significant segments exceed what chance gives in n tokens: the sum of -ln of their E-values."""
    base = math.log(max(scale * n, 1e-9) / E_VALUE)
    return sum(x for x in (decay * s - base for _, _, s in found) if x > 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(features(tokens(text)))
    names = list(seen[0].keys() | seen[1].keys())
    for k in range(0, len(names), 20_000):
        part = names[k : k + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][x] for x in part], pa.int64()), pa.array([seen[1][x] for x in part], pa.int64())], ["token", "clean", "toxic"])


def _background(tokens_: list[str]):
    wanted = frozenset(tokens_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(wanted.intersection(features(tokens(text or ""))))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["token", "n"])

    return run


def _odds(y1: Column, y0: Column, n1: int, n0: int) -> Column:
    return F.log(y1 / (n1 + PRIOR - y1)) - F.log(y0 / (n0 + PRIOR - y0))


def _candidates(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """The tokens of the sample that may stand out, whatever part of all documents holds them: with more weight a of the
    prior the odds fall and the error does too, so in a range of weights neither beats the odds at its begin with the error
    at its end."""
    edges = [0.0, *(PRIOR * 1.25**-k for k in range(40, -1, -1))]
    ranges = []
    for least, most in zip(edges, edges[1:], strict=False):
        error = F.sqrt(1 / (F.col("toxic") + most) + 1 / (F.col("clean") + most))
        odds = _odds(F.col("toxic") + least, F.greatest(F.col("clean") + least, F.lit(1e-9)), n1, n0)
        ranges.append((odds >= ODDS) & (odds / error >= Z))
    return counts.where((F.col("toxic") > 1) & reduce(or_, ranges))


def _lexicon(counts: DataFrame, docs: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """The log-odds, of being in toxic documents, of tokens for which they stand out. The Dirichlet prior is a token's
    share of all documents, labelled or not; only tokens of the bounded sample that may stand out come to the driver."""
    rows = _candidates(counts, n0, n1).select("token", "clean", "toxic").collect()
    if not rows:
        return {}
    everywhere = documents_of(docs, "text").mapInArrow(giving_back(_background([r["token"] for r in rows])), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    seen = {r["token"]: r["n"] for r in everywhere.collect()}
    n, out = max(seen.get("", 0), 1), {}
    for r in rows:
        a = PRIOR * seen.get(r["token"], 0) / n
        y1, y0 = r["toxic"] + a, r["clean"] + a
        if min(n1 + PRIOR - y1, n0 + PRIOR - y0, y0) <= 0:
            continue
        odds = math.log(y1 / (n1 + PRIOR - y1)) - math.log(y0 / (n0 + PRIOR - y0))
        if odds >= ODDS and odds / math.sqrt(1 / y1 + 1 / y0) >= Z:
            out[r["token"]] = odds
    return out


def decay(scores: np.ndarray, rates: np.ndarray, drift: float = DRIFT) -> float:
    """The lambda of the distribution of largest segment sums where tokens score `scores` at `rates` a token, and the
    drift otherwise: the positive root of sum(rate * exp(lambda * score)) = 1. There is one where the mean is negative."""
    s, p = np.append(scores, drift), np.append(rates, 1 - rates.sum())
    if p.min() < 0 or s @ p >= 0 or s.max() <= 0:
        raise ValueError("scores have no negative mean in clean text, so their segments have no extreme-value distribution")
    total = lambda x: float(p @ np.exp(x * s)) - 1
    hi = 1.0
    while total(hi) < 0:
        hi *= 2
    lo = hi / 2
    while total(lo) > 0:
        lo /= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 0 else (lo, mid)
    return lo


def fitted_scale(lam: float, sizes: np.ndarray, tops: np.ndarray) -> float:
    """The maximum-likelihood K of P(top > x) = 1 - exp(-K n exp(-lambda x)) for largest sums of clean texts of n tokens."""
    return len(tops) / float((sizes * np.exp(-lam * tops)).sum())


def _hits(scores: dict):
    """(score, n): how many tokens have a score; null stands for all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                _, n, own = passages(text, scores)
                seen.update(own)
                seen[None] += max(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["score", "n"])

    return run


def _told(scores: dict, drift: float, lam: float | None = None, scale: float = 1.0):
    """(toxic, n, x): a text's tokens and its largest segment sum, or its evidence where lambda is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(x, scores, drift)[:2] for x in batch.column("text").to_pylist()]
            told = [max((s for _, _, s in f), default=0.0) if lam is None else evidence(f, max(n, 1), lam, scale) for f, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([max(n, 1) for _, n in rows], pa.int64()), pa.array(told, pa.float64())], ["toxic", "n", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a little shrinkage so that separable data end too. The slope is never
    negative: where it would be, evidence says nothing and the shift is the log-odds of the class."""
    b = np.zeros(2)
    X = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (w * (p - y)) + 1e-3 * b
        h = (X * (w * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    if not np.isfinite(b).all() or b[0] < 0:
        return 0.0, math.log((w @ y) / (w @ (1 - y)))
    return float(b[0]), float(b[1])


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


@tidy
def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model | None:
    """Learns from labelled rows (labels: doc_id, toxic) whose crc32(doc_id) mod 5 isn't 0, about `rows` of each class at
    most; None where docs don't hold both classes of them. Where no token stands out the score is the share of the
    toxic class for every text. Rows of docs that repeat a doc_id count as documents of its class each."""
    batches_held(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = {c: min(1.0, rows / k) for c, k in n.items()}
    if min(part.values(), default=1.0) < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 50)) < F.when(F.col("toxic") == 1, part.get(1, 1.0)).otherwise(part.get(0, 1.0)) * (1 << 50))
    # about 2 * `rows` rows at any size of the data: ids that can be broadcast, texts that are written once
    sample = cut(documents_of(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # of the documents there are
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return None
    counts = sample.mapInArrow(giving_back(_counted), "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    scores, drift, lam, scale = _lexicon(counts, docs, n0, n1), DRIFT, 1.0, 1.0
    if scores:
        # each score's rate in clean text; one that it never has counts as half a token of all that score
        hits = {r["score"]: r["n"] for r in sample.where("toxic = 0").mapInArrow(giving_back(_hits(scores)), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()}
        values = np.unique(list(scores.values()))
        rates = (np.array([hits.get(v, 0) for v in values.tolist()]) + 0.5 / len(values)) / (hits[None] + 1)
        while rates @ values + (1 - rates.sum()) * drift >= 0:
            drift *= 2
        lam = decay(values, rates, drift)
        tops = sample.where("toxic = 0").mapInArrow(giving_back(_told(scores, drift)), "toxic int, n long, x double").toPandas()  # three numbers for each row of the bounded sample
        scale = fitted_scale(lam, tops["n"].to_numpy(float), tops["x"].to_numpy(float))
    told = sample.mapInArrow(giving_back(_told(scores, drift, lam, scale)), "toxic int, n long, x double").toPandas()
    weights = told["toxic"].map({c: 1 / p for c, p in part.items()}).to_numpy(float)
    slope, shift = _logistic(np.log1p(told["x"].to_numpy(float)), told["toxic"].to_numpy(float), weights)
    return Model(scores, lam, scale, slope, shift, drift)


def score(text: str | None, model: Model) -> float:
    """The probability of the label that a text's evidence gives."""
    found, n, _ = passages(text or "", model.scores, model.drift)
    x = math.log1p(evidence(found, max(n, 1), model.decay, model.scale))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.shift))))


def clean_documents(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below `least`; all of them without a model. A null
    text counts as empty. One pass, no shuffle."""
    batches_held(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(x, model) < least for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs if model is None else docs.mapInArrow(giving_back(run), docs.schema)


def _scorer(model: Model | None, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, where = [], []
            for text in batch.column("text").to_pylist():
                if model is None:
                    out.append(0.0)
                    where.append([])
                    continue
                found, n, _ = passages(text or "", model.scores, model.drift)
                x = math.log1p(evidence(found, max(n, 1), model.decay, model.scale))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.shift)))))
                base = math.log(max(model.scale * max(n, 1), 1e-9) / E_VALUE)
                where.append([{"first": a, "end": b, "score": s} for a, b, s in found if model.decay * s > base] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(where, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], ["doc_id", "score", "passages"])

    return run


def toxicity(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """(doc_id, score, passages) for each row of docs: passages are the significant toxic segments as token positions
    (first, end exclusive) and sums. One pass over whole texts, no shuffle; only the text counts. A null text counts as
    empty; an empty one scores as a text without evidence. Without a model all scores are 0. Repeated rows score alike,
    other columns are ignored, an empty table gives no rows."""
    batches_held(docs.sparkSession)
    return documents_of(docs, "doc_id", "text").mapInArrow(giving_back(_scorer(model, spans)), "doc_id long, score double, passages array<struct<first: long, end: long, score: double>>")
