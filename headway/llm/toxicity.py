"""Toxic spans by a linear-chain conditional random field.

The field has two states per token, clean and toxic.  A token's score for "toxic" is the sum of weights of the word
itself, of its stems (the first letters, as many as ``STEMS`` say), of the words before and after it, and of a bias;
transitions have weights of their own.  Scoring runs the forward-backward recursions over every whole text; the marginals
give the document's score, the probability that its most suspicious tokens are toxic after calibration, and the offending
spans, as offsets in the text as it is: tokens are found there and lower-cased one by one.

Training needs labelled tokens, while labels belong to documents.  In labelled toxic documents, tokens are toxic whose
word or stem belongs to toxic documents: log odds of the document counts of at least ``MARGIN``, in at least ``SUPPORT``
toxic documents, and so many of those with it are toxic as chance would give only with probability ``CHANCE``; no share of
all toxic documents is asked for, so a small language's words count too.  Equal texts count once, and so do toxic texts
that share most of their words.  All other tokens are clean.  The field is then fitted by gradient ascent on its likelihood.
The classifier is fitted on a bounded sample: at most ``SAMPLE`` toxic and ``CLEAN`` clean documents, the first ones in order
of a hash of their ids, with at most ``SAMPLE_CHARS`` characters each (longer ones aren't chosen).  The words are counted in all of
these, as are the documents' strengths for the calibration; the gradients take the first ``SAMPLE`` clean ones.  Its weights,
at most ``FEATURES`` words and stems, are all that travels: a task fits them, so texts don't reach the driver.

Edge cases: a null or empty text has no tokens and gets the lowest score; labels repeated for a document count once, the
higher one wins; null labels are ignored; without labelled documents of both classes every score is 0; texts of any length
are scored whole; repeated rows are scored alike; an empty table gives an empty result; columns of the input named ``score``
or ``spans`` are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\w+")
SAMPLE, CLEAN, SAMPLE_CHARS, FEATURES, SUPPORT, CHANCE, MARGIN = 1000, 4000, 20_000, 8_000, 3, 3e-5, 3.0
#: Precision of the priors of the calibration: its slope lies about 1, its shift anywhere.
SLOPE_PRIOR, SHIFT_PRIOR = 100.0, 0.01
STEMS = (4, 6)
KINDS = len(STEMS) + 3  # rows of weights: word, stems, word before, word after
THRESHOLD, SPAN = 0.3, 0.5
SPANS = "array<struct<start:int,end:int,probability:double>>"


def tokens_of(text: str) -> list[str]:
    """The words of the text as it is, each in lower case."""
    return list(map(str.lower, TOKEN.findall(text)))


def _features(tokens: list[str]) -> set[str]:
    return {*tokens, *("^" + t[:k] for k in STEMS for t in tokens if len(t) >= k)}


def _chance(a: int, n: int, share: float) -> float:
    """The probability of at least a of n where each is one with probability ``share``."""
    return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(a, n + 1)) if n < 200 else 0.0


def _families(tokens: list[list[str]], hashes: int = 16) -> list[int]:
    """One index of each group of texts that share most of their words, by the least hashes of these."""
    seeds, out = np.random.default_rng(5).integers(1, 1 << 62, (hashes, 1)) | 1, []
    seen: dict[tuple[int, int], list[int]] = {}
    for i, words in enumerate(tokens):
        x = np.array([zlib.crc32(w.encode()) for w in set(words)], np.int64)
        least = list(enumerate((x * seeds).min(axis=1).tolist()))
        shared = Counter(j for k in least for j in seen.get(k, ()))
        if max(shared.values(), default=0) <= hashes // 2:
            out.append(i)
        for k in least:
            seen.setdefault(k, []).append(i)
    return out


@dataclass
class Field:
    """Weights: ``words`` numbers the known words and stems (marked by ``^``) from 1 on; rows of ``emit`` are the ``KINDS``."""

    words: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((KINDS, 1)))
    bias: float = -8.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = False

    def ids(self, text: str) -> np.ndarray:
        """Rows: the numbers of the words and of their stems, 0 for unknown ones."""
        tokens = tokens_of(text)
        get, n = self.words.get, len(tokens)
        return np.stack([np.fromiter((get(t, 0) for t in tokens), np.int32, n), *[np.fromiter((get("^" + t[:k], 0) if len(t) >= k else 0 for t in tokens), np.int32, n) for k in STEMS]])

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of "toxic" of each token."""
        return [p for p, _ in self._run(docs)] if docs else []

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        e = np.full(ids.shape[1], float(self.bias))
        for weights, row in zip(self.emit, ids, strict=False):
            e += weights[row]
        e[1:] += self.emit[-2, ids[0, :-1]]
        e[:-1] += self.emit[-1, ids[0, 1:]]
        return e

    def _run(self, docs: list[np.ndarray], pairs: bool = False) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Forward-backward for all documents at once, step by step; documents are sorted by length, so those still running are a prefix.

        forward[t] and backward[t] are odds of "toxic" from the left (with the token) and from the right (without it).
        """
        order = sorted(range(len(docs)), key=lambda i: -docs[i].shape[1])
        sizes = np.array([docs[i].shape[1] for i in order])
        steps = int(sizes[0])
        running = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents longer than t
        first = np.concatenate(([0], np.cumsum(running)))  # token t of the k-th document is at first[t] + k
        at = {i: first[: docs[i].shape[1]] + k for k, i in enumerate(order)}
        e = np.empty(first[-1])
        for i, where in at.items():
            e[where] = np.exp(np.clip(self.emissions(docs[i]), -40, 40))
        a = np.exp(self.move)
        forward, backward = np.empty_like(e), np.ones_like(e)
        for t in range(steps):
            now = slice(first[t], first[t + 1])
            if t == 0:
                forward[now] = e[now]
            else:
                before = forward[first[t - 1] : first[t - 1] + running[t]]
                forward[now] = e[now] * (a[0, 1] + before * a[1, 1]) / (a[0, 0] + before * a[1, 0])
        for t in range(steps - 2, -1, -1):
            n = running[t + 1]
            after = slice(first[t + 1], first[t + 2])
            toxic = e[after] * backward[after]
            backward[first[t] : first[t] + n] = (a[1, 0] + a[1, 1] * toxic) / (a[0, 0] + a[0, 1] * toxic)
        odds = forward * backward
        p = odds / (1 + odds)
        out = []
        for i in range(len(docs)):
            where, both = at[i], None
            if pairs and len(where) > 1:
                f, later = forward[where[:-1]], e[where[1:]] * backward[where[1:]]
                joint = np.stack([a[0, 0] * np.ones_like(f), a[0, 1] * later, a[1, 0] * f, a[1, 1] * f * later])
                both = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            out.append((p[where], both))
        return out

    def strength(self, p: np.ndarray) -> float:
        """Log odds of what the marginals of one document amount to: the chance that any of the three highest is toxic."""
        if not len(p):
            return -40.0
        top = np.partition(p, -3)[-3:] if len(p) > 3 else p
        clean = float(np.log1p(-np.minimum(top, 1 - 1e-12)).sum())
        return math.log(max(-math.expm1(clean), 1e-12)) - clean

    def score(self, p: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * self.strength(p) + self.shift)))) if self.trained else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, tolerance: float = 1e-9) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels y over strengths x: the most likely ones under normal priors.

    Newton steps on both together, halved while they don't better the fit; the priors keep the answer finite where the
    classes are apart.  Raises if it doesn't converge.
    """
    points, prior, mean = np.stack([x, np.ones_like(x)], axis=1), np.array([SLOPE_PRIOR, SHIFT_PRIOR]), np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = points @ at
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(prior * (at - mean) ** 2))

    at = mean
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(points @ at, -500, 500)))
        slope = points.T @ (q - y) + prior * (at - mean)
        step = np.linalg.solve((points * (q * (1 - q))[:, None]).T @ points + np.diag(prior), slope)
        if np.abs(step).max() <= tolerance:
            return float(at[0]), float(at[1])
        now = loss(at)
        while loss(at - step) > now and np.abs(step).max() > tolerance:
            step = step / 2
        at = at - step
    raise ArithmeticError("the calibration doesn't converge")


def fit(texts: list[str], toxic: list[int], features: int = FEATURES, rounds: int = 40, clean_most: int = SAMPLE) -> Field:
    """Fit a field to labelled documents: words from all of them, weights from the toxic and the first ``clean_most`` clean ones, the calibration from all."""
    first = dict(zip(texts, toxic, strict=True))  # equal texts count once
    texts, toxic = list(first), list(first.values())
    shared: dict[str, str] = {}  # one object for each different word: the driver holds thousands of documents
    tokens = [[shared.setdefault(w, w) for w in tokens_of(t)] for t in texts]
    keep = [i for i, t in enumerate(tokens) if t]
    tokens, toxic = [tokens[i] for i in keep], [toxic[i] for i in keep]
    bad_texts = [w for w, y in zip(tokens, toxic, strict=True) if y]
    alone = [bad_texts[i] for i in _families(bad_texts)]
    clean = [w for w, y in zip(tokens, toxic, strict=True) if not y]
    n = [len(clean), len(alone)]
    if not all(n):
        return Field()
    seen = [Counter(f for words in some for f in _features(words)) for some in (clean, alone)]
    logit = lambda c, of: math.log((c + 0.5) / (of - c + 0.5))
    likely = [w for w, c in seen[1].items() if c >= SUPPORT and logit(c, n[1]) - logit(seen[0][w], n[0]) >= MARGIN]
    bad = {w for w in likely if _chance(seen[1][w], seen[1][w] + seen[0][w], n[1] / sum(n)) <= CHANCE}
    common = [w for w, c in (seen[0] + seen[1]).most_common(features) if c >= 10 and w not in bad]
    model = Field(words={w: i + 1 for i, w in enumerate([*sorted(bad), *common][:features])})
    size = len(model.words) + 1
    ids = [np.array([[model.words.get(w, 0) for w in words], *[[model.words.get("^" + w[:k], 0) if len(w) >= k else 0 for w in words] for k in STEMS]], np.int32) for words in tokens]
    gold = [np.array([y and not bad.isdisjoint(_features([w])) for w in words], np.float64) for words, y in zip(tokens, toxic, strict=True)]
    del tokens, bad_texts, alone, clean, seen, shared
    every, least = ids, np.cumsum(np.array(toxic) == 0)
    some = [i for i, y in enumerate(toxic) if y or least[i] <= clean_most]
    ids, gold = [ids[i] for i in some], [gold[i] for i in some]
    model.emit, total = np.zeros((KINDS, size)), sum(map(len, gold))
    want = np.zeros((2, 2))
    for g in gold:
        s = g.astype(int)
        np.add.at(want, (s[:-1], s[1:]), 1)
    model.bias = math.log((sum(g.sum() for g in gold) + 1) / total)
    flat = [np.concatenate(x) for x in zip(*[(*w, np.concatenate(([0], w[0, :-1])), np.concatenate((w[0, 1:], [0]))) for w in ids], strict=True)]
    truth = np.concatenate(gold)
    square = [np.full((KINDS, size), 1e-8), np.full((2, 2), 1e-8), 1e-8]
    for _ in range(rounds):
        got = model._run(ids, pairs=True)
        error = truth - np.concatenate([p for p, _ in got])
        g_emit = np.stack([np.bincount(f, error, size) for f in flat]) - 0.05 * model.emit
        g_emit[:, 0] = 0
        g_move = want - sum(b for _, b in got if b is not None) - 0.05 * model.move
        g_bias = error.sum()
        for k, g in enumerate((g_emit, g_move, g_bias)):
            square[k] = square[k] + g * g
        model.emit += g_emit / np.sqrt(square[0])
        model.move += 0.5 * g_move / np.sqrt(square[1])
        model.bias += 0.5 * g_bias / math.sqrt(square[2])
    model.emit[np.abs(model.emit) < 1e-3] = 0
    model.trained = True
    x = np.array([model.strength(p) for at in range(0, len(every), 500) for p in model.marginals(every[at : at + 500])])
    model.slope, model.shift = calibrate(x, np.array(toxic, float))
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, clean: int = CLEAN) -> Field:
    """Fit on the sample of ``docs`` that ``labels`` (doc_id, toxic) covers."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fine = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= chars))
    known = fine.select("doc_id").join(marks, "doc_id")  # ids alone are shuffled, and the sample's broadcast
    parts = []
    for y, most in ((0, clean), (1, sample)):
        chosen = known.filter(F.col("toxic") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        mine = fine.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
        parts.append(mine.select(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(y).alias("toxic")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((y, h, i, t) for f in frames for y, h, i, t in zip(f["toxic"].tolist(), f["hash"].tolist(), f["doc_id"], f["text"], strict=True))
        model = fit([r[3] for r in rows], [r[0] for r in rows], clean_most=sample)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # One task: its input is the sample, whose bounds are given above, and it is started again if its executor is lost.
    fitted = parts[0].unionAll(parts[1]).coalesce(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else Field()


def score(docs: DataFrame, model: Field, text: str = "text", lanes: int = 1000) -> DataFrame:
    """Add ``score`` (double) and ``spans`` (start, end and highest probability of each offending span, offsets in characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(source: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        hits = p >= SPAN
        if hits.any():
            joined = False
            for m, hit, prob in zip(TOKEN.finditer(source), hits, p, strict=False):
                if hit and joined:
                    out[-1] |= {"end": m.end(), "probability": max(out[-1]["probability"], float(prob))}
                elif hit:
                    out.append({"start": m.start(), "end": m.end(), "probability": float(prob)})
                joined = bool(hit)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, lanes):
                some = batch.slice(at, lanes)
                texts = [t or "" for t in some.column(text).to_pylist()]
                marginals = crf.marginals([crf.ids(t) for t in texts])
                added = [pa.array([crf.score(p) for p in marginals], pa.float64()), pa.array([spans(t, p) for t, p in zip(texts, marginals, strict=True)], SPAN_TYPE)]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], *added], [*kept, "score", "spans"])

    kept = [c for c in docs.columns if c not in ("score", "spans")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("spans", T._parse_datatype_string(SPANS))])
    return docs.select(*kept).mapInArrow(run, schema)


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
