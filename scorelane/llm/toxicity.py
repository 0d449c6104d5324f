"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and the first 4 to 7 letters of longer ones, each hashed into one of
``BUCKETS`` buckets. Every bucket has a weight and ``factors`` factors: logit = bias + sum of w_i + sum over pairs of
<v_i, v_j>. The pair term learns combinations, such as an insult beside the mention of a group, that a sum of weights misses.

All buckets that the labelled sample holds are learnt together. Their penalty is that of a lasso over terms scaled by their noise:
a weight or factor stays 0 while its gradient is within ``penalty`` standard deviations of what labels dealt by chance
would give. Weights come from proximal steps, in which any bucket joins whose gradient on what is still unexplained exceeds its
penalty; no term is judged alone or dropped. Each factor starts as the direction in which products of terms explain most
of the rest, found by power iterations over all buckets (so a pair whose members say nothing by themselves is found), and
is kept if it gains more than chance would. Then bias, weights and factors take steps together. All is done on the whole
sample at once, so the model doesn't depend on the order of rows.

The sample holds at most ``per_label`` rows of each label, chosen by a hash of the key; the bias then follows the labels'
true proportion. The driver learns from the sample's bucket numbers: 4 bytes a distinct term of its rows. Everything else
covers all rows and whole texts.

Defined cases: null and empty texts get the bias alone; without rows of both labels every score is 0; repeated label rows
of a document count once, as 1 if any of them is; a repeated document counts as often as it stands; rows of the sample
without a document teach nothing; further columns of any name are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import by_batch

WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)
BUCKETS = 1 << 18
MOST_WORDS = 150_000  # words that a worker remembers


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted numbers of the buckets whose weight or factors aren't 0
    w: np.ndarray
    v: np.ndarray
    bias: float


def _hashes(word: str) -> list[int]:
    return [zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(b"^" + word[:k].encode()) % BUCKETS for k in STEMS if len(word) > k)]


class _Terms(dict):
    """A word's buckets as bytes of 32-bit numbers; with a model, only its terms, as their places."""

    def __init__(self, terms: np.ndarray | None = None):
        self.place = None if terms is None else {int(x): i for i, x in enumerate(terms)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = _hashes(word) if self.place is None else [self.place[x] for x in _hashes(word) if x in self.place]
        self[word] = out = np.array(found, np.uint32).tobytes()
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall((text or "").lower()))
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint32))


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic", per_label: int = 4000) -> tuple[DataFrame, float]:
    """(key, label) of at most per_label rows of each label, and the logit of label 1 among all labelled keys."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    n = {r["_y"]: r["count"] for r in one.groupBy("_y").count().collect()}
    chance = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    parts = [
        one.where((F.col("_y") == y) & (chance < min(1.0, 1.5 * per_label / max(1, n.get(y, 0))))).withColumn("_o", F.xxhash64(F.col(key))).orderBy("_o", key).limit(per_label)
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).select(F.col(key).alias("_key"), "_y"), float(np.log(max(1, n.get(1, 0)) / max(1, n.get(0, 0))))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 4000, factors: int = 4, penalty: float = 3.5, seed: int = 1) -> Model:
    picked, prior = sample(labels, key, label, per_label)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(picked), "_key").select("_y", "_text")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "ids": pa.array([terms.of(t.as_py()).tobytes() for t in b.column(1)], pa.binary())})

    got = sorted((r["y"], bytes(r["ids"])) for r in rows.mapInArrow(buckets, "y int, ids binary").collect())
    y = np.array([y for y, _ in got], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, factors)), -50.0)
    terms, w, v, bias = _fit([np.frombuffer(x, np.uint32) for _, x in got], y, factors, penalty, seed)
    return Model(terms, w, v, bias + prior - float(np.log(y.sum() / (len(y) - y.sum()))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(0, np.abs(x) - by)


class _Sample:
    """Rows of terms, by row and by term. every: the buckets that occur; count: rows of each."""

    def __init__(self, ids: list[np.ndarray]):
        self.every, self.term = np.unique(np.concatenate(ids), return_inverse=True)
        self.row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.n, self.count = len(ids), np.bincount(self.term, minlength=len(self.every)).astype(float)
        self.rows = self.row[np.argsort(self.term, kind="stable")]
        self.first = np.append(0, np.cumsum(self.count)).astype(int)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x[self.term], self.n)

    def by_term(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.term, x[self.row], len(self.every))

    def columns(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(terms)), np.float32)
        for k, t in enumerate(terms):
            out[self.rows[self.first[t] : self.first[t + 1]], k] = 1
        return out


def _weights(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, w: np.ndarray, bias: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps of the penalised logistic loss on dense columns."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    scale = np.maximum(x.sum(0), 1) ** -0.5
    x, now, penalty = x * scale, np.append(w, bias) / scale, np.append(penalty, 0) * scale
    t = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        t = x.T @ (x @ t)
        t /= np.linalg.norm(t)
    steep, at, m = 0.2625 * float(np.linalg.norm(x @ t) ** 2) + 1e-9, now.copy(), 1.0
    for _ in range(steps):
        slope = x.T @ (_sigmoid(x @ at.astype(np.float32)) - y).astype(np.float32)
        new, k = _shrunk(at - slope / steep, penalty / steep), (1 + (1 + 4 * m * m) ** 0.5) / 2
        at, now, m = new + (m - 1) / k * (new - now), new, k
    now = now * scale
    return now[:-1], float(now[-1])


def _direction(s: _Sample, rest: np.ndarray, noise: np.ndarray, penalty: float, v: np.ndarray, steps: int = 24) -> np.ndarray:
    """Power iterations from v on minus the products of terms weighted by rest; what chance explains shrinks to 0, more strictly from
    step to step."""
    own = s.by_term(rest)
    for i in range(steps):
        t = s.by_row(v)
        spread = np.sqrt((t * t).mean())
        new = _shrunk(own * v - s.by_term(rest * t), penalty * min(1, i / (steps / 2)) * noise * spread) / (s.count + 10)
        size, was = (float(np.sqrt((z * z * s.count).sum())) for z in (new, v))
        if not size:
            return np.zeros_like(v)
        v = new + 0.3 * size / was * v * (new != 0)  # towards the greatest eigenvalue, not the least
        v /= np.abs(v).max()
    return v


def _fit(ids: list[np.ndarray], y: np.ndarray, factors: int, penalty: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The buckets that aren't 0, their weights and factors, and the bias."""
    s, p = _Sample(ids), y.mean()
    noise = np.sqrt(s.count * p * (1 - p))
    w, v, bias, live = np.zeros(len(s.every)), np.zeros((len(s.every), factors)), float(np.log(p / (1 - p))), np.zeros(0, np.int64)
    for _ in range(20):
        over = np.abs(s.by_term(_sigmoid(s.by_row(w) + bias) - y)) / (penalty * noise)
        over[live] = 0
        # The 256 farthest beyond their penalty join at once, others in the next round.
        joins = np.argsort(-over, kind="stable")[:256]
        joins = joins[over[joins] > 1.01]
        if not len(joins):
            break
        live = np.append(live, joins)
        found, bias = _weights(s.columns(live), y, penalty * noise[live], w[live], bias)
        w[:] = 0
        w[live], live = found, live[found != 0]
    z, rng = s.by_row(w) + bias, np.random.default_rng(seed)
    for f in range(factors):
        rest, best = _sigmoid(z) - y, (0.0, None, None)
        starts = [rng.normal(size=len(w)) / np.sqrt(s.count + 10) for _ in range(5)]
        starts += [(np.arange(len(w)) == k).astype(float) for k in live[np.argsort(-np.abs(w[live]) * noise[live], kind="stable")[:3]]]
        for start in starts:
            if (direction := _direction(s, rest, noise, penalty, start)).any():
                products = 0.5 * (s.by_row(direction) ** 2 - s.by_row(direction**2))
                gain = -(rest * products).sum() / np.sqrt(p * (1 - p) * (products**2).sum() + 1e-9)
                best = max(best, (gain, direction, products), key=lambda x: x[0])
        if best[0] < penalty:
            break
        size = 0.0
        for _ in range(30):  # Newton steps along the direction
            q = _sigmoid(z + size * best[2])
            size = min(25.0, max(0.0, size - float(np.clip(((q - y) * best[2]).sum() / ((q * (1 - q) * best[2] ** 2).sum() + 1e-6), -1, 1))))
        v[:, f] = best[1] * np.sqrt(size)
        z = z + size * best[2]
    live = np.flatnonzero((w != 0) | (v != 0).any(1))
    w, v, bias = _together(s.columns(live), y, w[live], v[live], bias)
    return s.every[live].astype(np.uint32), w, v, bias


def _together(x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float, steps: int = 150, rate: float = 0.03) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam steps of all parameters that aren't 0, with a unit ridge."""
    on, now = v != 0, [w, v, np.array(bias)]
    mean, square = ([np.zeros_like(a) for a in now] for _ in range(2))
    for k in range(1, steps + 1):
        w, v, bias = now
        t = x @ v
        rest = _sigmoid(bias + x @ w + 0.5 * ((t * t).sum(1) - x @ (v * v).sum(1))) - y
        slopes = [x.T @ rest + w, (x.T @ (rest[:, None] * t) - (x.T @ rest)[:, None] * v + v) * on, rest.sum()]
        mean = [0.9 * m + 0.1 * g for m, g in zip(mean, slopes, strict=True)]
        square = [0.99 * q + 0.01 * g * g for q, g in zip(square, slopes, strict=True)]
        now = [a - rate * (m / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-6) for a, m, q in zip(now, mean, square, strict=True)]
    return now[0], now[1], float(now[2])


def _logits(flat: np.ndarray, of: np.ndarray, n: int, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """The logit of each of n documents, and the sum of its terms' factors."""
    total = np.stack([np.bincount(of, v[flat, k], n) for k in range(v.shape[1])], 1)
    squares = np.bincount(of, (v[flat] ** 2).sum(1), n)
    return bias + np.bincount(of, w[flat], n) + 0.5 * ((total**2).sum(1) - squares), total


def score(model: Model, text: Column) -> Column:
    """The probability of label 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = _Terms(model.terms)
        for texts in batches:
            ids = [terms.of(t.as_py()) for t in texts]
            of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
            z, _ = _logits(flat, of, len(ids), model.w, model.v, model.bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())

    return by_batch(run, "double", text)
