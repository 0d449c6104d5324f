"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram binds its letters' vectors, each rotated by its place, by
elementwise product; a document bundles (sums) the vectors of all its n-grams; a language prototype bundles the unit
vectors of its documents. The language whose prototype has the largest cosine with the document wins, ties to the smaller
name. Prototypes and documents are compared after taking off the mean prototype, which holds what languages share.

Letters are lower-cased; a run of anything else is one space. The letters a to z have codes of their own, all others share
``ALPHABET`` - 27 codes by a hash, so any script works and a vector table stays bounded.

Defined cases: null text and text without letters give ``und`` with score 0, as does a model without languages; rows whose
lang is null teach nothing; repeated rows count as often as they occur; texts are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import by_batch, give_back, small_batches

ALPHABET = 128
UNKNOWN = "und"
PIECE = 1 << 20  # letters that are bundled at once
MOST_VALUES = 40_000 * 512  # of the n-gram vectors that a worker keeps
SLICE = 4096  # n-gram vectors that a product copies at once


@dataclass(frozen=True)
class Model:
    langs: list[str]
    prototypes: np.ndarray  # a unit row for each language, the mean taken off
    mean: np.ndarray
    n: int = 3
    dims: int = 512
    seed: int = 1


@lru_cache(1)
def _codes() -> np.ndarray:
    """The code of each code point; 0 is no letter."""
    points = np.arange(0x110000, dtype=np.uint64)
    hashed = 27 + (((points * 2654435761) & 0xFFFFFFFF) * (ALPHABET - 27) >> np.uint64(32))
    out = np.where(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000), hashed, 0).astype(np.int32)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


class Bundler:
    """Document vectors; keeps the vectors of the n-grams that it has met, up to a bound."""

    def __init__(self, n: int, dims: int, seed: int):
        letters = np.random.default_rng(seed).choice(np.float32([-1, 1]), (ALPHABET, dims))
        self.n, self.dims = n, dims
        self.rotated = [np.roll(letters, n - 1 - k, axis=1) for k in range(n)]
        self._reset()

    def _reset(self) -> None:
        self.slot = np.full(ALPHABET**self.n, -1, np.int32)
        self.rows = np.empty((0, self.dims), np.float32)

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """n-gram numbers of a text, in pieces; none if it has no letter."""
        tail = np.zeros(1, np.int32)
        for at in range(0, len(text), PIECE):
            points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.concatenate([tail, _codes()[points]])
            last = at + PIECE >= len(text)
            if last:
                codes = np.append(codes, 0)
            codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))].astype(np.int64)
            if len(codes) >= self.n and codes.any():
                out = np.zeros(len(codes) - self.n + 1, np.int64)
                for k in range(self.n):
                    out = out * ALPHABET + codes[k : len(out) + k]
                yield out
            tail = codes[-(self.n - 1) :].astype(np.int32)

    def bundle(self, docs: list[np.ndarray]) -> np.ndarray:
        """A row for each array of n-gram numbers."""
        every = np.concatenate(docs)
        of = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        if self.rows.size > MOST_VALUES:
            self._reset()
        if len(new := np.unique(every[self.slot[every] < 0])):
            made, rest = 1, new
            for k in range(self.n - 1, -1, -1):
                made, rest = made * self.rotated[k][rest % ALPHABET], rest // ALPHABET
            self.slot[new] = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, made])
        slots = self.slot[every]
        seen = np.zeros(len(self.rows), bool)
        seen[slots] = True
        used = np.flatnonzero(seen)
        at = np.empty(len(seen), np.int64)
        at[used] = np.arange(len(used))
        counts = np.bincount(of * len(used) + at[slots], minlength=len(docs) * len(used)).reshape(len(docs), -1)
        # In slices, which copy few rows at once; sums of whole numbers are exact in any order.
        out = np.zeros((len(docs), self.dims), np.float32)
        for a in range(0, len(used), SLICE):
            out += counts[:, a : a + SLICE].astype(np.float32) @ self.rows[used[a : a + SLICE]]
        return out

    def vectors(self, texts: Iterable[str | None], at_once: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """(index, vector) of each text that has letters, in order; a long text's pieces are summed."""
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            if held:
                for (i, _), row in zip(held, self.bundle([x for _, x in held]), strict=True):
                    yield i, row

        for i, text in enumerate(texts):
            text = text if text and any(map(str.isalpha, text)) else None  # marks alone are no letters
            pieces = list(self.grams(text)) if text and len(text) <= PIECE else None
            if pieces is None and text:
                total = None
                for grams in self.grams(text):
                    row = self.bundle([grams])[0]
                    total = row if total is None else total + row
                if total is not None:
                    yield from flush()
                    held, size = [], 0
                    yield i, total
            elif pieces:
                held.append((i, pieces[0]))
                size += len(pieces[0])
                if size >= at_once or len(held) >= 64:
                    yield from flush()
                    held, size = [], 0
        yield from flush()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_lang: int = 4000, n: int = 3, dims: int = 512, seed: int = 1) -> Model:
    """Prototypes from about per_lang documents of each language, dealt by a hash of key, so by no order of the input."""
    labelled = docs.where(F.col(lang).isNotNull())
    rates = {r[0]: min(1.0, per_lang / r[1]) for r in labelled.groupBy(lang).count().collect()}
    if not rates:
        return Model([], np.zeros((0, dims), np.float32), np.zeros(dims, np.float32), n, dims, seed)
    rate = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))])[F.col(lang)]
    chance = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < rate).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, total = Bundler(n, dims, seed), {}
        for b in batches:
            names = b.column(0).to_pylist()
            for i, v in bundler.vectors(t.as_py() for t in b.column(1)):
                if (size := np.linalg.norm(v)) > 0:
                    total[names[i]] = total.get(names[i], 0) + v / size
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([v.astype(np.float64).tolist() for v in total.values()], pa.list_(pa.float64()))})
        del bundler
        give_back()

    parts = sample.mapInArrow(sums, "lang string, v array<double>")
    with small_batches(docs.sparkSession):
        got = parts.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in got})
    proto = np.zeros((len(langs), dims))
    for r in got:
        proto[langs.index(r["lang"]), r["dim"]] = r["x"]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    proto = unit(proto)
    mean = proto.mean(axis=0) if len(langs) > 1 else np.zeros(dims)
    return Model(langs, unit(proto - mean).astype(np.float32), mean.astype(np.float32), n, dims, seed)


def predict(model: Model, text: Column) -> Column:
    """struct<lang:string, score:double>: the winning language, and its cosine as 0 to 1 (below 0: 0)."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bundler = Bundler(model.n, model.dims, model.seed)
        for texts in batches:
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model.langs:
                for i, v in bundler.vectors(t.as_py() for t in texts):
                    v = v / max(np.linalg.norm(v), 1e-12) - model.mean
                    cosines = model.prototypes @ (v / max(np.linalg.norm(v), 1e-12))
                    best = int(np.argmax(cosines))
                    langs[i], scores[i] = model.langs[best], float(min(1, max(0, cosines[best])))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return by_batch(run, "struct<lang:string,score:double>", text)
