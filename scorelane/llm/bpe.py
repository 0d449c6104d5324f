"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern, and words are folded once each. The fold is a chain of Spark higher-order
functions: it starts from a word's bytes, looks up each neighbouring pair in a literal rank map, and merges the pair of the
lowest rank, leftmost first, until no pair has a rank. The ``most_words`` commonest distinct words among about
``sample_docs`` documents are folded so, into a table of a bounded size that the tasks hold. Words outside it are folded by
each task when it first meets them, by the same rule in Python: folding those inside the JVM as well took twice the time
that is allowed (figures in the README). What the sample holds changes the time, never a result. Decoding concatenates the
tokens' binary pieces.

Encoding is one narrow stage: nothing is shuffled, and a task's memory is bounded whatever the vocabulary of the corpus.

Defined cases: null text is empty; an empty text has no ids and the digests of nothing; null keys stay; repeated rows are
encoded each; an empty table gives no rows. A word of any length takes n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.llm.common import by_batch

MOST_WORDS = 250_000  # words that a task remembers besides the table
LONG = 64  # bytes of a word beyond which merging uses a heap; none such stand in the table
SHELVES = 1 << 15  # of the rank map
NONE = (1 << 31) - 1  # no rank
PAIR_TYPE = "struct<pairs:array<array<bigint>>,ranks:array<array<int>>,bytes:array<int>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal that the fold looks pairs up in: shelves of pairs of ids, the ids they merge to, and the ids of bytes."""
    pairs: list[list[int]] = [[] for _ in range(SHELVES)]
    merged: list[list[int]] = [[] for _ in range(SHELVES)]
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[(a * 20011 + b * 9973) % SHELVES].append(a << 17 | b)
                merged[(a * 20011 + b * 9973) % SHELVES].append(rank)
    text = json.dumps({"pairs": pairs, "ranks": merged, "bytes": [ranks[bytes([i])] for i in range(256)]}, separators=(",", ":"))
    return F.from_json(F.lit(text), PAIR_TYPE)


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: the ids of each word, given as an array of its bytes."""

    def rank(table: Column, a: Column, b: Column) -> Column:
        shelf = (a * 20011 + b * 9973).bitwiseAND(F.lit(SHELVES - 1))
        pair = F.shiftleft(a.cast("bigint"), 17).bitwiseOR(b.cast("bigint"))
        place = F.array_position(F.get(table["pairs"], shelf), pair).cast("int")
        return F.coalesce(F.get(F.get(table["ranks"], shelf), place - 1), F.lit(NONE))

    def merge(table: Column, state: Column) -> Column:
        """Merges the leftmost pair of the lowest rank; only its neighbours' ranks are looked up anew."""
        ids, low, n = state["ids"], F.array_min(state["ranks"]), F.size(state["ids"])

        def at(low_at: Column) -> Column:
            low, p = low_at["low"], low_at["p"]
            before = F.when(p > 1, F.array(rank(table, F.get(ids, p - 2), low))).otherwise(F.array().cast("array<int>"))
            after = F.when(p + 1 < n, F.array(rank(table, low, F.get(ids, p + 1)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), p - 1), F.array(low), F.slice(ids, p + 2, n)).alias("ids"),
                F.concat(F.slice(state["ranks"], F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(state["ranks"], p + 2, n)).alias("ranks"),
            )

        low_at = F.array(F.struct(low.alias("low"), F.array_position(state["ranks"], low).cast("int").alias("p")))
        return F.when(F.coalesce(low, F.lit(NONE)) == NONE, state).otherwise(F.get(F.transform(low_at, at), F.lit(0)))

    def ids_of(table: Column, word: Column) -> Column:
        ids = F.transform(word, lambda b: F.get(table["bytes"], b.cast("int")))
        steps = F.slice(word, F.lit(2), F.size(word))

        def first(ids: Column) -> Column:
            n = F.size(ids) - 1
            ranks_ = F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), lambda a, b: rank(table, a, b))
            return F.aggregate(steps, F.struct(ids.alias("ids"), ranks_.alias("ranks")), lambda state, _: merge(table, state), lambda state: state["ids"])

        return F.when(F.size(word) == 0, F.array().cast("array<int>")).otherwise(F.get(F.transform(F.array(ids), first), F.lit(0)))

    # The literal is bound once, so the plan holds it once.
    return F.get(F.transform(F.array(rank_map(ranks)), lambda table: F.transform(words, lambda word: ids_of(table, word))), F.lit(0))


def _byte_lists(words: list[bytes]) -> pa.Array:
    values = np.frombuffer(b"".join(words), np.uint8).astype(np.int16)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), pa.int32()), pa.array(values, pa.int16()))


def frequent_words(docs: DataFrame, pattern: str, ranks: dict[bytes, int], text: str, sample_docs: int, most_words: int) -> pa.Table:
    """word, ids of the commonest words among about sample_docs of the documents."""
    rate = min(1.0, sample_docs / max(1, docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                n.update(find(t or ""))
            words = [(w, k) for x, k in n.items() if len(w := x.encode()) <= LONG]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in words], pa.binary()), "n": pa.array([k for _, k in words], pa.int64())})

    picked = docs.select(F.col(text).cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    words = picked.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.orderBy(F.desc("n"), "word").limit(most_words)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _byte_lists(b.column(0).to_pylist())], names=["word", "bytes"])

    bytes_ = words.select("word").mapInArrow(listed, "word binary, bytes array<smallint>").repartition(words.sparkSession.sparkContext.defaultParallelism)
    return bytes_.select("word", F.get(fold_words(F.array("bytes"), ranks), F.lit(0)).alias("ids")).toArrow()


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold of one word in Python: the leftmost pair of the lowest rank merges first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    low = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while low and (least := min(low)) != NONE:
        i = low.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del low[i]
        if i:
            low[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(low):
            low[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap of pairs and a linked list, in n log n steps."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
        if after[i] < n and (r := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class _Ids(dict):
    """The ids of each word as bytes: from the folded table, others folded as they are met, up to a bound."""

    def __init__(self, known: pa.Table, ranks: dict[bytes, int]):
        self.known, self.ranks = known, ranks
        self._fill()

    def _fill(self) -> None:
        ids = self.known.column("ids").combine_chunks()
        offsets, values = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype("<i4").tobytes()
        self.clear()
        self.update((w.decode("utf-8", "surrogateescape"), values[a:z]) for w, a, z in zip(self.known.column("word").to_pylist(), offsets[:-1], offsets[1:], strict=True))

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS + len(self.known):
            self._fill()
        self[word] = out = array("I", merge_word(word.encode(), self.ranks)).tobytes()
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", sample_docs: int = 20_000, most_words: int = 300_000) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit), decoded (binary) of each row's text."""
    known = frequent_words(docs, pattern, ranks, text, sample_docs, most_words)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    done = T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, of, pieces = regex.compile(pattern).findall, _Ids(known, ranks).__getitem__, token_pieces(ranks)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                ids = [b"".join(map(of, find(t or ""))) for t in b.column(1).to_pylist()]
                texts = [b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], names=done.names)

    return rows.mapInArrow(run, done)


def token_pieces(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids (binary, little-endian unsigned 32-bit); null stays null."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = token_pieces(ranks)
        for a in arrays:
            yield pa.array([None if x is None else b"".join(map(pieces.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in a.to_pylist()], pa.binary())

    return by_batch(run, "binary", ids)
