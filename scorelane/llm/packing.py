"""Bounded-space online best-fit packing of tokenized documents into sequences.

Each task tokenizes its documents and packs their pieces as they come. ``open_bins`` sequences are open at most. They stand in
a bitset keyed by free space, so the tightest one that fits is one bit operation away; if none fits and all are open, the
fullest closes first. What a task's bins hold when its documents end is left over. The left-over pieces of all tasks are dealt
into groups of about ``group`` sequences and packed by the same best fit, longest first, each group in one task: so tasks of
few documents lose nothing to each other, and a group loses under one sequence. Memory of a task is bounded by open_bins or
group sequences. The pieces are written once in between, so no text is tokenized twice.

Token ids are those of the tokenizers library, ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the
strings of added tokens that stand in a text become their ids. If the file has the settings below, texts without added tokens
are cut at spaces and line feeds, which never join what stands around them, and the ids of a stretch between them are
remembered: first as it stands, then by lower-case piece; what is outside the plain range goes to the tokenizer as it is.
Remembered stretches are bounded. With any other settings every text goes to the tokenizer as it is.

Defined cases: null and empty texts have the end id alone; null keys stay; repeated rows are packed each; an empty table
gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.llm.common import Scratch, by_batch

MOST_STRETCHES = 300_000
# ASCII and Latin letters up to U+017F whose lower case is one letter.
PLAIN = "!-~¡-¬®-įı-ňŊ-ſ"
PLAIN_TEXT, PLAIN_STRETCH = re.compile(f"[ \\n{PLAIN}]*"), re.compile(f"[{PLAIN}]*")
# The tokenizer settings under which stretches can be remembered.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def plain_settings(path: str) -> bool:
    """Whether the tokenizer file at path has the settings above."""
    with open(path, encoding="utf-8") as file:
        x = json.load(file)
    whole = x.get("truncation") is None and x.get("padding") is None and x.get("post_processor") is None
    pre = x.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}
    return whole and pre and x.get("normalizer") == NORMALIZER and all(x["model"].get(k) == v for k, v in MODEL.items()) and all(t.get(k) == v for t in x.get("added_tokens") or [] for k, v in ADDED.items())


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write for bytes: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Encoder:
    """Token ids of texts as bytes of little-endian unsigned 32-bit numbers, equal to the tokenizer's."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.plain = Tokenizer.from_file(path), plain_settings(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.split = regex.compile(PIECES).findall
        self.stretches, self.pieces = _Memory(self._stretch), _Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        """Of a lower-case piece as the tokenizer's own splitting makes them."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stretch(self, text: str) -> bytes:
        if not PLAIN_STRETCH.fullmatch(text):
            return self._whole(text)
        text = text.lower()
        if text.isalpha():
            return self.pieces[text]
        if text[-1:] in {".", ",", "!"} and text[:-1].isalpha():
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self.plain or any(t in text for t in self.added):
            return self._whole(text)
        if text.isascii() or PLAIN_TEXT.fullmatch(text):
            text = text.lower()  # fewer stretches to remember
        return b"".join(map(self.stretches.__getitem__, text.replace("\n", " ").split(" ")))


class _Memory(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MOST_STRETCHES:
            self.clear()
        self[key] = out = self.make(key)
        return out


class BestFit:
    """Online best fit with a bounded number of open bins. ``add`` returns closed bins, ``left`` the open ones: lists of items."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.n = 0, 0
        self.bins: dict[int, list[list]] = {}  # by free space

    def _put(self, free: int, items: list) -> None:
        self.bins.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.n += 1

    def _take(self, free: int) -> list:
        items = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n -= 1
        return items

    def add(self, size: int, item: object) -> list[list]:
        closed = []
        if fits := self.bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.n >= self.most and size < self.capacity:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, items = self.capacity, []
        items.append((size, item))
        if free == size:
            closed.append(items)
        else:
            self._put(free - size, items)
        return closed

    def left(self) -> list:
        """What the open bins hold; they are empty then."""
        out = [items for same in self.bins.values() for items in same]
        self.bits, self.n, self.bins = 0, 0, {}
        return out


def _fields(rows: DataFrame) -> T.StructType:
    more = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))
    return T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in more)])


class _Rows:
    """Rows of closed bins, as record batches of a schema."""

    def __init__(self, names: list[str], types: list[pa.DataType], first: int):
        self.names, self.types, self.sequence, self.held = names, types, first, []

    def add(self, closed: list[list]) -> None:
        for items in closed:
            offset = 0
            for size, (before, after) in items:
                self.held.append((*before, *after, self.sequence, offset))
                offset += size
            self.sequence += 1

    def out(self) -> pa.RecordBatch:
        columns = list(zip(*self.held, strict=True)) or [[] for _ in self.names]
        self.held = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, self.types, strict=True)], names=self.names)


def _wide(ids: Column, narrow: bool) -> Column:
    """16-bit ids as 32-bit ones."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in a], pa.binary())

    return by_batch(run, "binary", ids) if narrow else ids


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, open_bins: int = 256, keep: tuple[str, ...] = (), group: int = 512) -> DataFrame:
    """A row per piece: key, the columns in keep, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.
    Other columns of the same names as these six can't be in keep."""
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(key), *keep, F.col(text).cast("string").alias("_text"))
    schema, lead = _fields(rows), len(rows.columns) - 1
    marked = T.StructType([*schema.fields[:-2], T.StructField("left", T.BooleanType()), *schema.fields[-2:]])
    # In between, ids take 16 bits if all fit.
    narrow = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()]) < 1 << 16
    width = 2 if narrow else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, made = Encoder(tokenizer_path), BestFit(capacity, open_bins), None
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            if made is None:
                kinds = [f.type for f in b.schema][:-1]
                made = _Rows(marked.names, [*kinds, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()], TaskContext.get().partitionId() << 36)
            columns = [b.column(i).to_pylist() for i in range(lead)]
            for i, t in enumerate(x.as_py() for x in b.column(lead)):
                ids, values = encoder.ids(t) + end, tuple(c[i] for c in columns)
                if narrow:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                for piece, at in enumerate(range(0, len(ids), width * capacity)):
                    part = ids[at : at + width * capacity]
                    size = len(part) // width
                    made.add(packer.add(size, (values, (piece, at // width, size, part, False))))
                if len(made.held) >= 5000:
                    yield made.out()
        if made is not None:
            made.add([[(size, (before, (*after[:-1], True))) for size, (before, after) in items] for items in packer.left()])
            yield made.out()

    pieces = scratch.put(rows.mapInArrow(run, marked), "pieces")
    closed, left = pieces.where(~F.col("left")).drop("left"), pieces.where("left").drop("left")
    groups = -(-(left.agg(F.sum("length")).first()[0] or 0) // (capacity * group)) or 1
    left = left.withColumn("offset", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made, now = BestFit(capacity, 1 << 62), None, None
        for b in batches:
            if made is None:
                made = _Rows(schema.names, [f.type for f in b.schema], 0)
            for *values, number in zip(*(b.column(i).to_pylist() for i in (*range(lead + 4), lead + 5)), strict=True):
                if number != now:
                    made.add(packer.left())
                    now, made.sequence = number, 1 << 62 | number << 36
                made.add(packer.add(values[lead + 2], (values, ())))
            yield made.out()
        if made is not None:
            made.add(packer.left())
            yield made.out()

    order = [F.col("offset"), F.desc("length"), F.col("sequence_id"), F.col(key), F.col("piece")]
    packed = closed.unionByName(left.repartition("offset").sortWithinPartitions(*order).mapInArrow(again, schema))
    return packed.withColumn("ids", _wide(F.col("ids"), narrow))
