"""Near-duplicate documents: MinHash, banding, signature verification, exact confirmation, connected components.

1. One pass over the texts makes each document's shingle set (64-bit hashes), ``hashes`` universal hash minima, a key for
   each band of them, and a digest of the set. Only these are written, not the texts.
2. Documents of one digest have the same set and form a class; only its least key goes on.
3. Keys that share a band stand in one bucket. A document is first paired with those least keys of its buckets that share several
   bands with it, a few in each round and only with other components, until a round links nothing more: that is linear, and
   ties large groups of copies together. Then, in buckets that still hold several components, all other pairs across components are compared by
   signature, in blocks of bounded size; the members of those that agree come again with their sets. So every pair that shares a band is compared unless its ends are already in one
   component, whatever the bucket's size.
4. Pairs whose signatures agree enough are confirmed on full sets: 100 * intersection >= percent * union.
5. Components of the confirmed links are found by alternating large-star and small-star.

With 28 bands of 4 minima a pair of similarity 0.8 shares no band with probability 4e-7, and passes the signature screen but
for about 1e-7; pairs above are missed less.

Defined cases: texts that are null, empty or without words have an empty set and link with nothing; texts with fewer words
than a shingle have one shingle, all their words; rows of one key count as one document; a null key links with nothing, its
component is null and it is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.llm.common import Scratch, by_batch, give_back, meet, small_batches
from scorelane.llm.components import connected
from scorelane.llm.tiles import by_group

MOST_WORDS = 150_000
MOST_MARKED = 1 << 21  # keys that a bitmap of 32 bits a key (8 MB) tells apart
HOT_BANDS = 2000
STARS = 3  # least keys that a document is paired with in a round; in the first it is one
PAIRS_PER_TASK = 20_000
BLOCK = 2048  # members of a bucket that are compared with each other at once


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    def __init__(self, words: int):
        self.k, self.words = words, _Words()

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles. Words lie between ASCII white space; A to Z are lower-cased."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ w[i : i + len(out)]
            out ^= out >> np.uint64(29)
        return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


class Signer:
    """Minima of universal hashes a * x + b (mod 2**64, upper 32 bits)."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in range(0, len(shingles), 4096):
            np.minimum(out, (self.a * shingles[None, at : at + 4096] + self.b).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)

    def keys(self, minima: np.ndarray) -> list[int]:
        parts = minima.astype("<u4").tobytes()
        size = 4 * self.rows
        return [xxhash.xxh3_64_intdigest(parts[i * size : (i + 1) * size], seed=i) - (1 << 63) for i in range(self.bands)]


def sketch(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """key, n (set size), digest, bands (a key each), sig (the lowest byte of each minimum)."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([picked.schema[0], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(bands, rows)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, len(whole), 1000)):
            n, digest, keys, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingler.shingles(t)
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append([]), sig.append(None)
                    continue
                minima = signer.minima(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(signer.keys(minima))
                sig.append(minima.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=schema.names)
        del shingler
        give_back()

    return picked.mapInArrow(run, schema)


def _agreement(a: Column, b: Column) -> Column:
    """The share of equal bytes in two signatures."""

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in pairs:
            left, right = (np.frombuffer(b"".join(z.to_pylist()), np.uint8).reshape(len(z), -1) if len(z) else np.zeros((0, 1)) for z in (x, y))
            yield pa.array((left == right).mean(axis=1), pa.float64())

    return by_batch(run, "double", a, b)


def _sets(words: int, text: Column, short: bool = False) -> Column:
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        for t in texts:
            sets = (shingler.shingles(x.as_py()) for x in t)
            yield pa.array([(np.unique((s >> np.uint64(32)).astype(np.uint32)) if short else s).tobytes() for s in sets], pa.binary())

    return by_batch(run, "binary", text)


def _common(a: Column, b: Column) -> Column:
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in pairs:
            out = []
            for left, right in zip(x, y, strict=True):
                every = np.concatenate([np.frombuffer(z.as_buffer(), np.uint64) for z in (left, right)])
                every.sort()
                out.append(int((every[1:] == every[:-1]).sum()))
            yield pa.array(out, pa.int64())

    return by_batch(run, "bigint", a, b)


def _among(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose key is among keys, n of them at most. Up to MOST_MARKED keys go to every task as a bitmap of 32 to 64 bits a
    key, which lets a few other rows through as well, and costs no shuffle of texts; more keys are joined."""
    if n > MOST_MARKED:
        return rows.join(keys.distinct(), "key", "left_semi")
    bits = 1 << max(15, (32 * n).bit_length())
    place = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1
    marks = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = rows.withColumn("_p", place).withColumn("_bucket", F.bitmap_bucket_number("_p")).withColumn("_p", F.bitmap_bit_position("_p"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return at.join(F.broadcast(marks), "_bucket").where(F.getbit(byte, (F.col("_p") % 8).cast("int")) == 1).select(rows.columns)


def _confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int, scratch: Scratch, name: str, tasks: int | None = None) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar enough; written. Only the texts concerned are read on."""
    pairs = scratch.put(pairs, f"{name}_pairs", tasks)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    texts = _among(texts, pairs.select(F.col("u").alias("key")).distinct().unionByName(pairs.select(F.col("v").alias("key")).distinct()), 2 * pairs.count())
    sets = scratch.put(texts.select("key", _sets(words, F.col("text")).alias("set")), f"{name}_sets").dropDuplicates(["key"])
    one = pairs.join(sets.select(F.col("key").alias("v"), F.col("set").alias("sv")), "v")
    two = one.join(sets.select(F.col("key").alias("u"), F.col("set").alias("su")), "u")
    common = two.select("u", "v", ((F.octet_length("su") + F.octet_length("sv")) / 8).cast("bigint").alias("total"), _common(F.col("su"), F.col("sv")).alias("common"))
    links = scratch.put(common.where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("u", "v"), f"{name}_links", tasks)
    scratch.drop(f"{name}_sets")
    return links


def _similar(a: pa.Buffer, b: pa.Buffer, percent: float) -> bool:
    """Whether two short sets have 100 * intersection >= percent * union."""
    every = np.concatenate([np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)])
    every.sort()
    common = int((every[1:] == every[:-1]).sum())
    return 100 * common >= percent * (len(every) - common)


def _across(members: DataFrame, sigs: DataFrame, short: DataFrame | None, percent: int, screen: float) -> DataFrame:
    """The members of a bucket in different components that may be similar. members: band, p, q, i (of blocks p and q of a bucket, which
    one), key, comp; sigs: key, n, sig, bands (all of the key's, packed). A pair that shares several bands belongs to the first
    of them alone.

    Without short sets: the members (same columns) of pairs whose signatures agree, so what comes out grows with the members and
    not with their pairs. With short (key and its set, 32 bits a shingle), for those: the pairs (u, v) whose short sets are
    similar, which grow with the links; shortening moves a similarity by parts in a million, hence the slack of half a
    percent."""
    dealt, with_sets = members.join(sigs, "key"), short is not None
    dealt = dealt.join(short, "key") if with_sets else dealt.withColumn("short", F.lit(None).cast("binary"))
    dealt = dealt.select("band", "p", "q", "i", "key", "comp", "n", "sig", "bands", "short")
    fields = ("u", "v") if with_sets else ("band", "p", "q", "i", "key", "comp")

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n, comp, i = (rows.column(c).to_numpy() for c in ("key", "n", "comp", "i"))
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if (comp != comp[0]).any():
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(key), -1)
            bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(len(key), -1)
            sets = rows.column("short")
            own = int(np.flatnonzero(bands[0] == rows.column("band")[0].as_py())[0])
            for x in np.flatnonzero(i == p):
                other = np.flatnonzero((i == q) & (comp != comp[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent))
                if p == q:
                    other = other[other > x]
                if len(other):
                    other = other[(sig[other] == sig[x]).mean(axis=1) >= screen]
                    other = other[~(bands[other, :own] == bands[x, :own]).any(axis=1)]
                    if with_sets and len(other):
                        other = other[[_similar(sets[int(x)].as_buffer(), sets[int(y)].as_buffer(), percent - 0.5) for y in other]]
                    left.append(np.full(len(other), x))
                    right.append(other)
        return np.concatenate(left), np.concatenate(right)

    def result(rows: pa.Table) -> pa.RecordBatch:
        left, right = pairs(rows)
        if not with_sets:
            some = pa.array(np.unique(np.concatenate([left, right])))
            return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(some) for c in fields], names=fields)
        key = rows.column("key").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(key[left], key[right])), pa.array(np.minimum(key[left], key[right]))], names=fields)

    out = by_group(dealt, ["band", "p", "q"], result, ", ".join(f"{c} long" for c in fields))
    return out.distinct() if with_sets else out


def _packed(bands: Column) -> Column:
    """An array of numbers as bytes."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            yield pa.array([np.array(x, np.int64).tobytes() for x in a.to_pylist()], pa.binary())

    return by_batch(run, "binary", bands)


def _joined(found: DataFrame | None, links: DataFrame, scratch: Scratch, name: str, tasks: int | None = None) -> DataFrame:
    """Components (node, component) of what was found and the new links; written. Only components that links tie together
    are worked on again."""
    if found is None:
        return scratch.put(connected(links, scratch, f"{name}_stars", tasks), name, tasks)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ties = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    tied = scratch.put(connected(ties, scratch, f"{name}_stars", tasks), f"{name}_tied", tasks)
    moved = found.join(tied.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return scratch.put(moved.unionByName(tied.join(found.select("node"), "node", "left_anti")), name, tasks)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 28, rows: int = 4, screen: float = 0.58) -> DataFrame:
    """key, n_shingles, component_id, kept. key is a whole number."""
    with small_batches(docs.sparkSession):  # all its tables are written inside
        return _near_duplicates(docs, key, text, words, percent, bands, rows, screen)


def _near_duplicates(docs: DataFrame, key: str, text: str, words: int, percent: int, bands: int, rows: int, screen: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.withColumn(key, F.col(key).cast("bigint"))
    all_rows = scratch.put(sketch(docs, key, text, words, bands, rows), "sketch")
    linkable = all_rows.where("n > 0 and key is not null")
    classes = scratch.put(linkable.groupBy("digest").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "classes")
    firsts = linkable.join(classes.select("digest", "class"), "digest", "left").where("class is null or class = key")

    posted = firsts.select(F.explode("bands").alias("band"), "key")
    buckets = scratch.put(posted.groupBy("band").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = scratch.put(meet(posted, buckets, "band", "size", bands * all_rows.count(), HOT_BANDS), "members")
    met = members.select("key").distinct()
    sigs = firsts.select("key", "n", "sig", _packed(F.col("bands")).alias("bands")).join(met, "key", "left_semi").dropDuplicates(["key"])
    sigs = scratch.put(sigs, "sigs")
    side = lambda name: sigs.select(F.col("key").alias(name), F.col("n").alias(f"n{name}"), F.col("sig").alias(f"s{name}"))

    def alike(pairs: DataFrame) -> DataFrame:
        met = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        return met.where(_agreement(F.col("su"), F.col("sv")) >= screen).select("u", "v")

    # Rounds of stars: each document with those least keys of other components that share most bands, until that links
    # nothing more. Buckets of two are all tried in the first.
    apart = members.where("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v"), "size").groupBy("u", "v").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("shared"))
    apart = scratch.put(apart, "apart")
    # Later tables of pairs are no longer than this one.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, apart.count() // PAIRS_PER_TASK)
    found, tried, turn = None, None, 0
    while True:
        stars = apart
        if found is not None:
            comp = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))  # noqa: E731, B023
            stars = stars.join(comp("u"), "u", "left").join(comp("v"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v"))
            stars = stars.join(tried, ["u", "v"], "left_anti")
        likely = stars.where("size > 2 and shared > 1").groupBy("u").agg(F.array_sort(F.collect_list(F.struct(-F.col("shared"), "v"))).alias("vs"))
        least = likely.select("u", F.explode(F.slice("vs", 1, 1 if found is None else STARS)).alias("x")).select("u", "x.v")
        chosen = scratch.put(least.unionByName(stars.where("size = 2").select("u", "v")) if found is None else least, f"chosen{turn}", tasks)
        if chosen.isEmpty():
            break
        links = _confirm(alike(chosen), docs, key, text, words, percent, scratch, f"star{turn}", tasks)
        tried = chosen if tried is None else tried.unionByName(chosen)
        if found is not None and links.isEmpty():
            break
        found = _joined(found, links, scratch, f"found{turn}", tasks)
        turn += 1

    # Everything else across components, in the buckets that still hold several.
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, component long")
    several = members.where("size > 2").select("band", "key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    several = several.join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    several = scratch.put(several, "several")
    open_ = several.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    several = meet(several, scratch.put(open_.select("band", "size"), "open"), "band", "size", several.count(), HOT_BANDS)
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    several = several.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    several = several.select("band", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "key", "comp")
    likely = scratch.put(_across(several, sigs, None, percent, screen), "likely")
    asked = likely.select("key").distinct()
    texts = _among(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), asked, asked.count())
    short = texts.select("key", _sets(words, F.col("text"), True).alias("short")).dropDuplicates(["key"])
    rest = _across(likely, sigs, short, percent, screen)
    rest = rest if tried is None else rest.join(tried, ["u", "v"], "left_anti")
    links = _confirm(rest, docs, key, text, words, percent, scratch, "across")
    if not links.isEmpty():
        found = _joined(found, links, scratch, "found_all")
    of = all_rows.select("key", "n", "digest").join(classes.select("digest", "class"), "digest", "left").withColumn("node", F.when(F.col("key").isNotNull(), F.coalesce("class", "key")))
    out = of.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = scratch.put(out, "out")
    for name in scratch.names() - {"out"}:
        scratch.drop(name)
    return out
