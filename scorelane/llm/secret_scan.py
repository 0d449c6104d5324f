r"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found leftmost and without overlap within a kind, in code points, end exclusive: ``assign``, ``access`` and
``hex``. Besides, unlabelled tokens are candidates: runs of 20 or more letters, digits, ``_`` and ``-`` that have both a letter
and a digit and share no character with a base span. Every candidate's hash is counted over distinct repositories and
distinct owners of the whole corpus; a value that several owners hold, in clearly more repositories than the copies of one
document give, is a widely copied example; all others look live. Where identical documents are to count once, the repository is
a digest of the text. An unlabelled candidate that looks live becomes a span of kind ``owned``. Base spans stay whatever their
counts.

Positions are running sums over the pieces between matches, in blocks, so a text of very many matches takes linear time. Counts
are combined before the shuffle. Values with very many hits (at most ``HOT_VALUES``) meet their hits by a broadcast, so no
task gets all hits of one value.

Defined cases: null text has no span; each row, also one whose key is null or repeated, keeps the spans of its own text; null
owners and repositories count as one value of their own; an empty table gives no rows; further columns of any name stay in
the struct ``doc``. A run that holds the noncharacter U+FFFF is no candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.arrays import blocks, let, with_start

# The base kinds, in the order in which equal starts are listed.
KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
LEAST_ASSIGN = 8
FAMILY = 8  # distinct texts that near copies of one document may give
MASK = "￿"
LOOSE = f"[A-Za-z0-9_{MASK}-]{{20,}}"
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"
MATCH = "array<struct<gap:string,hit:string,value:string>>"
HOT_VALUES, LEAST_HOT = 1000, 10_000


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The pieces between matches and the matches, in turn; none without a match."""
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCH))


def _spans(matches: Column, kind: str, rank: int) -> Column:
    size = lambda m: F.length(m["gap"]) + F.coalesce(F.length(m["hit"]), F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return F.when(m["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def inside(z: Column) -> Column:
        return F.aggregate(z["part"], F.struct(z["at"].alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda n, m: n + size(m))
    return let(blocks(matches), lambda parts: F.flatten(F.transform(with_start(parts, total, lambda a, b: a + b), inside)))


def _masked(text: Column, matches: Column) -> Column:
    """text with its assign spans overwritten."""
    out = lambda m: F.concat(m["gap"], F.when(F.length(m["value"]) >= LEAST_ASSIGN, F.repeat(F.lit(MASK), F.length(m["hit"]))).otherwise(F.coalesce(m["hit"], F.lit(""))))
    return F.when(F.size(matches) > 0, F.array_join(F.transform(matches, out), "")).otherwise(text)


def find_candidates(docs: DataFrame, owner: str = "source", repo: Column | None = None, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """row (a number of each row, which holds once the result is written), doc (a struct of the columns in keep), owner, repo, base
    (spans of the base kinds) and loose (unlabelled candidates). repo: what counts as a repository; if none, the row."""
    row = F.monotonically_increasing_id()
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("struct<none:int>")
    rows = docs.select(row.alias("row"), kept.alias("doc"), F.col(owner).alias("owner"), (row if repo is None else repo).alias("repo"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({kind: _matches(F.col("text"), pattern, 2 if kind == "assign" else 0) for kind, pattern in KINDS.items()})
    rows = rows.withColumn("text", _masked(F.col("text"), F.col("assign"))).withColumn("loose", _matches(F.col("text"), LOOSE))
    long_enough = F.filter(_spans(F.col("assign"), "assign", 0), lambda s: F.length(s["value"]) >= LEAST_ASSIGN)
    base = F.sort_array(F.concat(long_enough, *[_spans(F.col(kind), kind, i) for i, kind in enumerate(KINDS) if i]))
    mixed = lambda s: s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]") & ~s["value"].rlike(f"{MASK}|{KINDS['access']}|{KINDS['hex']}")
    return rows.select("row", "doc", "owner", "repo", base.alias("base"), F.filter(_spans(F.col("loose"), "owned", len(KINDS)), mixed).alias("loose"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("row", "owner", "repo", F.explode(F.concat("base", "loose")).alias("span")).withColumn("value_hash", F.sha2(F.col("span.value"), 256))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_hits, n_repos, n_owners over all candidates of the corpus."""
    each = _hits(found).groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    apart = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  (a struct, so that null counts)
    return each.groupBy("value_hash").agg(F.sum("n").alias("n_hits"), apart("repo").alias("n_repos"), apart("owner").alias("n_owners"))


def scan_secrets(found: DataFrame, live_owners: int = 1, live_repos: int = 1) -> DataFrame:
    """row, doc, base, added, live: all spans of each row of ``find_candidates`` (read several times: write it first, which also
    settles its row).

    added holds the unlabelled candidates that at most live_owners owners or at most live_repos repositories hold; live those
    base spans and added ones of which that is true.
    """
    total = found.agg(F.sum(F.size("base") + F.size("loose"))).first()[0] or 0
    often = max(LEAST_HOT, total // HOT_VALUES)
    held = ownership(found).where((F.col("n_owners") <= live_owners) | (F.col("n_repos") <= live_repos)).select("value_hash", "n_hits")
    hits = _hits(found).select("row", "value_hash", "span")
    # At most total / often values have more hits than that.
    hot = F.broadcast(held.where(F.col("n_hits") > often).select("value_hash"))
    alive = hits.join(hot, "value_hash", "left_semi")
    cold = hits.join(F.broadcast(ownership(found).where(F.col("n_hits") > often).select("value_hash")), "value_hash", "left_anti")
    alive = alive.unionByName(cold.join(held.where(F.col("n_hits") <= often), "value_hash", "left_semi"))
    live = alive.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("live"))
    rows = found.select("row", "doc", "base").join(live, "row", "left").withColumn("live", F.coalesce("live", F.array().cast(SPAN)))
    return rows.select("row", "doc", "base", F.filter("live", lambda s: s["kind"] == "owned").alias("added"), "live")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each stretch that spans cover replaced by mark; spans are sorted by start and may overlap."""
    stop = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))
    take = lambda x, start, n: F.substr(x, (start + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))

    def cut(z: Column) -> Column:
        piece = take(text, z["at"], stop(z["part"]) - z["at"])
        begin = F.struct(z["at"].alias("at"), F.lit("").alias("out"))

        def of_block(h: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                kept = take(h["piece"], acc["at"] - h["at"], s["start"] - acc["at"])
                said = F.concat(acc["out"], kept, F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), said.alias("out"))

            return F.aggregate(z["part"], begin, step, lambda acc: acc["out"])

        return let(F.struct(z["at"].alias("at"), piece.alias("piece")), of_block)

    whole = let(blocks(spans), lambda parts: F.concat(F.array_join(F.transform(with_start(parts, stop, F.greatest), cut), ""), F.substr(text, (stop(spans) + 1).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
