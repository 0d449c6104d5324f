"""The engine's registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane import adapter
from scorelane.adapter import EMBEDDING_NAMES as NAMES
from scorelane.adapter import MCCS, centroids, clustered_references, references
from scorelane.config import MCC_RISK, BuildConfig, Config
from scorelane.functions.math_expr import half
from scorelane.operators import evaluate, features, kmeans, knn, payloads, score
from scorelane.plans.build import build_index
from scorelane.plans.scoring import score_requests
from scorelane.scratch import Scratch
from scorelane.sources.index import Index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PROBES = 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dist(a: str, b: str, dims: int = adapter.EMBEDDING_DIMS) -> str:
    return " + ".join(f"({a}[{i}]::double - {b}[{i}]::double) * ({a}[{i}]::double - {b}[{i}]::double)" for i in range(1, dims + 1))


REFS_SQL = "refs as (select vec_id as ref_id, vec_id as pos, coalesce(label in (0, 1, 2), false) as is_fraud, embedding as e from embeddings)"
ASKED_SQL = "asked as (select vec_id as qid, embedding as e from embeddings where vec_id % 100 = 0)"
CENTROIDS_SQL = "cents as (select label as cluster, arg_min(embedding, vec_id) as e from embeddings group by label)"
PAIRS_SQL = f"pairs as (select qid, ref_id, pos, is_fraud, {_dist('q.e', 'r.e')} as dist from asked q join refs r on r.ref_id <> q.qid)"
BRUTE_SQL = f"with {REFS_SQL}, {ASKED_SQL}, {PAIRS_SQL}, best as (select *, row_number() over (partition by qid order by dist, pos) as rank from pairs qualify rank <= 5)"
ASSIGN_SQL = f"""with {REFS_SQL}, {CENTROIDS_SQL}, near as (
  select r.*, c.cluster, {_dist('r.e', 'c.e')} as dist from refs r cross join cents c
  qualify row_number() over (partition by ref_id order by dist, cluster) = 1)"""
STEP_SQL = f"""{ASSIGN_SQL}, parts as (select cluster, generate_subscripts(e, 1) as i, unnest(e) as x from near),
means as (select cluster, i, avg(x::double)::float as m from parts group by all), old as (select cluster, generate_subscripts(e, 1) as i, unnest(e) as x from cents),
moved as (select o.cluster, o.i, coalesce(m.m, o.x) as m, o.x from old o left join means m using (cluster, i))"""
IVF_SQL = f"""{ASSIGN_SQL}, placed as (select ref_id, is_fraud, e, cluster, row_number() over (order by cluster, ref_id) - 1 as pos from near), {ASKED_SQL},
probed as (select qid, q.e, c.cluster, row_number() over (partition by qid order by {_dist('q.e', 'c.e')}, c.cluster) as probe_rank from asked q cross join cents c qualify probe_rank <= {PROBES}),
pairs as (select qid, probe_rank, ref_id, pos, is_fraud, {_dist('p.e', 'r.e')} as dist from probed p join placed r using (cluster) where ref_id <> qid)"""


@query(f"{BRUTE_SQL} select qid, rank::int as rank, ref_id, is_fraud, round(dist, 6) as dist from best")
def knn_brute_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knn.brute(adapter.queries(spark, sf_dir), references(spark, sf_dir), NAMES, not_self="ref_id")
    return out.select("qid", "rank", "ref_id", "is_fraud", F.round("dist", 6).alias("dist"))


@query(f"with {REFS_SQL}, asked as (select vec_id as qid, embedding as e from embeddings where vec_id = 0), {PAIRS_SQL} select qid, ref_id, is_fraud, round(dist, 6) as dist from pairs order by dist, pos limit 5")
def knn_single_query_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = adapter.queries(spark, sf_dir).where("qid = 0")
    return knn.single(one, references(spark, sf_dir), NAMES, not_self="ref_id").select("qid", "ref_id", "is_fraud", F.round("dist", 6).alias("dist"))


VOTE_SQL = f"{BRUTE_SQL}, votes as (select qid, count(*) filter (where is_fraud) as frauds from best group by qid), said as (select qid, coalesce(frauds, 0)::int as frauds from asked left join votes using (qid))"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = adapter.queries(spark, sf_dir)
    return score.vote(asked, knn.brute(asked, references(spark, sf_dir), NAMES, not_self="ref_id"))


@query(f"{VOTE_SQL} select qid, frauds, frauds / 5.0::double as fraud_score, frauds < 3 as approved from said")
def knn_fraud_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir)


@query(f"""{VOTE_SQL} select qid, '{{"approved":' || (case when frauds < 3 then 'true' else 'false' end) || ',"fraud_score":' || (frauds / 5.0::double)::varchar || '}}' as body from said""")
def response_body_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("qid", score.body(F.col("approved"), F.col("fraud_score")).alias("body"))


@query(f"{ASSIGN_SQL} select ref_id, cluster, round(dist, 6) as dist from near")
def centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(references(spark, sf_dir), centroids(spark, sf_dir), NAMES).select("ref_id", "cluster", F.round("dist", 6).alias("dist"))


def _step(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = centroids(spark, sf_dir)
    return kmeans.update(old, kmeans.means(kmeans.assign(references(spark, sf_dir), old, NAMES, keep=NAMES), NAMES), NAMES)


@query(f"{STEP_SQL} select cluster, (i - 1)::int as dim, round(m::double, 6) as mean from moved")
def kmeans_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir).select("cluster", F.posexplode(F.array(*NAMES)).alias("dim", "m")).select("cluster", "dim", F.round(F.col("m").cast("double"), 6).alias("mean"))


@query(f"{STEP_SQL} select round(max(abs(m::double - x::double)), 6) as max_change from moved")
def kmeans_max_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir).agg(F.round(F.max("change"), 6).alias("max_change"))


@query(f"with {ASKED_SQL}, {CENTROIDS_SQL} select qid, c.cluster, (row_number() over (partition by qid order by {_dist('q.e', 'c.e')}, c.cluster))::int as probe_rank from asked q cross join cents c qualify probe_rank <= {PROBES}")
def ivf_top_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.probes(adapter.queries(spark, sf_dir), centroids(spark, sf_dir), NAMES, nprobe=PROBES).select("qid", "cluster", "probe_rank")


def _ivf(spark: SparkSession, sf_dir: str, dtype: str, nprobe: int = PROBES) -> DataFrame:
    out = knn.ivf(adapter.queries(spark, sf_dir), clustered_references(spark, sf_dir), centroids(spark, sf_dir), NAMES, nprobe=nprobe, dtype=dtype, not_self="ref_id")
    return out.select("qid", "rank", "ref_id", "pos", "is_fraud", F.round("dist", 6).alias("dist"))


@query(f"{IVF_SQL} select qid, (row_number() over (partition by qid order by dist, probe_rank, pos))::int as rank, ref_id, pos, is_fraud, round(dist, 6) as dist from pairs qualify rank <= 5")
def ivf_knn_f32_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir, "f32")


@query(f"""{IVF_SQL}, best as (select * from pairs qualify row_number() over (partition by qid, probe_rank order by dist, pos) <= 5)
select qid, (row_number() over (partition by qid order by dist, probe_rank, pos desc))::int as rank, ref_id, pos, is_fraud, round(dist, 6) as dist from best qualify rank <= 5""")
def ivf_knn_f16_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir, "f16")


@query(f"{ASSIGN_SQL} select cluster, count(*) as n from near group by cluster")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.sizes(kmeans.assign(references(spark, sf_dir), centroids(spark, sf_dir), NAMES))


@query(f"{ASSIGN_SQL}, sizes as (select c.cluster, count(n.ref_id) as n from cents c left join near n using (cluster) group by c.cluster) select cluster, n, (coalesce(sum(n) over (order by cluster rows between unbounded preceding and 1 preceding), 0))::bigint as start from sizes")
def cluster_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = centroids(spark, sf_dir)
    return kmeans.offsets(kmeans.assign(references(spark, sf_dir), cents, NAMES), cents)


@query(f"{ASSIGN_SQL} select ref_id, cluster, row_number() over (order by cluster, ref_id) - 1 as pos from near")
def cluster_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clustered(kmeans.assign(references(spark, sf_dir), centroids(spark, sf_dir), NAMES).select("ref_id", "cluster"))


@query("select count(*) as count, count(*) filter (where label in (0, 1, 2)) as fraud, count(*) filter (where label not in (0, 1, 2)) as legit from embeddings")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).agg(F.count(F.lit(1)).alias("count"), F.count_if("is_fraud").alias("fraud"), F.count_if(~F.col("is_fraud")).alias("legit"))


@query("""with p as (select vec_id, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as x from embeddings),
s as (select *, pow(2::double, 10 - greatest(floor(log2(abs(x))), -14)) as g from p where x <> 0 union all select *, 1 from p where x = 0)
select vec_id, dim::int as dim, case when x = 0 then 0 else round_even(x * g, 0) / g end::double as half from s""")
def f16_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapter.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return e.select("vec_id", "dim", half(F.col("x")).cast("double").alias("half"))


@query(f"""{IVF_SQL}, found as (select qid, ref_id from pairs qualify row_number() over (partition by qid order by dist, probe_rank, pos) <= 5),
all_pairs as (select qid, ref_id, {_dist('q.e', 'r.e')} as dist from asked q join refs r on r.ref_id <> q.qid), true_ as (select qid, ref_id from all_pairs qualify row_number() over (partition by qid order by dist, ref_id) <= 5)
select (select count(*) from asked) as queries, (select count(*) from true_ join found using (qid, ref_id)) as hits, (select count(*) from true_ join found using (qid, ref_id)) / (select count(*) from true_)::double as recall""")
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = adapter.queries(spark, sf_dir)
    found = knn.ivf(asked, clustered_references(spark, sf_dir), centroids(spark, sf_dir), NAMES, nprobe=PROBES, dtype="f32", not_self="ref_id")
    return knn.recall(found, knn.brute(asked, references(spark, sf_dir), NAMES, not_self="ref_id"))


@query("select len(embedding) as dims, count(*) as n from embeddings group by 1")
def vector_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


_F = lambda a, b: f"(({a})::double / ({b})::double)::float"
_C = lambda x: f"greatest(least({x}, 1::float), 0::float)"
_MCC_LIST = "[" + ", ".join(f"'{m}'" for m in MCCS) + "]"
_RISK = "case mcc " + " ".join(f"when '{k}' then {v}::float" for k, v in MCC_RISK.items()) + " else 0.5::float end"
EVENTS_SQL = f"""with e0 as (select *, regexp_extract(props, '"k": *([0-9]+)', 1)::int as k from events),
e1 as (select *, 'MERC-' || k as merchant, lag(ts) over w as before,
  count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) - 1 as recent from e0 window w as (partition by user_id order by ts, event_id)),
e2 as (select *, coalesce(list(merchant) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), []) as known from e1),
tx as (select e2.*, u.a::float as avg_amount, m.a::float as m_avg, value::float as amount, (1 + event_id % 12)::float as installments, {_MCC_LIST}[k % {len(MCCS)} + 1] as mcc,
  ((event_id * 37) % 1200)::float as km_home, ((event_id * 53) % 1100)::float as km_last, epoch(date_trunc('second', ts))::bigint as now_s, epoch(date_trunc('second', before))::bigint as last_s
  from e2 join (select user_id, round(avg(value), 6) as a from events group by 1) u using (user_id) join (select k, round(avg(value), 6) as a from e0 group by 1) m using (k)),
v as (select event_id,
  {_C(_F('amount', 10000))} as v0, {_C(_F('installments', 12))} as v1,
  case when avg_amount <= 0 then 1::float else {_C(_F(_F('amount', 'avg_amount'), 10))} end as v2,
  {_F('hour(ts)', 23)} as v3, {_F('isodow(ts) - 1', 6)} as v4,
  case when before is null then -1::float else {_C(_F(_F('greatest(now_s - last_s, 0)::float', 60), 1440))} end as v5,
  case when before is null then -1::float else {_C(_F('km_last', 1000))} end as v6,
  {_C(_F('km_home', 1000))} as v7, {_C(_F('recent::float', 20))} as v8,
  (event_id % 2 = 0)::int::float as v9, (event_id % 3 <> 0)::int::float as v10,
  case when list_contains(known, merchant) then 0::float else 1::float end as v11, {_RISK} as v12, {_C(_F('m_avg', 10000))} as v13 from tx)"""


def _rounded(*numbers: int) -> str:
    return "select event_id, " + ", ".join(f"round(v{i}::double, 6) as v{i}" for i in numbers) + " from v"


def _features(spark: SparkSession, sf_dir: str, *numbers: int) -> DataFrame:
    v = features.vectorize(adapter.payloads(spark, sf_dir))
    return v.select("event_id", *[F.round(F.col(f"v{i}").cast("double"), 6).alias(f"v{i}") for i in numbers])


@query(f"{EVENTS_SQL} {_rounded(0, 1, 2)}")
def feature_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 0, 1, 2)


@query(f"{EVENTS_SQL} {_rounded(3, 4)}")
def feature_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 3, 4)


@query(f"{EVENTS_SQL} {_rounded(5, 6)}")
def feature_last_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 5, 6)


@query(f"{EVENTS_SQL} {_rounded(7, 8, 9, 10)}")
def feature_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 7, 8, 9, 10)


@query(f"{EVENTS_SQL} {_rounded(11, 12, 13)}")
def feature_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, 11, 12, 13)


@query(f"{EVENTS_SQL} {_rounded(*range(14))}")
def feature_vector_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, *range(14))


@query(f"{EVENTS_SQL} select mcc, round(max({_RISK})::double, 6) as risk, count(*) as n from tx group by mcc")
def mcc_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    mcc = F.col("payload.merchant.mcc")
    return adapter.payloads(spark, sf_dir).groupBy(mcc.alias("mcc")).agg(F.round(F.max(features.risk(mcc, Config())).cast("double"), 6).alias("risk"), F.count(F.lit(1)).alias("n"))


def _merchants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = adapter.payloads(spark, sf_dir)
    asked = p.select("event_id", F.col("payload.merchant.id").alias("merchant"))
    return asked, p.select("event_id", F.explode("payload.customer.known_merchants").alias("merchant"))


@query(f"{EVENTS_SQL} select event_id, merchant from tx where list_contains(known, merchant)")
def known_merchant_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, known = _merchants(spark, sf_dir)
    return asked.join(known, ["event_id", "merchant"], "left_semi")


@query(f"{EVENTS_SQL} select event_id, merchant from tx where not list_contains(known, merchant)")
def unknown_merchant_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, known = _merchants(spark, sf_dir)
    return asked.join(known, ["event_id", "merchant"], "left_anti")


@query("select event_id, case when event_id % 10 in (0, 8, 9) then 200 else 400 end::int as status from events")
def payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.validate(adapter.bodies(spark, sf_dir)).select("event_id", "status")


DECISIONS_SQL = """with d as (select event_id % 23 <> 0 as expected, (event_id % 23 <> 0 and event_id % 41 <> 0) or event_id % 299 = 0 as approved,
  case when event_id % 97 = 0 then 500 else 200 end as status, value::double as latency from events),
c as (select count(*) filter (where status = 200 and expected = approved and not approved) as tp, count(*) filter (where status = 200 and expected = approved and approved) as tn,
  count(*) filter (where status = 200 and expected <> approved and not approved) as fp, count(*) filter (where status = 200 and expected <> approved and approved) as fn,
  count(*) filter (where status <> 200) as err, count(*) as total, quantile_cont(latency, 0.99) as p99_ms from d),
s as (select *, fp + 3 * fn + 5 * err as weighted_errors, case when total > 0 then (fp + fn + err) / total::double else 0 end as failure_rate, case when total > 0 then (fp + 3 * fn + 5 * err) / total::double else 0 end as error_rate from c),
t as (select *, case when p99_ms <= 0 then 0 when p99_ms > 2000 then -3000 else 1000 * log10(1000 / greatest(p99_ms, 1)) end as p99_score,
  case when failure_rate > 0.15 then -3000 else 1000 * log10(1 / greatest(error_rate, 0.001)) - 300 * log10(1 + weighted_errors) end as detection_score from s)"""


@query(f"{DECISIONS_SQL} select tp, tn, fp, fn, err, total from c")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(adapter.decisions(spark, sf_dir)).drop("p99_ms")


@query(f"{DECISIONS_SQL} select round(p99_ms, 6) as p99_ms from c")
def p99_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(adapter.decisions(spark, sf_dir)).select(F.round("p99_ms", 6).alias("p99_ms"))


@query(f"{DECISIONS_SQL} select weighted_errors, round(error_rate, 6) as error_rate, round(failure_rate, 6) as failure_rate, round(detection_score, 2) as detection_score from t")
def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rounded(evaluate.scores(evaluate.confusion(adapter.decisions(spark, sf_dir)))).select("weighted_errors", "error_rate", "failure_rate", "detection_score")


@query(f"{DECISIONS_SQL} select round(p99_score, 2)::double as p99_score, round(detection_score, 2)::double as detection_score, round(p99_score + detection_score, 2)::double as final_score from t")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rounded(evaluate.scores(evaluate.confusion(adapter.decisions(spark, sf_dir)))).select("p99_score", "detection_score", "final_score")


@query(f"""{EVENTS_SQL}, asked as (select * from v where event_id % 100 = 0), pairs as (select q.event_id as qid, r.event_id as ref_id, coalesce(e.event_type = 'purchase', false) as is_fraud,
  {' + '.join(f'(q.v{i}::double - r.v{i}::double) * (q.v{i}::double - r.v{i}::double)' for i in range(14))} as dist from asked q join v r on r.event_id <> q.event_id join events e on e.event_id = r.event_id),
best as (select * from pairs qualify row_number() over (partition by qid order by dist, ref_id) <= 5)
select qid, count(*) filter (where is_fraud)::int as frauds, count(*) filter (where is_fraud) / 5.0::double as fraud_score, count(*) filter (where is_fraud) < 3 as approved from best group by qid""")
def transaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions against all other transactions as references."""
    vectors = features.vectorize(adapter.payloads(spark, sf_dir)).drop("payload")
    kinds = adapter.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("is_fraud"))
    refs = vectors.join(kinds, "event_id").withColumnsRenamed({"event_id": "ref_id"}).withColumn("pos", F.col("ref_id"))
    asked = vectors.where("event_id % 100 = 0").withColumnRenamed("event_id", "qid")
    return score.vote(asked, knn.brute(asked, refs, features.NAMES, not_self="ref_id"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction vectors as a reference set: event_id counts from 0 without gaps."""
    vectors = features.vectorize(adapter.payloads(spark, sf_dir)).drop("payload")
    kinds = adapter.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("is_fraud"))
    return vectors.join(kinds, "event_id").withColumnRenamed("event_id", "ref_id").select("ref_id", *features.NAMES, "is_fraud")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference set of _dense, made once for all that reads it."""
    return Scratch(spark, "references").put(_dense(spark, sf_dir), "dense")


def _trained(spark: SparkSession, sf_dir: str, refs: DataFrame | None = None) -> Index:
    """The index of all transactions by the default settings. A table of under 8 rows for each of the 1024 clusters gets one cluster for
    8 rows, as there can't be more clusters than rows."""
    refs = _written(spark, sf_dir) if refs is None else refs
    return build_index(refs, BuildConfig(nlist=max(1, min(BuildConfig.nlist, refs.count() // 8))))


def _placed(index: Index, scratch: Scratch) -> Index:
    """The index with its rows written, for searches that read them more than once."""
    refs = scratch.put(index.refs, "index")
    index.release()
    return Index(refs, index.centroids, index.meta)


@query()
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means and cluster order of the whole reference set; iterates until it converges, so tested against a plain Python version."""
    return _trained(spark, sf_dir).refs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), F.count_if("is_fraud").alias("frauds"))


@query()
def score_requests_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's request, defects and all, through the trained index; iterates, so tested by its parts."""
    asked, scratch = adapter.bodies(spark, sf_dir).withColumnRenamed("event_id", "qid"), Scratch(spark, "requests")
    return score_requests(asked, _placed(_trained(spark, sf_dir), scratch), Config(), scratch=scratch)


@query()
def trained_recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the trained index by the default probes, for the transactions whose event_id is divisible by 100."""
    refs = _written(spark, sf_dir)
    scratch = Scratch(spark, "searched")
    index, refs = _placed(_trained(spark, sf_dir, refs), scratch), refs.withColumn("pos", F.col("ref_id"))
    asked = refs.where("ref_id % 100 = 0").withColumnRenamed("ref_id", "qid")
    found = knn.ivf(asked, index.refs, index.centroids, features.NAMES, nprobe=Config.nprobe, not_self="ref_id", scratch=scratch)
    return knn.recall(found, knn.brute_by_clusters(asked, refs, index.centroids, features.NAMES, Scratch(spark, "compared"), not_self="ref_id"))


# The public SplitMix64 sequence: each state is the seed and a multiple of its step, and goes through three mixing steps.
_M64 = "18446744073709551616::uhugeint"
_MIX = lambda z, shift, by: f"((xor({z}, {z} >> {shift})::uhugeint * {by}::uhugeint) % {_M64})::ubigint"
DRAWS_SQL = f"""states as (select i, ((42::uhugeint + i::uhugeint * 11400714819323198485::uhugeint) % {_M64})::ubigint as z from range(1, 400) t(i)),
mixed1 as (select i, {_MIX('z', 30, '13787848793156543929')} as z from states), mixed2 as (select i, {_MIX('z', 27, '10723151780598845931')} as z from mixed1),
draws as (select xor(z, z >> 31) % (select count(*) from events)::ubigint as ref_id, min(i) as i from mixed2 group by 1),
first_rows as (select (row_number() over (order by i) - 1)::int as cluster, ref_id::bigint as ref_id from draws)"""


@query(f"with {DRAWS_SQL} select cluster, ref_id from first_rows where cluster < 16")
def kmeans_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapter.table(spark, sf_dir, "events").count()
    return spark.createDataFrame(list(enumerate(kmeans.first_rows(n, 16, 42))), "cluster int, ref_id long")


_V = range(14)


def _iteration_sql(i: int) -> str:
    dist = " + ".join(f"(v.v{d}::double - c.v{d}::double) * (v.v{d}::double - c.v{d}::double)" for d in _V)
    return f"""near{i} as (select v.*, c.cluster from v cross join c{i} c qualify row_number() over (partition by event_id order by {dist}, c.cluster) = 1),
c{i + 1} as (select c.cluster, {', '.join(f'coalesce(m.v{d}, c.v{d}) as v{d}' for d in _V)} from c{i} c left join (select cluster, {', '.join(f'avg(v{d}::double)::float as v{d}' for d in _V)} from near{i} group by cluster) m using (cluster))"""


TRAIN_SQL = f"{EVENTS_SQL}, {DRAWS_SQL}, c0 as (select f.cluster, {', '.join(f'v.v{d}' for d in _V)} from first_rows f join v on v.event_id = f.ref_id where f.cluster < 8), {', '.join(map(_iteration_sql, range(3)))}"


def _three_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, kmeans.Trained]:
    refs = _dense(spark, sf_dir).persist()
    return refs, kmeans.train(refs, features.NAMES, 8, max_iter=3, tol=0.0)


@query(f"{TRAIN_SQL} select cluster, {', '.join(f'round(v{d}::double, 4) as v{d}' for d in _V)} from c3")
def kmeans_trained_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds from the drawn rows."""
    refs, trained = _three_steps(spark, sf_dir)
    refs.unpersist()
    out = spark.createDataFrame([tuple(r) for r in trained.centroids], "cluster int, " + ", ".join(f"{n} float" for n in features.NAMES))
    return out.select("cluster", *[F.round(F.col(n).cast("double"), 4).alias(n) for n in features.NAMES])


@query(f"{TRAIN_SQL} select event_id as ref_id, cluster, row_number() over (order by cluster, event_id) - 1 as pos from near2")
def kmeans_trained_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the index after three rounds: the last assignment, which the last update came after."""
    refs, trained = _three_steps(spark, sf_dir)
    return kmeans.clustered(trained.assigned(refs, features.NAMES))
