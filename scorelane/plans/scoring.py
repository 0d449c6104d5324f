"""Requests to responses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelane.config import Config
from scorelane.operators import features, knn, payloads, score
from scorelane.scratch import Scratch
from scorelane.sources.index import Index


def neighbours(queries: DataFrame, index: Index, names: list[str], config: Config, qid: str = "qid", dtype: str = "f16", scratch: Scratch | None = None) -> DataFrame:
    if config.use_ivf and index.centroids is not None:
        return knn.ivf(queries, index.refs, index.centroids, names, qid, config.k, min(config.nprobe, config.most_probes), dtype, scratch=scratch)
    return knn.brute(queries, index.refs, names, qid, config.k)


def score_requests(requests: DataFrame, index: Index, config: Config | None = None, qid: str = "qid", body: str = "body", strict: bool = True, dtype: str = "f16", scratch: Scratch | None = None) -> DataFrame:
    """qid, status, body of each request (columns qid and body; qid is unique). With scratch, statuses and vectors are written there
    and read again, so a large table of requests is parsed once and not by every step that needs it."""
    config = config or Config()
    checked = features.vectorize(payloads.validate(requests, body, strict), config=config).select(qid, "status", *features.NAMES)
    checked = scratch.put(checked, "checked") if scratch else checked
    vectors = checked.where("status = 200")
    found = neighbours(vectors, index, features.NAMES, config, qid, dtype, scratch)
    votes = score.vote(vectors, found, config.k, config.deny_from, qid)
    return score.respond(checked, votes, qid)
