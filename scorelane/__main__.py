"""python -m scorelane build | score | evaluate: the plans from a command line. Wrong arguments end with status 2."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scorelane.config import BuildConfig, Config
from scorelane.operators import evaluate
from scorelane.plans.build import build_index
from scorelane.plans.scoring import score_requests
from scorelane.sources.index import read_index, summary, write_index
from scorelane.sources.references import read_references
from scorelane.sources.requests import read_requests, read_test_entries


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="scorelane", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="references to an index")
    build.add_argument("--input", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--dtype", choices=["f16", "f32"], default=BuildConfig.dtype)
    build.add_argument("--ivf", type=int, default=BuildConfig.nlist, help="number of clusters; 0 for none")
    build.add_argument("--max-iter", type=int, default=BuildConfig.max_iter)
    build.add_argument("--tol", type=float, default=BuildConfig.tol)
    build.add_argument("--seed", type=int, default=BuildConfig.seed)
    score = commands.add_parser("score", help="a request per line to responses")
    score.add_argument("--input", required=True)
    score.add_argument("--index", required=True)
    score.add_argument("--output", required=True)
    score.add_argument("--lenient", action="store_true", help="accept numbers for texts, repeated names, and text after the object")
    test = commands.add_parser("evaluate", help="a file of test entries to results; latency is the batch's time by entry")
    test.add_argument("--input", required=True)
    test.add_argument("--index", required=True)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("scorelane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "build":
        config = BuildConfig(args.dtype, args.ivf, args.max_iter, args.tol, args.seed)
        write_index(build_index(read_references(spark, args.input), config), args.output)
        print(summary(read_index(spark, args.output)).first().asDict())
        return 0
    index, config = read_index(spark, args.index), Config.from_env()
    dtype = index.meta.first()["dtype"]
    if args.command == "score":
        # Ids must not change between the reads of the requests, so they are written first.
        at = f"{args.output}_requests"
        read_requests(spark, args.input).select(F.uuid().alias("qid"), "body").write.mode("overwrite").parquet(at)
        asked = spark.read.parquet(at)
        score_requests(asked, index, config, strict=not args.lenient, dtype=dtype).write.mode("overwrite").parquet(args.output)
        return 0
    entries, _ = read_test_entries(spark, args.input)
    asked = entries.select(F.col("entry").alias("qid"), F.to_json("request", {"ignoreNullFields": "true"}).alias("body"), "expected_approved")
    began = time.time()
    responses = score_requests(asked, index, config, dtype=dtype).persist()
    n = responses.count()
    each = 1000 * (time.time() - began) / max(1, n)
    scored = evaluate.pair(responses.withColumn("latency_ms", F.lit(each)), asked.select("qid", "expected_approved"))
    print(evaluate.results_json(evaluate.scores(evaluate.confusion(scored))).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
