"""Each micro-batch goes through the batch plan: requests are independent, so no state is kept, and ranking windows, which a
stream can't have, are allowed there. A batch is written under its number, so one that is run again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelane.config import Config
from scorelane.plans.scoring import score_requests
from scorelane.sources.index import Index


def score_stream(requests: DataFrame, index: Index, out: str, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        # Ids must not change between the reads of a batch, so they are written first.
        at = f"{out}/_requests/batch={number}"
        df.select(F.uuid().alias("qid"), "body").write.mode("overwrite").parquet(at)
        stored = df.sparkSession.read.schema("qid string, body string").parquet(at)
        scored = score_requests(stored, index, config)
        stored.withColumnRenamed("body", "request").join(scored, "qid").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
