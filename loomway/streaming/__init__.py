"""Answering a stream of route queries, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..core import scratch
from ..plans.router import Router


def answer_stream(queries: DataFrame, router: Router, path: str, checkpoint: str) -> StreamingQuery:
    """Routes of the queries that arrive, as Parquet at ``path/batch=N``; a batch that is run again replaces its rows."""

    def answer(batch: DataFrame, n: int) -> None:
        with scratch(batch.sparkSession):  # what a batch needed on its way goes with it
            router.find_routes(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
