"""Beyond the pools: new queries as a stream, ranked against a static gallery as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arbalest.operators import ranking, scoring


def rank_stream(queries: DataFrame, gallery: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of queries (dataset, split, query_id, qv) is ranked and written as Parquet under its batch number, so
    that a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        found = ranking.rank(scoring.dot_scores(batch, gallery), k)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
